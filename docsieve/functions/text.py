"""Scalar text functions: Column -> Column, built in unless marked."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}+#.'’-]*"
TOKEN = r"[\p{L}\p{M}\p{N}]+"
VOCAB = r"\.[\p{L}\p{N}+#]+|\p{L}[\p{L}\p{M}\p{N}+#./-]*"
#: A sign, a number before white space, or the letter that a word processor's circle becomes; "12.5%" is no number of a list.
BULLET = r"^\s*(?:[•●▪◦‣*–—-]|o\s|\d{1,2}[.)]\s)\s*"
ZERO_WIDTH = "[\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}]"
BIDI = "[\\x{202A}-\\x{202E}\\x{2066}-\\x{2069}]"
TAGS = "[\\x{E0000}-\\x{E007F}]"
# What counts as hidden, and what is taken out. Joiners are letters' own in many scripts and in emoji, so
# they count between two Latin letters only; a mark at the very start is the byte-order mark; soft hyphens and embeddings
# are a word processor's, taken out but not counted, as are the isolates around a number.
ALWAYS = "\\x{200B}\\x{2060}-\\x{2064}\\x{2066}-\\x{2069}\\x{E0000}-\\x{E007F}"
JOINERS, LATE_MARK = "(?<=\\p{IsLatin})[\\x{200C}\\x{200D}]+(?=\\p{IsLatin})", "(?<!^)\\x{FEFF}"
HIDDEN = f"[{ALWAYS}\\x{{202D}}\\x{{202E}}]|{JOINERS}|{LATE_MARK}"
STRIPPED = f"[{ALWAYS}\\x{{00AD}}\\x{{202A}}-\\x{{202E}}]|{JOINERS}|{LATE_MARK}"
AROUND_NUMBER = r"[\x{202A}\x{202B}\x{2066}-\x{2068}]([\p{N}\p{Zs}+()./-]*)[\x{202C}\x{2069}]"
EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,4}\.[A-Za-z]{2,24}"
LINK = r"(?:https?://|www\.)[A-Za-z0-9./_~%?&=#:@+-]*[A-Za-z0-9/_~=#&+-]"
PHONE = r"\+?[0-9][0-9 ().-]{5,18}[0-9]"
#: Every decimal digit of Unicode, from the rule that its category is Nd.
DIGITS = {c: str(unicodedata.digit(c)) for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Nd"}


def lit_pattern(p: str) -> Column:
    return F.lit(p)


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def words(text: Column) -> Column:
    """Lower-cased words: a letter or digit, then letters, marks, digits and + # . ' -."""
    return extract_all(F.lower(text), WORD)


def plain_tokens(text: Column) -> Column:
    """Lower-cased runs of letters, marks and digits."""
    return extract_all(F.lower(text), TOKEN)


def vocabulary_tokens(text: Column) -> Column:
    """Names such as c++, .net or ci/cd; a closing dot or slash is not part of one."""
    return F.filter(F.transform(extract_all(text, VOCAB), lambda t: F.regexp_replace(t, r"[./]+$", "")), lambda t: F.length(t) > 0)


def word_list_pattern(entries) -> str:
    """Alternation of whole words, longest first, for Java's regex: bounded by anything that is no letter, mark, digit or underscore."""
    return r"(?<![\p{L}\p{M}\p{N}_])(?:" + "|".join(sorted(map(re.escape, entries), key=len, reverse=True)) + r")(?![\p{L}\p{M}\p{N}_])"


def consuming_pattern(entries) -> str:
    """The same without lookarounds: the bound before a word is part of the match."""
    return r"(?:^|[^\p{L}\p{M}\p{N}_])(?:" + "|".join(sorted(map(re.escape, entries), key=len, reverse=True)) + r")(?:$|[^\p{L}\p{M}\p{N}_])"


def fold_digits(text: Column) -> Column:
    """Every decimal digit of any script as its ASCII digit."""
    return F.translate(text, "".join(DIGITS), "".join(DIGITS.values()))


def invisible_count(text: Column) -> Column:
    """How many hidden characters a text has."""
    bare = F.regexp_replace(text, AROUND_NUMBER, "$1")
    return F.length(bare) - F.length(F.regexp_replace(bare, HIDDEN, ""))


def smuggled(text: Column) -> Column:
    """What tag characters spell, as ASCII."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("[\\x{E0020}-\\x{E007E}]"), F.lit(0)), lambda c: F.char(F.conv(F.substring(F.hex(F.encode(c, "UTF-16BE")), -2, 2), 16, 10).cast("int"))), "")


def strip_hidden(text: Column) -> Column:
    return F.regexp_replace(text, STRIPPED, "")


def strip_controls(text: Column) -> Column:
    """Without C0 and C1 controls, but for line breaks and tabs."""
    return F.regexp_replace(text, "[\\x{00}-\\x{08}\\x{0B}\\x{0C}\\x{0E}-\\x{1F}\\x{7F}-\\x{9F}]", "")


def collapse(text: Column) -> Column:
    """No NUL; a run of blanks is a tab if it holds one, else a space; at most one blank line."""
    tabs = F.regexp_replace(F.regexp_replace(text, "\\x{00}", ""), "[ \\t]*\\t[ \\t]*", "\t")
    return F.regexp_replace(F.regexp_replace(tabs, " {2,}", " "), "\\n{3,}", "\n\n")


def quote(text: Column, limit: int = 80) -> Column:
    """One line of at most ``limit`` characters; a longer one is cut at a word's end and marked."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, limit - 1), r"\s+\S*$", ""), F.lit("…")))


def cut(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit)


def rounded(x: Column) -> Column:
    """Half up, for any sign."""
    return F.floor(x + F.lit(0.5))


def stem(word: Column, rules) -> Column:
    """The first rule that fits a word takes its suffix off."""
    out = None
    for suffix, put, least, unless in rules:
        test = F.endswith(word, F.lit(suffix)) & (F.length(word) >= least)
        if unless:
            test &= ~F.endswith(word, F.lit(unless))
        value = F.concat(F.substring(word, F.lit(1), F.length(word) - len(suffix)), F.lit(put))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(word)


def unbullet(line: Column) -> Column:
    return F.regexp_replace(line, BULLET, "")


def unmark(line: Column) -> Column:
    """A line without Markdown: heading marks, rules, paired emphasis and link targets."""
    steps = ((r"^\s{0,3}#{1,6}\s+", ""), (r"^\s*([-*_])(\s*\1){2,}\s*$", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"__([^_]+)__", "$1"), (r"\[([^\]]+)\]\(([^)\s]+)\)", "$1"))
    return reduce(lambda c, s: F.regexp_replace(c, *s), steps, line)


def template(pattern: str, **values: Column) -> Column:
    """{k} is a value; {k|one|other} chooses by whether it is 1."""
    parts = []
    for text, key, one, other in re.findall(r"([^{]*)(?:\{(\w+)(?:\|([^|}]*)\|([^}]*))?\})?", pattern):
        if text:
            parts.append(F.lit(text))
        if key:
            parts.append(F.when(values[key] == 1, one).otherwise(other) if one or other else values[key].cast("string"))
    return F.concat(*parts) if parts else F.lit("")


@F.pandas_udf(StringType())
def normalize(text: pd.Series) -> pd.Series:
    """NFKC, one kind of line break, ASCII digits, no invisible characters. Vectorised Python: Spark has no normalisation of its own."""
    table = str.maketrans(DIGITS)
    hidden = regex.compile("[\u200b\u2060-\u2064\u2066-\u2069\U000e0000-\U000e007f\u00ad\u202a-\u202e]|(?<=\\p{Latin})[\u200c\u200d]+(?=\\p{Latin})|(?<!^)\ufeff")
    breaks = re.compile("\r\n?|[  \x85\v\f]")
    return text.map(lambda t: None if t is None else hidden.sub("", unicodedata.normalize("NFKC", breaks.sub("\n", t)).translate(table)))


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """For comparing: NFKD without marks, plain dashes and quotes, lower case, single spaces."""
    plain = str.maketrans({"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "’": "'", "‘": "'", "“": '"', "”": '"'})
    return text.map(lambda t: None if t is None else " ".join("".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).translate(plain).lower().split()))


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes of a text file: by its byte-order mark, else UTF-8, else Windows-1252."""
    return content.map(lambda b: None if b is None else decode_bytes(bytes(b)))


def decode_bytes(data: bytes) -> str:
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    # stray bytes among proper characters are Windows-1252 one by one; more strays than characters: all of it is
    lenient = data.decode("utf-8", "surrogateescape")
    stray = sum(0xDC80 <= ord(c) <= 0xDCFF for c in lenient)
    proper = sum(ord(c) > 0x7F for c in lenient) - stray
    one = lambda b: bytes([b]).decode("cp1252", "replace")
    if stray > proper:
        return "".join(map(one, data))
    return "".join(one(ord(c) - 0xDC00) if 0xDC80 <= ord(c) <= 0xDCFF else c for c in lenient)


