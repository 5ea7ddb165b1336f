"""Word columns with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of ASCII letters and digits and of any character beyond ASCII, in a lower-cased text: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+,
#: written as what it holds, since Java takes ten times as long over the negated ranges.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A character beyond ASCII that lower() may change: lower() knows capitals that Java's tables do not have yet (Cn). The range stands first, so ASCII fails it soonest.
_CASED = r"[\x{80}-\x{10FFFF}&&[\p{javaUpperCase}\p{javaTitleCase}\p{Cn}]]"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else as it is. lower() does that soonest where no other character has a lower case."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(~ascii_only & F.regexp_like(text, F.lit(_CASED)), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
