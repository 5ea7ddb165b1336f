"""Signals of a document as a long table (doc_id, metric, value, sample); a signal that does not apply has no row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..policy import vocabulary as V
from . import roles
from . import segment as S

NUMBER = r"[$€£₹%]|[0-9]"
# Standards and products whose numbers are names.
STANDARDS = "iso|iec|soc|pci dss|nist|tier|level"
VERSIONED = "python|java|php|ruby|swift|kotlin|angular|vue|react|node|django|rails|\\.net|windows|macos|ios|android|ubuntu|rhel|office|excel|sql server|oracle|mysql|postgres|postgresql|html|css|http|tls|oauth|ipv"
#: Digits that are no figure, and what stays of them: dates (twice, since two years may share the sign between them), standards, versions, digits of a name.
_DATE = r"(^|[^0-9.,])(?:[0-9]{1,2} *[/.-] *)?(?:19|20)[0-9]{2}(?: *[/.-] *[0-9]{1,2})?([^0-9]|$)"
NAMES_OF_NUMBERS = (
    (_DATE, r"\1 \2"), (_DATE, r"\1 \2"), (rf"(^|[^\p{{L}}])(?:{STANDARDS}) {{1,2}}[0-9]+", r"\1"),
    (rf"(^|[^\p{{L}}])(?:{VERSIONED}) {{1,2}}[0-9]{{1,2}}(?:\.[0-9]+)*( *[^ 0-9\p{{L}}]| *$)", r"\1\2"), (r"(\p{L}\p{L}|[a-wyz])[0-9]+", r"\1"),
)
SPACED = r"^(?:\p{Lu} ){3,}\p{Lu}$"
HOMOGLYPH_LATIN, HOMOGLYPH_OTHER = r"[a-zA-Z]", r"[\x{0400}-\x{04FF}]"


def contains_any(text: Column, phrases) -> Column:
    """How many different phrases a text holds."""
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(p)).cast("int") for p in phrases])


def first_word(line: Column) -> Column:
    return F.get(T.words(line), F.lit(0))


def quantified(line: Column) -> Column:
    """Whether a line holds a figure: a currency or per cent sign, or a number that is no date, version, standard or part of a name."""
    bare = reduce(lambda t, step: F.regexp_replace(t, step[0], step[1].replace("\\", "$")), NAMES_OF_NUMBERS, F.lower(line))
    return F.when(F.regexp_like(line, F.lit("[0-9]")), F.regexp_like(bare, F.lit(NUMBER))).otherwise(F.regexp_like(line, F.lit(NUMBER)))


def passive(line: Column) -> Column:
    """A form of 'be', at most one adverb, then a participle."""
    aux, parts = "|".join(V.AUXILIARIES), "|".join(V.PARTICIPLES)
    return F.regexp_like(F.lower(line), F.lit(rf"(?:^|[^\p{{L}}])(?:{aux}) (?:\p{{L}}+ly )?(?:{parts}|\p{{L}}{{3,}}ed)(?:$|[^\p{{L}}])"))


def homoglyph_words(text: Column) -> Column:
    """Words of at least three letters that mix Latin with Cyrillic."""
    return F.filter(T.extract_all(text, r"\p{L}{3,}"), lambda w: F.regexp_like(w, F.lit(HOMOGLYPH_LATIN)) & F.regexp_like(w, F.lit(HOMOGLYPH_OTHER)))


def injections(text: Column) -> Column:
    low = F.lower(text)
    return reduce(lambda a, b: a + b, [F.regexp_count(low, F.lit(p)) for p in V.INJECTION])


def document_metrics(docs: DataFrame) -> DataFrame:
    """One row a document: signals that need no lines."""
    t = F.col("text")
    email = F.length(F.regexp_extract(t, T.EMAIL, 0)) > 0
    phone = F.length(F.regexp_extract(t, T.PHONE, 0)) > 0
    at_email, at_phone = F.when(email, F.locate("@", t)), F.when(phone, F.instr(t, F.regexp_extract(t, T.PHONE, 0)))
    n = F.size(T.words(t))
    return docs.select(
        "doc_id", n.cast("double").alias("wordCount"), n.cast("double").alias("readableWords"), contains_any(t, V.BUZZWORDS).cast("double").alias("buzzwordCount"),
        T.invisible_count(t).cast("double").alias("invisibleCharacters"), F.size(homoglyph_words(t)).cast("double").alias("homoglyphWords"), injections(t).cast("double").alias("injectionPhrases"),
        email.cast("double").alias("emailPresent"), F.round((email.cast("double") + phone.cast("double")) / 3, 6).alias("contactCompleteness"),
        roles.birth_stated(t).cast("double").alias("dateOfBirthStated"),
        F.when(email | phone, F.round(F.least(F.coalesce(at_email, at_phone), F.coalesce(at_phone, at_email)) / F.length(t), 6)).alias("contactPosition"),
    )


def line_metrics(rows: DataFrame) -> DataFrame:
    """One row a document: signals counted over its lines, each in one aggregation."""
    line = F.col("line")
    n = S.word_count(line)
    content = n >= 4
    head = F.slice(T.words(line), 1, 3)
    low = F.lower(line)
    pronoun = F.size(F.array_intersect(T.words(line), F.array(*[F.lit(w) for w in V.PRONOUNS]))) > 0
    weak = reduce(lambda a, b: a | b, [F.startswith(low, F.lit(p)) for p in V.WEAK])
    kind = S.heading_kind(line)
    ratio = lambda test: F.when(F.count_if(content) > 0, F.round(F.count_if(content & test) / F.count_if(content), 6))
    return rows.groupBy("doc_id").agg(
        ratio(quantified(line)).alias("metricsRatio"), ratio(F.arrays_overlap(head, F.array(*[F.lit(w) for w in V.VERBS]))).alias("actionVerbRatio"), ratio(passive(line)).alias("passiveVoiceRatio"),
        F.count_if(F.regexp_like(line, F.lit(SPACED))).cast("double").alias("letterSpacedLines"), F.count_if(pronoun).cast("double").alias("firstPersonLines"),
        F.count_if(weak).cast("double").alias("weakOpeners"), F.count_if(n > 40).cast("double").alias("longBullets"),
        *[F.max((F.coalesce(kind, F.lit("")) == k).cast("double")).alias(f"{k}Heading") for k in ("experience", "education", "skills")],
    )


def repeated_openers(rows: DataFrame, run: int = 3) -> DataFrame:
    """doc_id, runs: how often ``run`` lines in a row open with one word; a longer run counts once."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    opened = rows.select("doc_id", "line_no", first_word(F.col("line")).alias("w")).filter("w IS NOT NULL")
    new = opened.withColumn("new", F.coalesce((F.lag("w").over(order) != F.col("w")).cast("int"), F.lit(1)))
    island = new.withColumn("island", F.sum("new").over(order))
    return island.groupBy("doc_id", "island").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.count_if(F.col("n") >= run).cast("double").alias("repeatedOpeners"))


def token_counts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.select(key, F.explode(T.plain_tokens(F.col("text"))).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))


def stuffed(docs: DataFrame, least: int = 15, share: float = 0.05) -> DataFrame:
    """doc_id, token, n: words other than stopwords used at least 15 times and for 5 % of all words."""
    counts = token_counts(docs).withColumn("total", F.sum("n").over(Window.partitionBy("doc_id")))
    stop = F.broadcast(V.words_table(docs.sparkSession, V.STOPWORDS, "token"))
    return counts.join(stop, "token", "left_anti").filter((F.col("n") >= least) & (F.col("n") >= share * F.col("total")) & (F.length("token") > 2)).select("doc_id", "token", "n")


def repeated_lines(rows: DataFrame, least: int = 3) -> DataFrame:
    """Lines that stand at least three times in one document."""
    return rows.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def containment(docs: DataFrame, postings: DataFrame, n: int = 8, least_words: int = 24, own: bool = False) -> DataFrame:
    """doc_id, item_id, shared, total, ratio: how much of a posting's runs of n words a document holds; only pairs with a common run.

    With ``own`` a posting is held against the document of its own id alone: the id is a part of the join."""

    def runs(df: DataFrame, key: str, least: int) -> DataFrame:
        t = df.select(key, T.plain_tokens(F.col("text")).alias("w")).filter(F.size("w") >= least)
        return t.select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")))).alias("run"))

    asked = runs(postings, "item_id", least_words)
    total = asked.groupBy("item_id").agg(F.count(F.lit(1)).alias("total"))
    said = runs(docs, "doc_id", n)
    met = said.withColumn("item_id", F.col("doc_id")).join(asked, ["item_id", "run"]) if own else said.join(asked, "run")
    held = met.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))
    return held.join(total, "item_id").select("doc_id", "item_id", "shared", "total", F.round(F.col("shared") / F.col("total"), 6).alias("ratio"))


def findings(docs: DataFrame) -> DataFrame:
    """doc_id, metric, value: all signals that a text alone gives."""
    rows = S.lines(docs)
    wide = document_metrics(docs).join(line_metrics(rows), "doc_id", "left").join(repeated_openers(rows), "doc_id", "left")
    wide = wide.join(roles.bullets_per_role(rows), "doc_id", "left").join(roles.tense_mismatches(rows), "doc_id", "left").join(roles.date_formats(rows), "doc_id", "left")
    wide = wide.join(stuffed(docs).groupBy("doc_id").agg(F.count(F.lit(1)).cast("double").alias("stuffed")), "doc_id", "left").withColumn("stuffedTerms", F.coalesce("stuffed", F.lit(0.0))).drop("stuffed")
    names = [c for c in wide.columns if c != "doc_id"]
    return wide.unpivot("doc_id", names, "metric", "value").filter("value IS NOT NULL")


def unsupported_skills(listed: DataFrame, elsewhere: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, ratio: the share of listed skills that the rest of the document never names; lists of fewer than three do not count."""
    missing = listed.join(elsewhere, ["doc_id", "skill"], "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("missing"))
    total = listed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total")).filter(F.col("total") >= least)
    return total.join(missing, "doc_id", "left").select("doc_id", F.round(F.coalesce("missing", F.lit(0)) / F.col("total"), 6).alias("ratio"))
