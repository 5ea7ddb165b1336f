"""Which language a text is in, and which region's rules apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..policy import vocabulary as V

SAMPLE = 20_000


def hits(docs: DataFrame, words=V.DETECTION, sample: int | None = SAMPLE) -> DataFrame:
    """doc_id, lang, hits, kinds, total: a language's own words among the first 20,000 characters (sample None: all). The word lists are broadcast."""
    text = F.col("text") if sample is None else F.substring("text", 1, sample)
    rows = docs.select("doc_id", F.explode(T.plain_tokens(text)).alias("word"))
    total = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
    lists = F.broadcast(V.pairs_table(docs.sparkSession, [(w, k) for k, ws in words.items() for w in ws], "word string, lang string"))
    found = rows.join(lists, "word").groupBy("doc_id", "lang").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("word").alias("kinds"))
    return found.join(total, "doc_id")


def detect(docs: DataFrame, kinds: int = 3, share: float = 0.03, sample: int | None = SAMPLE) -> DataFrame:
    """doc_id, detected: the language with most hits among those with three different words and 3 % of all words."""
    ok = hits(docs, sample=sample).filter((F.col("kinds") >= kinds) & (F.col("hits") >= share * F.col("total")))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("hits"), "lang"))
    return ok.withColumn("r", rank).filter("r = 1").select("doc_id", F.col("lang").alias("detected"))


def in_script(text: Column, pattern: str) -> Column:
    """At least 20 letters of a script, and 15 % of all letters."""
    own, every = F.regexp_count(text, F.lit(pattern)), F.regexp_count(text, F.lit(r"\p{L}"))
    return (own >= 20) & (own >= 0.15 * every)


def date_order(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, date_order: DMY or MDY where full dates with a part above 12 agree, else null."""
    found = rows.select(key, F.explode(T.extract_all(F.col("text"), r"\b[0-9]{1,2}[/.][0-9]{1,2}[/.](?:19|20)?[0-9]{2}\b")).alias("d"))
    a, b = (F.regexp_extract("d", r"^([0-9]{1,2})[/.]([0-9]{1,2})", k).cast("int") for k in (1, 2))
    votes = found.groupBy(key).agg(F.count_if((a > 12) & (b <= 12)).alias("dmy"), F.count_if((b > 12) & (a <= 12)).alias("mdy"))
    return votes.select(key, F.when(F.col("dmy") > F.col("mdy"), "DMY").when(F.col("mdy") > F.col("dmy"), "MDY").alias("date_order"))


def region(asked: Column, phone: Column, country: Column, default: str = "US") -> Column:
    """Asked for, else by the phone's calling code (the longest that fits), else by a country named, else the default."""
    digits = F.when(F.startswith(phone, F.lit("+")), F.regexp_replace(phone, "[^0-9]", ""))
    by_code = F.lit(None).cast("string")
    for name, code in sorted(V.REGIONS.items(), key=lambda x: (len(x[1]), x[0] != "US")):
        by_code = F.when(F.startswith(digits, F.lit(code)), F.lit(name)).otherwise(by_code)
    # the United States and Canada share a code: the default decides
    by_code = F.when(by_code == "CA", F.lit("US")).otherwise(by_code)
    return F.coalesce(asked, by_code, country, F.lit(default))
