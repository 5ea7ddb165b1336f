"""Judging a posting's requirements one by one against a document's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates as D
from . import extract, matching
from . import segment as S

RANKS = {"missing": 0, "partial": 1, "met": 2}
CLEARANCE = ("public trust", "confidential", "secret", "top secret")
SENIORITY = {"intern": 0, "junior": 0, "senior": 5, "lead": 5, "principal": 8, "director": 8, "head": 8}


def rank(status: Column) -> Column:
    return F.create_map(*[x for k, v in RANKS.items() for x in (F.lit(k), F.lit(v))])[status]


def status(rank_: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in RANKS]), rank_ + 1)


def weaker(a: Column, b: Column) -> Column:
    return status(F.least(rank(a), rank(b)))


def stronger(a: Column, b: Column) -> Column:
    return status(F.greatest(rank(a), rank(b)))


def lattice(rows: DataFrame, key: str) -> DataFrame:
    """The weakest and the strongest status of a key."""
    return rows.groupBy(key).agg(status(F.min(rank(F.col("status")))).alias("weaker"), status(F.max(rank(F.col("status")))).alias("stronger"))


def kind(line: Column) -> Column:
    """What a line asks for, the first that fits."""
    low = F.lower(line)
    languages = "|".join(extract.LANGUAGES)
    return (
        F.when(F.regexp_like(low, F.lit(r"authori[sz]ed to work|work permit|right to work|citizen|visa")), "authorization")
        .when(F.regexp_like(low, F.lit("clearance")), "clearance")
        .when(F.regexp_like(low, F.lit(rf"(?:^|[^a-z])(?:{languages})(?:$|[^a-z])")), "language")
        .when(extract.degree_level(line).isNotNull(), "degree")
        .when(D.years_asked(line).isNotNull(), "years")
        .when(F.regexp_like(low, F.lit(rf"(?:^|[^a-z])(?:{'|'.join(SENIORITY)})(?:$|[^a-z])")), "seniority")
        .otherwise("skill")
    )


def clearance_rank(line: Column) -> Column:
    """The highest level named near the word, from 1; 0 without one."""
    low = F.lower(line)
    out = F.lit(0)
    for i, name in enumerate(CLEARANCE, 1):
        out = F.when(F.contains(low, F.lit(name)), F.lit(i)).otherwise(out)
    return F.when(F.contains(low, F.lit("clearance")), out).otherwise(0)


def judge(docs: DataFrame, postings: DataFrame, key: str = "doc_id", n_evidence: int = 2) -> DataFrame:
    """key, req_no, importance, kind, text, status, terms, found, evidence: a row a requirement (25 a posting at most).

    A skill line is met when all its terms are held, partial when some are; degrees and clearances compare levels, years
    the longest stretch that the document states, languages their level; rights to work are as the document states them.
    Terms meet in equi-joins; only a posting's own requirements meet its own document."""
    asked = S.requirement_lines(S.lines(postings, key), key).withColumn("kind", kind(F.col("text")))
    held_lines = S.lines(docs, key)
    facts = held_lines.groupBy(key).agg(
        F.max(extract.degree_level(F.col("line"))).alias("level"), F.max(D.years_asked(F.col("line"))).alias("years"), F.max(clearance_rank(F.col("line"))).alias("cleared"),
        F.bool_or(F.regexp_like(F.lower("line"), F.lit("authori[sz]ed to work|citizen|right to work|permanent resident"))).alias("may_work"),
        F.bool_or(F.regexp_like(F.lower("line"), F.lit("(?:need|require)s? (?:a )?(?:visa|sponsorship)"))).alias("may_not"),
    )
    named = asked.withColumn("req", F.struct(key, "req_no"))
    terms = matching.terms(named.select("req", "text"), "req").select(F.col(f"req.{key}").alias(key), F.col("req.req_no").alias("req_no"), "token")
    line_terms = matching.implied(matching.terms(held_lines.select(F.struct(key, "line_no", "line").alias("at"), F.col("line").alias("text")), "at"), "at")
    line_terms = line_terms.select(F.col(f"at.{key}").alias(key), F.col("at.line_no").alias("line_no"), F.col("at.line").alias("line"), "token")
    hits = terms.join(line_terms, [key, "token"], "left")
    first = F.row_number().over(Window.partitionBy(key, "req_no").orderBy("line_no"))
    evidence = hits.filter("line_no IS NOT NULL").select(key, "req_no", "line_no", "line").distinct().withColumn("r", first).filter(F.col("r") <= n_evidence)
    evidence = evidence.groupBy(key, "req_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.substring(x["line"], 1, 160)).alias("evidence"))
    counted = hits.groupBy(key, "req_no", "token").agg(F.bool_or(F.col("line_no").isNotNull()).alias("found")).groupBy(key, "req_no").agg(F.count(F.lit(1)).alias("terms"), F.count_if("found").alias("found"))
    rows = asked.join(facts, key, "left").join(counted, [key, "req_no"], "left").join(evidence, [key, "req_no"], "left")
    text = F.col("text")
    by_terms = F.when(F.col("terms").isNull() | (F.col("found") == 0), "missing").when(F.col("found") == F.col("terms"), "met").otherwise("partial")
    level, years, clear = extract.degree_level(text), D.years_asked(text), clearance_rank(text)
    verdict = (
        F.when(F.col("kind") == "authorization", F.when(F.col("may_not"), "missing").when(F.col("may_work"), "met").otherwise("unverifiable"))
        .when(F.col("kind") == "clearance", F.when(F.col("cleared") == 0, "unverifiable").when(F.col("cleared") >= clear, "met").otherwise("partial"))
        .when(F.col("kind") == "degree", F.when(F.col("level") >= level, "met").when(F.col("level").isNotNull() | (F.col("years") >= 2), "partial").otherwise("missing"))
        .when(F.col("kind") == "years", F.when(F.col("years") >= years, weaker(F.lit("met"), by_terms)).when(F.col("years").isNotNull(), "partial").otherwise("missing"))
        .otherwise(by_terms)
    )
    return rows.select(key, "req_no", "importance", "kind", "text", F.coalesce(verdict, F.lit("missing")).alias("status"), F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))


def cefr_status(held: Column, asked: Column) -> Column:
    """Of two levels of a language: met, partial when one step short, missing when more."""
    gap = extract.cefr_rank(asked) - extract.cefr_rank(held)
    return F.when(held.isNull(), "missing").when(gap <= 0, "met").when(gap == 1, "partial").otherwise("missing")


