"""From findings and rules to results, scores, categories, fixes and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import rounded
from ..policy import rules as R


def results(findings: DataFrame, rules: DataFrame, bands: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """doc_id and rule columns with value, weight lost and passed; a rule without a finding gives no row.

    Rules and bands are the policy (a row a band), which is broadcast; the band is the one with lo < value <= hi.
    languages: doc_id, lang; a rule for one language only applies to documents in it."""
    applied = findings.join(F.broadcast(rules), "metric")
    if languages is not None:
        applied = applied.join(languages, "doc_id", "left").filter("languages = '' OR languages = lang").drop("lang")
    banded = applied.join(F.broadcast(bands), "rule_id").filter("lo < value AND value <= hi")
    return banded.select("doc_id", "ord", "rule_id", "category", "severity", "penalty", "max_weight", "value", F.col("weight").alias("lost"), (F.col("weight") == 0).alias("passed"))


def readiness(rows: DataFrame) -> DataFrame:
    """doc_id, readiness, quality, penalty, lost, possible, checks: the share of the weight kept, less the penalties."""
    lost = F.sum(F.when(~F.col("penalty"), F.col("lost")).otherwise(0.0))
    possible = F.sum(F.when(~F.col("penalty"), F.col("max_weight")).otherwise(0.0))
    taken = F.sum(F.when(F.col("penalty"), F.col("lost")).otherwise(0.0))
    out = rows.groupBy("doc_id").agg(
        lost.alias("lost"), possible.alias("possible"), taken.alias("penalty"), F.count_if("passed").alias("checks_passed"), F.count(F.lit(1)).alias("checks_total"),
        F.bool_or((F.col("category") == "integrity") & (F.col("severity") == "error") & ~F.col("passed")).alias("caught"),
    )
    quality = F.when(F.col("possible") > 0, rounded((1 - F.col("lost") / F.col("possible")) * 100)).otherwise(100)
    return out.withColumn("quality", quality.cast("long")).withColumn("readiness", F.greatest(F.lit(0.0), F.col("quality") - F.col("penalty")).cast("long"))


def verdict(score: Column) -> Column:
    return F.when(score >= R.STRONG, "strong").when(score >= R.NEEDS_WORK, "needs-work").otherwise("weak")


def primary(readiness_score: Column, match: Column, caught: Column) -> Column:
    """The score that decides: the match where there is one, held to readiness for documents caught gaming."""
    return F.when(match.isNull(), readiness_score).when(caught, F.least(match, readiness_score)).otherwise(match)


def categories(rows: DataFrame) -> DataFrame:
    """doc_id, category, score, passed, total, lost, possible; a category without weight is 100 or, with a failure, 0."""
    out = rows.groupBy("doc_id", "category").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"), F.sum("lost").alias("lost"), F.sum("max_weight").alias("possible"))
    score = F.when(F.col("possible") > 0, F.greatest(F.lit(0), rounded((1 - F.col("lost") / F.col("possible")) * 100))).when(F.col("passed") == F.col("total"), 100).otherwise(0)
    return out.select("doc_id", "category", score.cast("long").alias("score"), "passed", "total", rounded(F.col("lost")).cast("long").alias("lost"), rounded(F.col("possible")).cast("long").alias("possible"))


def top(rows: DataFrame, by: str, n: int) -> DataFrame:
    """The n largest of a document, ties in policy order."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(by), "ord"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("long"))


def strengths(rows: DataFrame, n: int = 5) -> DataFrame:
    return top(rows.filter("passed AND NOT penalty AND max_weight > 0"), "max_weight", n).select("doc_id", "rank", "rule_id", "max_weight")


def fixes(rows: DataFrame, n: int = 6) -> DataFrame:
    advice = F.create_map(*[x for k, v in R.FIXES.items() for x in (F.lit(k), F.lit(v))])
    return top(rows.filter("NOT passed"), "lost", n).select("doc_id", "rank", "rule_id", "lost", advice[F.col("category")].alias("fix"))


def restricted(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """What a report shows without its detail: scores, how many checks failed, and the category of the costliest failure."""
    order = F.create_map(*[x for i, c in enumerate(R.CATEGORY_ORDER) for x in (F.lit(c), F.lit(-i))])
    worst = rows.filter("NOT passed").groupBy("doc_id").agg(F.count(F.lit(1)).alias("failed"), F.max(F.struct("lost", order[F.col("category")].alias("place"), "category"))["category"].alias("warning"))
    return scores.select("doc_id", "readiness").join(worst, "doc_id", "left").select("doc_id", "readiness", F.coalesce("failed", F.lit(0)).alias("failed"), "warning")


def regional(rules: DataFrame, changes: DataFrame, regions: list[str]) -> DataFrame:
    """Rules of each region: a weight of 0 drops a rule, another replaces its own, a severity replaces its own."""
    every = rules.withColumn("region", F.explode(F.array(*[F.lit(r) for r in regions])))
    out = every.join(F.broadcast(changes.withColumnsRenamed({"weight": "new_weight", "severity": "new_severity"})), ["region", "rule_id"], "left")
    return out.filter("new_weight IS NULL OR new_weight > 0").select("region", "ord", "rule_id", F.coalesce("new_severity", "severity").alias("severity"), F.coalesce("new_weight", "max_weight").alias("max_weight"))
