"""The report plan: documents in, scores with their evidence out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import durable
from ..functions import dates as D
from ..operators import extract, findings, locale, roles, scoring
from ..operators import segment as S
from ..policy import rules as R


def scored(docs: DataFrame, extra: DataFrame | None = None, rules: list | None = None, languages: DataFrame | None = None) -> DataFrame:
    """Rule results of documents (doc_id, text). extra: more findings (doc_id, metric, value), such as layout signals."""
    spark = docs.sparkSession
    found = findings.findings(docs)
    if extra is not None:
        found = found.unionByName(extra)
    return scoring.results(found, R.rules_table(spark, rules), R.bands_table(spark, rules), languages)


def timeline(records: DataFrame, now_month: int) -> DataFrame:
    """doc_id, metric, value: timelineIssues of records with a dated role. A role without an end that does not go on is its start's month; an end without a month is January, so that years meeting are no overlap."""
    r = F.col("r")
    start = D.month_index(r["start"]["year"], r["start"]["month"], 1)
    end = F.when(r["current"], F.lit(now_month)).otherwise(F.coalesce(D.month_index(r["end"]["year"], r["end"]["month"], 1), start))
    dated = records.select("doc_id", "months_of_experience", F.explode("roles").alias("r")).select("doc_id", "months_of_experience", start.alias("start"), end.alias("end")).filter("start IS NOT NULL")
    experience = dated.groupBy("doc_id").agg(F.max("months_of_experience").alias("months"))
    issues = roles.timeline_issues(dated, now_month, experience=experience)
    return issues.select("doc_id", F.lit("timelineIssues").alias("metric"), F.col("timelineIssues").alias("value"))


def skill_evidence(docs: DataFrame, records: DataFrame, least: int = 3) -> DataFrame:
    """doc_id, metric, value: unsupportedSkills, the share of listed skills that no line outside the skills names as whole words; lists of fewer than three, and documents of skills alone, do not count."""
    other = S.sections(S.lines(docs)).filter("heading IS NULL AND section <> 'skills'").groupBy("doc_id").agg(F.lower(F.array_join(F.collect_list("line"), "\n")).alias("other"))
    listed = records.filter(F.size("skills") >= least).select("doc_id", F.transform("skills", F.lower).alias("skills")).join(other, "doc_id")

    def named(skill):
        whole = F.concat(F.lit(r"(?<![\p{L}\p{N}])"), F.regexp_replace(skill, r"([^\p{L}\p{N}\s])", r"\\$1"), F.lit(r"(?![\p{L}\p{N}])"))
        return F.contains(F.col("other"), skill) & F.regexp_like("other", whole)

    missing = F.size(F.filter("skills", lambda skill: ~named(skill)))
    return listed.select("doc_id", F.lit("unsupportedSkills").alias("metric"), F.round(missing / F.size("skills"), 6).alias("value"))


def check(docs: DataFrame, postings: DataFrame | None = None, now_year: int = 2026, layout: DataFrame | None = None) -> DataFrame:
    """The whole report, a row a document: readiness, verdict, category scores, fixes, strengths, the parsed record and, with postings (doc_id, posting), the match.

    The reference date is an argument: the same documents, policy and date give the same report. Records, languages and rule
    results are held as tables, since several parts read each."""
    from . import job

    records = durable.held(extract.records(docs, now_year), "records")
    quality = extract.quality(records)
    parsed = quality.select("doc_id", F.col("roles_detected").cast("double").alias("rolesDetected"), F.col("role_completeness").alias("roleCompleteness"))
    extra = parsed.unpivot("doc_id", ["rolesDetected", "roleCompleteness"], "metric", "value").filter("value IS NOT NULL")
    extra = extra.unionByName(timeline(records, now_year * 12 + 11)).unionByName(skill_evidence(docs, records))
    if layout is not None:
        names = [c for c in layout.columns if c != "doc_id"]
        extra = extra.unionByName(layout.select("doc_id", *[F.col(c).cast("double") for c in names]).unpivot("doc_id", names, "metric", "value").filter("value IS NOT NULL"))
    if postings is not None:
        held = findings.containment(docs, postings.select(F.col("doc_id").alias("item_id"), F.col("posting").alias("text")), own=True)
        extra = extra.unionByName(held.select("doc_id", F.lit("copiedPostingRatio").alias("metric"), F.col("ratio").alias("value")))
    spoken = durable.held(locale.detect(docs, sample=None).select("doc_id", F.col("detected").alias("lang")), "languages")
    results = durable.held(scored(docs, extra, languages=spoken), "results")
    scores = scoring.readiness(results)
    by = F.struct("category", "score", "passed", "total", "lost", "possible")
    grouped = scoring.categories(results).groupBy("doc_id").agg(F.array_sort(F.collect_list(by)).alias("categories"))
    fixes = scoring.fixes(results).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "rule_id", "fix"))).alias("fixes"))
    strong = scoring.strengths(results).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "rule_id"))).alias("strengths"))
    out = scores.join(grouped, "doc_id", "left").join(fixes, "doc_id", "left").join(strong, "doc_id", "left").join(spoken, "doc_id", "left").join(records, "doc_id", "left")
    match = F.lit(None).cast("long")
    if postings is not None:
        out = out.join(job.match(docs, postings).select("doc_id", F.col("score").alias("match")), "doc_id", "left")
        match = F.when(F.col("caught"), F.least("match", "readiness")).otherwise(F.col("match"))
    return out.withColumn("job_match", match).withColumn("verdict", scoring.verdict(scoring.primary(F.col("readiness"), F.col("job_match"), F.col("caught"))))
