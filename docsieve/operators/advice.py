"""Unscored advice about files, age and target systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: graduations so many years back are worth leaving out.
OLD_YEARS = 15
TARGETS = {"plain": "Reads plain paragraphs best; leave out tables.", "cloud": "Asks for each job again in a form; keep dates at hand."}


def item(test: Column, name: str, kind: str, message: str, evidence: Column | None = None) -> Column:
    return F.when(test, F.struct(F.lit(name).alias("id"), F.lit(kind).alias("kind"), F.lit(message).alias("message"), (evidence if evidence is not None else F.lit(None)).cast("string").alias("evidence")))


def listed(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def file_advice(files: DataFrame) -> DataFrame:
    """path, advice. files: path, length, and encrypted, tracked_changes, comments where known."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(
        "path",
        listed(
            item(F.regexp_like(name, F.lit(r"(?i)^(?:resume|cv|document|untitled|final)[ _-]?(?:\(?\d+\)?)?\.")), "file.name", "file", "Name the file after yourself.", name),
            item(F.regexp_like(name, F.lit(r"(?i)final|copy|v\d+|draft")), "file.version", "file", "Leave versions out of the file's name.", name),
            item(F.col("length") > 2 << 20, "file.size", "file", "Some forms refuse files over 2 MB.", F.col("length")),
            item(F.coalesce("encrypted", F.lit(False)), "file.password", "file", "Remove the password."),
            item(F.coalesce("tracked_changes", F.lit(0)) > 0, "file.changes", "file", "Accept or reject tracked changes.", F.col("tracked_changes")),
            item(F.coalesce("comments", F.lit(0)) > 0, "file.comments", "file", "Delete comments.", F.col("comments")),
        ).alias("advice"),
    )


def age_advice(records: DataFrame, now_year: int) -> DataFrame:
    """doc_id, advice: graduations longer ago than fifteen years, each year once."""
    years = F.array_sort(F.array_distinct(F.filter(F.transform("education", lambda e: e["end"]["year"]), lambda y: y < now_year - OLD_YEARS)))
    old = F.array_join(F.transform(years, lambda y: y.cast("string")), ", ")
    return records.select("doc_id", listed(item(F.size(years) > 0, "age.graduation", "age", "Old graduation years can be left out.", old), item(F.col("months_of_experience") > 12 * 25, "age.career", "age", "The last fifteen years say most.", F.col("months_of_experience"))).alias("advice"))


def target_note(target: str) -> str:
    if target not in TARGETS:
        raise ValueError(f"unknown target {target!r}: {', '.join(TARGETS)}")
    return TARGETS[target]
