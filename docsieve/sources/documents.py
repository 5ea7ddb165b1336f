"""Structured documents and JSON resumes as rows, and their text."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How much of a document is read.
MAX_TEXT, MAX_POSTING, MAX_DEPTH, MAX_NODES, CHUNK = 50_000, 20_000, 24, 200_000, 100_000
DOCUMENT = (
    "version string, basics struct<name:string,email:string,phone:string,links:array<string>,summary:string>, "
    "sections array<struct<kind:string,heading:string,items:array<struct<title:string,organisation:string,start:string,end:string,lines:array<string>,keywords:array<string>>>>>"
)
WORK = "array<struct<name:string,position:string,startDate:string,endDate:string,summary:string,highlights:array<string>>>"
JSON_RESUME = (
    f"basics struct<name:string,email:string,phone:string,url:string,summary:string>, work {WORK}, volunteer array<struct<organization:string,position:string,startDate:string,endDate:string,summary:string,highlights:array<string>>>, "
    "education array<struct<institution:string,area:string,studyType:string,startDate:string,endDate:string>>, skills array<struct<name:string,keywords:array<string>>>, languages array<struct<language:string,fluency:string>>, "
    "certificates array<struct<name:string,issuer:string,date:string>>, projects array<struct<name:string,description:string,highlights:array<string>>>, awards array<struct<title:string,awarder:string,date:string>>, "
    "publications array<struct<name:string,publisher:string,releaseDate:string>>, interests array<struct<name:string>>, references array<struct<name:string,reference:string>>"
)
# Limits of a structured document; longer lists are rejected.
LIMITS = {"sections": 40, "items": 200, "lines": 100, "keywords": 200, "links": 50}


def present(x: Column) -> Column:
    return x.isNotNull() & (F.trim(x) != "")


def joined(separator: str, *parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*parts), present), separator)


def render(name: Column, sections: Column, contact: Column | None = None) -> Column:
    """Text of a document: name, contact, then headings with "- " lines; a section without lines has no heading. sections: array of (heading, lines)."""
    full = F.filter(sections, lambda s: F.size(s["lines"]) > 0)
    block = F.transform(full, lambda s: F.concat(s["heading"], F.lit("\n"), F.array_join(F.transform(s["lines"], lambda x: F.concat(F.lit("- "), x)), "\n")))
    top = F.array(name, contact) if contact is not None else F.array(name)
    return F.array_join(F.filter(F.concat(top, block), present), "\n")


def read_documents(rows: DataFrame, column: str = "json", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Structured documents (key, text, document) and rejects (key, reason): other versions, and lists past their limits."""
    doc = rows.select(key, F.from_json(column, DOCUMENT).alias("d"))
    sections = F.col("d.sections")
    over = (
        (F.size(sections) > LIMITS["sections"]) | (F.size("d.basics.links") > LIMITS["links"])
        | F.exists(sections, lambda s: (F.size(s["items"]) > LIMITS["items"]) | F.exists(s["items"], lambda i: (F.size(i["lines"]) > LIMITS["lines"]) | (F.size(i["keywords"]) > LIMITS["keywords"])))
    )
    reason = F.when(F.col("d").isNull(), "not a document").when(~F.coalesce(F.regexp_like("d.version", F.lit("@1$")), F.lit(False)), "version").when(F.coalesce(over, F.lit(False)), "too long")
    judged = doc.withColumn("reason", reason)

    def lines(s: Column) -> Column:
        return F.flatten(F.transform(s["items"], lambda i: F.concat(F.filter(F.array(joined(", ", i["title"], i["organisation"], joined(" - ", i["start"], i["end"])), F.array_join(i["keywords"], ", ")), present), F.coalesce(i["lines"], F.array().cast("array<string>")))))

    parts = F.transform(sections, lambda s: F.struct(F.coalesce(s["heading"], F.initcap(s["kind"])).alias("heading"), lines(s).alias("lines")))
    contact = joined(" | ", F.col("d.basics.email"), F.col("d.basics.phone"), F.array_join("d.basics.links", " | "))
    good = judged.filter("reason IS NULL").select(key, render(F.col("d.basics.name"), parts, contact).alias("text"), F.col("d").alias("document"))
    return good, judged.filter("reason IS NOT NULL").select(key, "reason")


def is_json_resume(column: str = "json") -> Column:
    """Whether a JSON object has the shape: basics or work, and no version of ours."""
    found = F.json_object_keys(column)
    return F.coalesce(F.arrays_overlap(found, F.array(F.lit("basics"), F.lit("work"))) & ~F.array_contains(found, F.lit("version")), F.lit(False))


def read_json_resumes(rows: DataFrame, column: str = "json", key: str = "doc_id") -> DataFrame:
    """key, text: JSON resumes, their sections in reading order."""
    r = rows.filter(is_json_resume(column)).select(key, F.from_json(column, JSON_RESUME).alias("r"))
    none = F.array().cast("array<string>")

    def section(heading: str, items: Column, line, more=None) -> Column:
        lines = F.transform(items, lambda i: F.concat(F.array(line(i)), F.coalesce(more(i), none) if more else none))
        return F.struct(F.lit(heading).alias("heading"), F.filter(F.coalesce(F.flatten(lines), none), present).alias("lines"))

    dates = lambda i: joined(" - ", i["startDate"], F.when(i["startDate"].isNotNull() & i["endDate"].isNull(), "Present").otherwise(i["endDate"]))
    parts = F.array(
        section("Experience", F.col("r.work"), lambda i: joined(", ", i["position"], i["name"], dates(i)), lambda i: F.concat(F.array(i["summary"]), F.coalesce(i["highlights"], none))),
        section("Volunteering", F.col("r.volunteer"), lambda i: joined(", ", i["position"], i["organization"], dates(i)), lambda i: F.concat(F.array(i["summary"]), F.coalesce(i["highlights"], none))),
        section("Education", F.col("r.education"), lambda i: joined(", ", i["studyType"], i["area"], i["institution"], joined(" - ", i["startDate"], i["endDate"]))),
        section("Projects", F.col("r.projects"), lambda i: joined(": ", i["name"], i["description"]), lambda i: i["highlights"]),
        section("Skills", F.col("r.skills"), lambda i: joined(": ", i["name"], F.array_join(i["keywords"], ", "))),
        section("Certifications", F.col("r.certificates"), lambda i: joined(", ", i["name"], i["issuer"], i["date"])),
        section("Awards", F.col("r.awards"), lambda i: joined(", ", i["title"], i["awarder"], i["date"])),
        section("Publications", F.col("r.publications"), lambda i: joined(", ", i["name"], i["publisher"], i["releaseDate"])),
        section("Languages", F.col("r.languages"), lambda i: joined(" - ", i["language"], i["fluency"])),
        section("Interests", F.col("r.interests"), lambda i: i["name"]),
        section("References", F.col("r.references"), lambda i: joined(": ", i["name"], i["reference"])),
    )
    contact = joined(" | ", F.col("r.basics.email"), F.col("r.basics.phone"), F.col("r.basics.url"))
    return r.select(key, render(F.col("r.basics.name"), F.concat(F.array(F.struct(F.lit("Summary").alias("heading"), F.filter(F.array("r.basics.summary"), present).alias("lines"))), parts), contact).alias("text"))


def flatten(value, depth: int = 0, budget: list | None = None) -> list[str]:
    """Keys and texts of any object as lines, depth first; numbers and booleans are left out."""
    budget = budget if budget is not None else [MAX_NODES]
    budget[0] -= 1
    if budget[0] < 0:
        raise ValueError("too many values")
    if depth > MAX_DEPTH:
        return []
    if isinstance(value, str):
        return [value] if value.strip() else []
    if isinstance(value, list):
        return [x for v in value for x in flatten(v, depth + 1, budget)]
    if isinstance(value, dict):
        out = []
        for k, v in value.items():
            held = flatten(v, depth + 1, budget)
            out += [str(k), *held] if held else []
        return out
    return []


def flattened(rows: DataFrame, column: str = "json", key: str = "doc_id") -> DataFrame:
    """key, text, error: any JSON object as text; a bad row says why and does not end the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for x in batch[column]:
                try:
                    out.append(("\n".join(flatten(json.loads(x))), None))
                except (ValueError, TypeError, RecursionError) as e:
                    out.append((None, str(e)[:200]))
            yield pd.DataFrame({key: batch[key], "text": [a for a, _ in out], "error": [b for _, b in out]})

    return rows.select(key, column).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, text string, error string")


def prepared(docs: DataFrame, limit: int = MAX_TEXT) -> DataFrame:
    """doc_id, text, hidden, truncated: normalised, cut to the limit, invisible characters counted and gone."""
    from ..functions import text as T

    clean = docs.select("doc_id", T.invisible_count(F.col("text")).cast("long").alias("hidden"), T.normalize(F.substring("text", 1, 40 * limit)).alias("text"))
    return clean.select("doc_id", T.cut(F.col("text"), limit).alias("text"), "hidden", (F.length("text") > limit).alias("truncated"))
