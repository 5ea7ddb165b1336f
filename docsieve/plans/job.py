"""Matching documents with postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import matching as M
from ..operators import segment as S
from ..operators.extract import degree_level
from ..policy import vocabulary as V


def asking_lines(postings: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, section, line_no, line: the lines of a posting that ask for something."""
    return S.posting_sections(S.lines(postings, key, text), key).filter("heading IS NULL AND section <> 'excluded'")


def asked(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, token, weight, kind: the terms that asking lines name, by section, degrees left out."""
    by = rows.groupBy(key, "section").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], "\n").alias("text"))
    keyed = by.select(F.struct(key, "section").alias("part"), M.without_degrees(F.col("text")).alias("text"))
    terms = M.terms(keyed, "part").select(F.col(f"part.{key}").alias(key), F.col("part.section").alias("section"), "token")
    return M.weighed(terms, key)


def rooted(rows: DataFrame, lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Asked terms with their root: "or" and the first member for the alternatives of a line, else the term itself."""
    bare = lines.withColumn("line", M.without_degrees(F.col("line")))
    roots = M.canonical(M.alternative_roots(bare, key)).groupBy(key, "token").agg(F.concat(F.lit("or "), F.min("root")).alias("root"))
    return rows.join(roots, [key, "token"], "left").withColumn("root", F.coalesce("root", "token"))


def requirements(rows: DataFrame, lines: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, token, weight, found: what a posting asks for. The alternatives of a line are one requirement, named "or" and
    its first member; degrees are asked for by level ("degree 7"). rows: asked terms (key, token, weight, found); lines:
    key, line_no, line, weight; docs: key, text."""
    terms = M.grouped(rooted(rows, lines, key), key)
    degrees = M.degree_terms(lines, docs.select(key, degree_level(F.col("text")).alias("highest_isced")), key)
    named = degrees.select(key, F.concat(F.lit("degree "), F.col("isced").cast("string")).alias("token"), "weight", "found")
    return terms.select(key, F.col("root").alias("token"), "weight", "found").unionByName(named)


def match(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """doc_id, score, matched, total. docs: doc_id, text; postings: doc_id, posting."""
    held = M.implied(M.terms(docs.select("doc_id", "text")))
    lines = asking_lines(postings.select("doc_id", F.col("posting").alias("text")))
    weight = F.create_map(*[F.lit(x) for pair in V.SECTION_WEIGHTS.items() for x in pair])
    found = M.matches(asked(lines), held, "doc_id")
    return M.match_score(requirements(found, lines.withColumn("weight", weight[F.col("section")]), docs.select("doc_id", "text")), "doc_id")
