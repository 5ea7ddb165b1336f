"""Signals from positioned runs (doc_id, page, x, y, w, h, text) of pages that a reader has already taken apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Baselines that belong together, the gap that makes a cell, gutters tried, and how far margins may move, in points.
BASELINE, CELL_GAP, GUTTER_STEP, MARGIN_SHIFT = 4.6, 7.0, 4, 2.0


def reading_lines(runs: DataFrame) -> DataFrame:
    """doc_id, page, line_no, text: runs on one baseline from left to right; a wide gap is a tab. Islands by the step between baselines."""
    down = Window.partitionBy("doc_id", "page").orderBy(F.desc("y"), "x")
    new = F.coalesce((F.lag("y").over(down) - F.col("y") > BASELINE).cast("int"), F.lit(1))
    rows = runs.withColumn("new", new).withColumn("line_no", F.sum("new").over(down).cast("long"))
    across = Window.partitionBy("doc_id", "page", "line_no").orderBy("x")
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(across)
    glue = F.when(gap.isNull(), "").when((gap >= CELL_GAP) & (gap >= 0.6 * F.col("h")), "\t").when(gap > 0.15 * F.col("h"), " ").otherwise("")
    parts = F.array_sort(F.collect_list(F.struct("x", F.concat("glue", "text").alias("s"))))
    return rows.withColumn("glue", glue).groupBy("doc_id", "page", "line_no").agg(F.array_join(F.transform(parts, lambda p: p["s"]), "").alias("text"), F.avg("y").alias("y"))


def column_ratio(runs: DataFrame) -> DataFrame:
    """doc_id, column_ratio: the thinner side's share of the text at the best gutter between 30 and 70 % of the width."""
    page = Window.partitionBy("doc_id", "page")
    rows = runs.withColumn("left", F.min("x").over(page)).withColumn("width", F.max(F.col("x") + F.col("w")).over(page) - F.col("left"))
    split = F.explode(F.sequence(F.floor(F.col("width") * 0.3).cast("int"), F.ceil(F.col("width") * 0.7).cast("int"), F.lit(GUTTER_STEP)))
    tried = rows.withColumn("split", split).withColumn("at", F.col("left") + F.col("split"))
    mass = F.length("text")
    side = tried.groupBy("doc_id", "page", "split").agg(
        F.sum(F.when(F.col("x") + F.col("w") <= F.col("at"), mass).otherwise(0)).alias("l"), F.sum(F.when(F.col("x") >= F.col("at"), mass).otherwise(0)).alias("r"),
        F.sum(F.when((F.col("x") < F.col("at")) & (F.col("x") + F.col("w") > F.col("at")), mass).otherwise(0)).alias("across"), F.sum(mass).alias("all"),
    )
    clear = side.filter(F.col("across") <= 0.1 * F.col("all")).groupBy("doc_id", "page").agg(F.max(F.least("l", "r") / F.col("all")).alias("ratio"))
    return runs.select("doc_id").distinct().join(clear.groupBy("doc_id").agg(F.max("ratio").alias("ratio")), "doc_id", "left").select("doc_id", F.round(F.coalesce("ratio", F.lit(0.0)), 6).alias("column_ratio"))


def without_margins(lines: DataFrame) -> DataFrame:
    """Lines that no other page repeats at the same height, digits masked: joined by text and cells of height, so near heights share one of two cells."""
    mask = F.regexp_replace("text", "[0-9]+", "#")
    keyed = lines.withColumn("mask", mask)
    cell = F.floor(F.col("y") / MARGIN_SHIFT)
    a = keyed.select("doc_id", "page", "line_no", "mask", "y", cell.alias("cell"))
    b = keyed.select("doc_id", F.col("page").alias("page_b"), "mask", F.col("y").alias("y_b"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    repeated = a.join(b, ["doc_id", "mask", "cell"]).filter((F.col("page") != F.col("page_b")) & (F.abs(F.col("y") - F.col("y_b")) <= MARGIN_SHIFT)).select("doc_id", "page", "line_no").distinct()
    return lines.join(repeated, ["doc_id", "page", "line_no"], "left_anti")


def with_links(rows: DataFrame, most: int = 50) -> DataFrame:
    """text with link targets (``targets``) that it does not already show, at most 50."""
    new = F.slice(F.filter(F.array_distinct("targets"), lambda u: ~F.contains(F.col("text"), u)), 1, most)
    return rows.withColumn("text", F.array_join(F.concat(F.array("text"), new), "\n"))


def hidden_signals(rows: DataFrame, column: str = "hidden_text") -> DataFrame:
    """doc_id, hidden_text (one line, at most 5,000 characters), hiddenTextChars (without spaces)."""
    flat = F.trim(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"\s+", " "))
    return rows.select("doc_id", F.substring(flat, 1, 5000).alias("hidden_text"), F.length(F.regexp_replace(flat, " ", "")).cast("double").alias("hiddenTextChars"))
