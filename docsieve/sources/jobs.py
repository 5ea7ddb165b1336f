"""Postings as job boards give them, in three JSON shapes. Nothing is fetched: rows hold the answers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html import read

SHAPES = "title string, content string, company_name string, text string, description string, lists array<struct<text:string,content:string>>, additional string, jobs array<struct<id:string,title:string,descriptionHtml:string>>"


def read_boards(rows: DataFrame, column: str = "json", key: str = "doc_id") -> DataFrame:
    """key, title, employer, text of each posting in an answer."""
    r = rows.select(key, F.from_json(column, SHAPES).alias("r"))
    lists = F.array_join(F.transform(F.coalesce("r.lists", F.array().cast("array<struct<text:string,content:string>>")), lambda x: F.concat(F.lit("<h3>"), x["text"], F.lit("</h3><ul>"), x["content"], F.lit("</ul>"))), "")
    one = F.struct(F.coalesce("r.title", "r.text").alias("title"), F.coalesce(F.col("r.content"), F.concat(F.col("r.description"), lists, F.coalesce("r.additional", F.lit("")))).alias("html"))
    many = F.transform("r.jobs", lambda j: F.struct(j["title"].alias("title"), j["descriptionHtml"].alias("html")))
    each = r.select(key, F.col("r.company_name").alias("employer"), F.explode(F.when(F.size("r.jobs") > 0, many).otherwise(F.array(one))).alias("j")).select(key, "employer", "j.title", "j.html").filter("html IS NOT NULL")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from html import unescape

        for batch in batches:
            # one board sends its HTML escaped
            html = [unescape(x) if re.match(r"\s*&lt;", x) else x for x in batch["html"]]
            yield pd.DataFrame({key: batch[key], "title": batch["title"], "employer": batch["employer"], "text": [read(x, False)["text"] for x in html]})

    return each.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, title string, employer string, text string")
