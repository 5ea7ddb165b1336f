"""Command line: python -m docsieve FILES [--posting FILE] [--json] [--min-score N] [--year Y].

Exit codes: 0 all read and at or above the least score, 1 below it, 2 nothing could be read or wrong use."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import date

from pyspark.sql import functions as F

from .plans import report
from .session import session
from .sources.documents import prepared
from .sources.files import read_files, read_postings


def main(argv: list[str] | None = None) -> int:
    args = argparse.ArgumentParser(prog="docsieve")
    args.add_argument("path", help="a file or folder of documents (txt, md, html, docx)")
    args.add_argument("--posting", help="a file with the posting to match")
    args.add_argument("--json", action="store_true", help="print whole reports")
    args.add_argument("--min-score", type=int, default=0)
    args.add_argument("--year", type=int, default=date.today().year, help="the reference date's year")
    args.add_argument("--master", default="local[*]")
    got = args.parse_args(argv)
    spark = session(got.master, spark_ui_showConsoleProgress="false")
    files = read_files(spark, got.path).withColumn("doc_id", F.xxhash64("path"))
    docs = prepared(files.filter("error IS NULL").select("doc_id", "text")).select("doc_id", "text")
    postings = None
    if got.posting:
        text = read_postings(spark, got.posting).select(F.col("text").alias("posting")).first()
        if text is None or not text["posting"]:
            print("the posting could not be read", file=sys.stderr)
            return 2
        postings = docs.select("doc_id", F.lit(text["posting"]).alias("posting"))
    out = report.check(docs, postings, got.year).join(files.select("doc_id", "path"), "doc_id").collect()
    for r in files.filter("error IS NOT NULL").select("path", "error").collect():
        print(f"{r['path']}: {r['error']}", file=sys.stderr)
    for r in out:
        row = r.asDict(True)
        print(json.dumps(row, default=str, ensure_ascii=False) if got.json else f"{row['path']}: readiness {row['readiness']}, {row['verdict']}, {row['checks_passed']}/{row['checks_total']} checks" + (f", match {row['job_match']}" if row["job_match"] is not None else ""))
    if not out:
        return 2
    return int(any(r["readiness"] < got.min_score for r in out))


if __name__ == "__main__":
    sys.exit(main())
