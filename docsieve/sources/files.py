"""Files of documents and postings: formats, size limits, decoding, and DOCX with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode_bytes
from .html import read as read_html

# What a file may hold.
MAX_BYTES, MIN_CHARS, MAX_EXPANDED, MAX_PARTS = 20 << 20, 50, 64 << 20, 2000
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RESULT = "path string, format string, text string, tables long, images long, tracked_changes long, comments long, hidden_text string, error string"


def file_format(path: Column) -> Column:
    """By the extension; rich text and old Word files are refused by name."""
    end = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(end.isin("txt", "md", "text"), "text").when(end.isin("htm", "html"), "html").when(end == "json", "json").when(end == "docx", "docx").when(end == "pdf", "pdf").when(end.isin("rtf", "doc"), "refused").otherwise("unknown")


def read_docx(data: bytes) -> dict:
    """Text with tables, images, tracked changes, comments and hidden runs; a file that expands past the limit is refused."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = z.infolist()
        if len(infos) > MAX_PARTS or sum(i.file_size for i in infos) > MAX_EXPANDED:
            raise ValueError("the file expands too far")
        names = set(z.namelist())

        def part(name: str):
            raw = z.read(name)
            if b"<!DOCTYPE" in raw[:4096] or b"<!ENTITY" in raw:
                raise ValueError("the file declares entities")
            return ElementTree.fromstring(raw)

        body = part("word/document.xml")
        margins = [part(n) for n in sorted(names) if re.fullmatch(r"word/(header|footer)\d*\.xml", n)]
        comments = part("word/comments.xml").findall(f"{W}comment") if "word/comments.xml" in names else []
    lines, hidden = [], []
    for root in [body, *margins]:
        for p in root.iter(f"{W}p"):
            line = ""
            for r in p.iter(f"{W}r"):
                text = "".join((e.text or "") if e.tag == f"{W}t" else "\t" if e.tag == f"{W}tab" else "\n" if e.tag == f"{W}br" else "" for e in r)
                style = r.find(f"{W}rPr")
                size = style.find(f"{W}sz") if style is not None else None
                color = style.find(f"{W}color") if style is not None else None
                off = style is not None and style.find(f"{W}vanish") is not None
                tiny = size is not None and (size.get(f"{W}val") or "99").isdigit() and int(size.get(f"{W}val")) < 4
                white = color is not None and (color.get(f"{W}val") or "").upper() in ("FFFFFF", "FEFEFE", "FDFDFD")
                if off or tiny or white:
                    hidden.append(text)
                else:
                    line += text
            lines.append(line)
    tag = lambda t: sum(1 for _ in body.iter(f"{W}{t}"))
    return {"text": "\n".join(lines), "tables": tag("tbl"), "images": tag("drawing"), "tracked_changes": tag("ins") + tag("del"), "comments": len(comments), "hidden_text": " ".join(hidden)[:5000]}


def extract(kind: str, data: bytes) -> dict:
    if len(data) > MAX_BYTES:
        raise ValueError("the file is over 20 MB")
    if kind == "docx":
        return read_docx(data)
    if kind == "html":
        page = read_html(decode_bytes(data), page=False)
        return {"text": page["text"], "tables": page["tables"], "hidden_text": page["hidden"][:5000]}
    if kind in ("text", "json"):
        return {"text": decode_bytes(data)}
    if kind == "pdf":
        raise ValueError("no PDF reader is installed: give the text and its layout signals")
    raise ValueError(f"the format is not read: {kind}")


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row a file, with its text or the reason why there is none. Files past the limit are not loaded into Python."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    files = files.select("path", file_format(F.col("path")).alias("format"), F.when(F.col("length") <= MAX_BYTES, F.col("content")).alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for kind, data in zip(batch["format"], batch["content"]):
                try:
                    if data is None:
                        raise ValueError("the file is over 20 MB")
                    row = extract(kind, bytes(data))
                    row["error"] = "no readable text" if len(row["text"].strip()) < MIN_CHARS else None
                except Exception as e:  # any broken file: its row says why, the job goes on
                    row = {"text": None, "error": f"{type(e).__name__}: {e}"[:200]}
                out.append(row)
            yield pd.DataFrame({"path": batch["path"], "format": batch["format"], **{k: [r.get(k, 0) for r in out] for k in ("tables", "images", "tracked_changes", "comments")}, **{k: [r.get(k) for r in out] for k in ("text", "hidden_text", "error")}})[[c.split()[0] for c in RESULT.split(", ")]]

    return files.mapInPandas(run, RESULT)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """Postings as text, Markdown, HTML or DOCX files."""
    return read_files(spark, path, "*.{txt,md,html,htm,docx}")
