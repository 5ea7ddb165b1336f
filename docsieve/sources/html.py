"""Web pages as text: a forward reader, and job postings given as structured data."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RAW = {"script", "style", "template", "noscript", "svg", "iframe", "object", "head"}
CHROME = {"nav", "footer", "aside", "header", "form", "button"}
BLOCK = {"p", "div", "section", "article", "main", "ul", "ol", "li", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "br", "hr", "blockquote", "pre", "dl", "dt", "dd", "title"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|font-size\s*:\s*[01](?:px|pt)|opacity\s*:\s*0(?:\.0+)?\s*(?:;|$)", re.I)
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
LEAST = 200


class Reader(HTMLParser):
    """Visible text, hidden text and tables of a page."""

    def __init__(self, page: bool, hidden_names: set[str]):
        super().__init__(convert_charrefs=True)
        self.page, self.names = page, hidden_names
        self.open: list[tuple[str, str]] = []  # (tag, why its content is set aside or "")
        self.parts: list[str] = []
        self.hidden: list[str] = []
        self.tables = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        why = self.open[-1][1] if self.open else ""
        if tag in RAW:
            why = "raw"
        elif self.page and tag in CHROME and not why:
            why = "chrome"
        elif not why and ("hidden" in a or a.get("aria-hidden") == "true" or HIDING.search(a.get("style") or "") or self.names & {*("." + c for c in (a.get("class") or "").split()), "#" + (a.get("id") or "")}):
            why = "hidden"
        self.tables += tag == "table"
        if tag in BLOCK:
            (self.hidden if why == "hidden" else self.parts).append("\n• " if tag == "li" and not why else "\n")
        if tag not in VOID:
            self.open.append((tag, why))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, max(-1, len(self.open) - 64), -1):
            if self.open[k][0] == tag:
                del self.open[k:]
                break
        if tag in BLOCK:
            self.parts.append("\n")

    def handle_data(self, data):
        why = self.open[-1][1] if self.open else ""
        if not why:
            self.parts.append(data)
        elif why == "hidden":
            self.hidden.append(data)


def hiding_names(html: str) -> set[str]:
    """Simple class and id selectors whose style rules hide."""
    out = set()
    for style in re.findall(r"<style[^>]*>(.*?)</style", html, re.S | re.I):
        for selectors, body in RULE.findall(re.sub(r"@media[^{]*\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}", "", style)):
            if HIDING.search(body):
                out |= {s.strip() for s in selectors.split(",") if re.fullmatch(r"\s*[.#][\w-]+\s*", s)}
    return out


def main_part(html: str) -> str:
    """The main landmark, or the article if there is one only."""
    m = re.search(r"<main\b[^>]*>(.*)</main\s*>", html, re.S | re.I)
    if m:
        return m[1]
    articles = re.findall(r"<article\b[^>]*>(.*?)</article\s*>", html, re.S | re.I)
    return articles[0] if len(articles) == 1 else html


def read(html: str, page: bool = True) -> dict:
    reader = Reader(page, hiding_names(html))
    reader.feed(main_part(html) if page else html)
    reader.close()
    tidy = lambda parts: "\n".join(x for x in (re.sub(r"[ \t\r\f\v\xa0]+", " ", line).strip() for line in "".join(parts).split("\n")) if x and x != "•")
    return {"text": tidy(reader.parts), "hidden": tidy(reader.hidden), "tables": reader.tables}


def _flat(node) -> Iterator[dict]:
    if isinstance(node, list):
        for x in node:
            yield from _flat(x)
    elif isinstance(node, dict):
        yield node
        yield from _flat(node.get("@graph", []))


def posting(html: str) -> dict | None:
    """title, employer, text of a JobPosting given as linked data."""
    nodes = []
    for raw in re.findall(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script", html, re.S | re.I):
        try:
            nodes += list(_flat(json.loads(raw)))
        except ValueError:
            continue
    by_id = {n["@id"]: n for n in nodes if isinstance(n.get("@id"), str)}
    for n in nodes:
        kinds = n.get("@type")
        if "JobPosting" in (kinds if isinstance(kinds, list) else [kinds]):
            org = n.get("hiringOrganization")
            org = by_id.get(org.get("@id"), org) if isinstance(org, dict) else org
            parts = [read(unescape(n.get("description") or ""), False)["text"]]
            for field, heading in (("responsibilities", "Responsibilities"), ("qualifications", "Qualifications"), ("skills", "Skills"), ("experienceRequirements", "Requirements"), ("educationRequirements", "Requirements")):
                if isinstance(n.get(field), str) and n[field].strip():
                    parts += [heading, read(unescape(n[field]), False)["text"]]
            return {"title": n.get("title"), "employer": org.get("name") if isinstance(org, dict) else org, "text": "\n".join(p for p in parts if p)}
    return None


def posting_text(html: str) -> str:
    """The posting's own text where it is long enough, else what the page shows."""
    found = posting(html)
    return found["text"] if found and len(found["text"]) >= LEAST else read(html)["text"]


def pages_text(pages: DataFrame, page: bool = True) -> DataFrame:
    """page_id, text, hidden_chars, tables, title, employer. Reading tags in order is one vectorised Python pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            html = [x or "" for x in batch["html"]]
            seen = [read(x, page) for x in html]
            found = [posting(x) for x in html]
            yield pd.DataFrame(
                {
                    "page_id": batch["page_id"], "text": [f["text"] if f and len(f["text"]) >= LEAST else s["text"] for f, s in zip(found, seen)], "hidden_chars": [len(re.sub(r"\s", "", s["hidden"])) for s in seen],
                    "tables": [s["tables"] for s in seen], "title": [f and f["title"] for f in found], "employer": [f and f["employer"] for f in found],
                }
            )

    return pages.select("page_id", F.col("html").cast("string").alias("html")).mapInPandas(run, "page_id long, text string, hidden_chars long, tables long, title string, employer string")
