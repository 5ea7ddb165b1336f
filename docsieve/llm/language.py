"""Language identification by Bayesian evidence fusion.

For each language l a page's posterior is the product of the host's prior and of three likelihoods: of the text (byte
trigrams of the main content, tempered since neighbouring trigrams are not independent), of the language that the markup
declares, and of the address suffix. The last two, and the priors, are counts of text-only decisions over all pages,
grouped before they are shuffled. The prior is smoothed by a hierarchy: host counts lean on the domain's shares, these on
the corpus' shares; a page's own decision is taken out of its host's and domain's counts first.

Trigram tables come from labelled documents, a bounded sample of ``per_language`` rows a language (the ``languages`` most
frequent ones), chosen by a hash of the id. All pages are counted and scored, over their whole text.

A page without text has flat text evidence and casts no vote; without an address it has the corpus' shares as its prior;
without a declaration that factor is left out. Repeated rows vote as often as they occur and get a row each. Equal
posteriors go to the language first in alphabetical order. With no labelled documents the language is null. An empty
table of pages gives an empty one. Broken or very long markup is read in one scan. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, stored, texts
from .components import spread_join

PER_LANGUAGE, LANGUAGES, BINS = 400, 64, 1 << 16
TEMPER, SMOOTH, LEAN = 0.05, 0.5, 4.0
_OPEN = re.compile(r"<(?:!--|(script|style|nav|footer|aside|head|noscript)\b)?", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "nav", "footer", "aside", "head", "noscript", "article", "main")}
_MAIN = re.compile(r"<(article|main)\b", re.I)
_HTML = re.compile(r"<html\b", re.I)
_LANG = re.compile(r"\blang\s*=\s*(?:[\"']\s*)?([A-Za-z]{2,3})\b", re.I)
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)


def main_part(html: str) -> str:
    """What the first article or main element holds that is closed, up to its last closing tag; else all."""
    last = {}
    for name in ("article", "main"):
        for m in _CLOSE[name].finditer(html):
            last[name] = m.start()
    for m in _MAIN.finditer(html) if last else ():
        end = html.find(">", m.end())
        if end < 0:
            break
        if last.get(m[1].lower(), -1) > end:
            return html[end + 1 : last[m[1].lower()]]
    return html


def content(html: str) -> str:
    """Main content without markup, comments, scripts and page furniture; white space as single blanks.

    One scan forwards: an end that was not found once is not looked for again, so broken markup costs no more than whole."""
    html = main_part(html)
    out, at, missing = [], 0, set()
    while (m := _OPEN.search(html, at)) is not None:
        begin, kind, end = m.start(), (m[1] or m[0]).lower(), -1
        if kind != "<" and kind not in missing:
            if m[1] is None:
                end = html.find("-->", m.end())
                end += 3 if end >= 0 else 0
            elif close := _CLOSE[kind].search(html, m.end()):
                end = close.end()
            if end < 0:
                missing.add(kind)
        if end < 0:  # a plain tag, or an element that is never closed
            end = html.find(">", begin) + 1 or -1
        out.append(html[at:begin])
        at = begin
        if end < 0:  # nothing ends any more
            break
        out.append(" ")
        at = end
    return re.sub(r"\s+", " ", "".join([*out, html[at:]]))


def declared_language(html: str) -> str | None:
    """The lang attribute of the first html tag."""
    tag = _HTML.search(html)
    if not tag:
        return None
    end = html.find(">", tag.end())
    found = _LANG.search(html[tag.end() : end if end >= 0 else None])
    return found[1].lower() if found else None


def address(url: str) -> tuple[str, str, str]:
    """Host, domain (its last two labels) and suffix (its last label); empty where there is none."""
    m = _HOST.match(url)
    host = m[1].lower().strip(".") if m else ""
    labels = host.split(".") if host else []
    return host, ".".join(labels[-2:]), labels[-1] if labels else ""


def trigrams(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and row of each byte trigram that lies in one row."""
    if len(buf) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = LOWER[buf].astype(np.uint32)
    code = ((b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]) * np.uint32(2654435761)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = row[2:] == row[:-2]
    return (code >> np.uint32(16))[inside].astype(np.int64), row[:-2][inside]


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, languages: int = LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order and log P(trigram bin | language)."""
    known = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    names = sorted(r["lang"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect())
    if not names:
        return [], np.zeros((0, BINS))
    ids = None
    for name in names:
        own = known.filter(F.col("lang") == name).select("lang", "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_language)
        ids = own if ids is None else ids.unionByName(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = batch.column(0).to_pylist()
            buf, bounds = texts(batch.column(1))
            for i, name in enumerate(lang):
                own = buf[bounds[i] : bounds[i + 1]]
                bins, _ = trigrams(own, np.array([0, len(own)]))
                total[name] = total.get(name, 0) + np.bincount(bins, minlength=BINS)
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([n[at].astype("<i8").tobytes()], pa.binary())], ["lang", "bins", "counts"])

    # ids: per_language * languages rows of two values. A repeated id counts once: its least text by hash
    chosen = known.join(F.broadcast(ids.distinct()), ["lang", "doc_id"], "left_semi").groupBy("lang", "doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("x")).select("lang", "x.text")
    counts = np.full((len(names), BINS), SMOOTH)
    for r in chosen.mapInArrow(run, "lang string, bins binary, counts binary").collect():  # a row a language and shuffle partition
        np.add.at(counts[names.index(r["lang"])], np.frombuffer(r["bins"], "<i4"), np.frombuffer(r["counts"], "<i8"))
    return names, np.log(counts / counts.sum(1, keepdims=True))


def evidence(pages: DataFrame, names: list[str], table: np.ndarray) -> DataFrame:
    """page_id, host, domain, suffix, declared, likelihoods (one for each language, tempered logs), text_lang (its number, or null)."""
    weights = np.ascontiguousarray(table.T).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                html = [x or "" for x in batch.column(2).to_pylist()]
                declared = [declared_language(x) for x in html]
                buf, bounds = texts(pa.array([content(x) for x in html], pa.string()))
                like = np.zeros((len(html), len(names)))
                for i in range(len(html)):
                    own = buf[bounds[i] : bounds[i + 1]]
                    bins, _ = trigrams(own, np.array([0, len(own)]))
                    if len(bins):
                        n = np.bincount(bins, minlength=BINS)
                        at = np.flatnonzero(n)
                        like[i] = TEMPER * (n[at].astype(float) @ weights[at].astype(float))
                best = like.argmax(1) if names else np.zeros(len(html), int)
                flat = (like == like[:, :1]).all(1)
                places = [address(u or "") for u in batch.column(1).to_pylist()]
                host, domain, suffix = (pa.array([p[j] for p in places], pa.string()) for j in range(3))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), host, domain, suffix, pa.array(declared, pa.string()), pa.array(list(like), pa.list_(pa.float64())), pa.array(best.astype(np.int32), mask=flat)],
                    ["page_id", "host", "domain", "suffix", "declared", "likelihoods", "text_lang"],
                )

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {kind}, host string, domain string, suffix string, declared string, likelihoods array<double>, text_lang int")


def votes(rows: DataFrame, key: str, n: int) -> DataFrame:
    """key and its counts of text-only decisions, one for each language."""
    counts = F.array(*[F.count_if(F.col("text_lang") == i) for i in range(n)])
    return rows.groupBy(key).agg(counts.alias(f"{key}_votes"))


def identify(pages: DataFrame, docs: DataFrame, per_language: int = PER_LANGUAGE, lean: float = LEAN) -> DataFrame:
    """page_id, lang, posterior, text_lang, declared, host: a row for each page."""
    names, table = fit(docs, per_language)
    n = len(names)
    if not n:
        nothing = F.lit(None).cast("string")
        return evidence(pages, [], np.zeros((0, BINS))).select("page_id", nothing.alias("lang"), F.lit(0.0).alias("posterior"), nothing.alias("text_lang"), "declared", "host")
    rows = stored(evidence(pages, names, table), "evidence")
    world = [r or 0 for r in rows.agg(*[F.count_if(F.col("text_lang") == i) for i in range(n)]).first()]
    share = [(c + SMOOTH) / (sum(world) + SMOOTH * n) for c in world]
    joined = spread_join(rows, votes(rows, "host", n), ["host"], "left")
    joined = spread_join(joined, votes(rows, "domain", n), ["domain"], "left")
    # P(suffix | l) and P(declared | l): few values each
    values = rows.agg(F.approx_count_distinct("suffix").alias("s"), F.approx_count_distinct("declared").alias("d")).first()
    for key, width in (("suffix", values["s"]), ("declared", values["d"])):
        seen = votes(rows.filter(f"{key} IS NOT NULL"), key, n)
        like = F.array(*[F.log((F.get(f"{key}_votes", F.lit(i)) + SMOOTH) / (world[i] + SMOOTH * (width + 1))) for i in range(n)])
        joined = spread_join(joined, seen.select(key, like.alias(f"{key}_like")), [key], "left")

    def own(i: int) -> Column:
        return F.coalesce((F.col("text_lang") == i).cast("double"), F.lit(0.0))

    size = {k: F.aggregate(f"{k}_votes", F.lit(0).cast("bigint"), lambda a, x: a + x) - F.col("text_lang").isNotNull().cast("int") for k in ("host", "domain")}
    logs = []
    for i in range(n):
        domain = (F.get("domain_votes", F.lit(i)) - own(i) + lean * share[i]) / (size["domain"] + lean)
        host = (F.get("host_votes", F.lit(i)) - own(i) + lean * domain) / (size["host"] + lean)
        prior = F.when(F.col("host") == "", F.lit(share[i])).otherwise(host)
        logs.append(F.log(prior) + F.get("likelihoods", F.lit(i)) + F.coalesce(F.get("declared_like", F.lit(i)), F.lit(0.0)) + F.when(F.col("suffix") == "", F.lit(0.0)).otherwise(F.get("suffix_like", F.lit(i))))
    scored = joined.select("page_id", "text_lang", "declared", "host", F.array(*logs).alias("logs")).withColumn("top", F.array_max("logs"))
    mass = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    label = F.array(*[F.lit(x) for x in names])
    return scored.select(
        "page_id", F.get(label, (F.array_position("logs", F.col("top")) - 1).cast("int")).alias("lang"), (1 / mass).alias("posterior"), F.get(label, F.col("text_lang")).alias("text_lang"), "declared", "host"
    )
