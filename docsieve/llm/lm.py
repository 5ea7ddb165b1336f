"""Language-model scores by stupid backoff, computed relationally.

Counts of all words and word pairs of all documents form tables partitioned by hash. The pairs of each document meet the
tables and their scores are summed per document: log S(w | v) = log c(v w) - log c(v) where the pair stands at least
``cutoff`` times in the corpus, else log backoff + log c(w) - log N. The first word of a text scores log c(w) - log N.
c(v) counts v as a context, so the scores of a context's frequent followers add up to at most 1.

Words are runs of ASCII letters and digits and of other characters, A-Z lower-cased. Null and empty texts have no words
and a null score. Repeated rows count as often as they occur and get a row each. Counts above 2**32 are cut to that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import SENT, answered, chunked, read_back, sent, sent_table
from .common import ALNUM, U64, hashes, lean, mix, spans, texts

BACKOFF, CUTOFF = 0.4, 2
WORDS, CONTEXTS, PAIRS = 0, 1, 2


def grams(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the row of each, the pairs' hashes, and the place of each pair's first word."""
    buf, bounds = texts(column)
    s, e, row = spans(buf, bounds, ALNUM)
    word = hashes(buf, s, e)
    at = np.flatnonzero(row[1:] == row[:-1])
    return word, row, mix(word[at] * U64(0xA0761D6478BD642F) + word[at + 1]), at


def score(docs: DataFrame, backoff: float = BACKOFF, cutoff: int = CUTOFF) -> DataFrame:
    """doc_id, n_words, n_backoff (pairs scored by backing off), log_score (the sum), mean_log_score: a row for each document."""
    rows, buckets = chunked(docs)

    def name(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        word, _, pair, at = grams(table.column("text"))
        out = []
        for kind, keys in ((WORDS, word), (CONTEXTS, word[at]), (PAIRS, pair)):
            own, n = np.unique(keys, return_counts=True)
            out += sent(chunk, kind, own, n, buckets)
        return sent_table(out)

    entries = rows.groupBy("chunk").applyInArrow(lean(name), SENT)
    totals = answered(entries)
    n_words = rows.select(F.regexp_count(F.col("text"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).alias("n")).agg(F.sum("n")).first()[0] or 0
    log_n = float(np.log(max(n_words, 1)))

    def total(table: pa.Table, back: pa.Table) -> pa.Table:
        word, row, pair, at = grams(table.column("text")) if table.num_rows else (np.zeros(0, U64),) * 4
        n = table.num_rows
        sums, backed, size = np.zeros(n), np.zeros(n, np.int64), np.bincount(row.astype(np.int64), minlength=n) if n else np.zeros(0, np.int64)
        if len(word):
            _, w = np.unique(word, return_inverse=True)
            single = np.log(read_back(back, WORDS)[0].astype(float))[w]
            first = np.r_[True, row[1:] != row[:-1]]
            sums += np.bincount(row[first], single[first] - log_n, minlength=n)
            if len(pair):
                _, c = np.unique(word[at], return_inverse=True)
                _, p = np.unique(pair, return_inverse=True)
                together = read_back(back, PAIRS)[0].astype(float)[p]
                context = read_back(back, CONTEXTS)[0].astype(float)[c]
                known = together >= cutoff
                each = np.where(known, np.log(together) - np.log(context), np.log(backoff) + single[at + 1] - log_n)
                sums += np.bincount(row[at], each, minlength=n)
                backed += np.bincount(row[at], ~known, minlength=n).astype(np.int64)
        empty = size == 0
        return pa.Table.from_arrays(
            [table.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(backed), pa.array(sums, mask=empty), pa.array(sums / np.maximum(size, 1), mask=empty)],
            ["doc_id", "n_words", "n_backoff", "log_score", "mean_log_score"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(lean(total), f"doc_id {kind}, n_words long, n_backoff long, log_score double, mean_log_score double")
