import collections
import math
import re

import pytest

from docsieve.llm import lm
from docsieve.llm.queries import QUERIES


def brute(docs, cutoff=2, backoff=0.4):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(low)) for _, t in docs]
    one, context, two = (collections.Counter() for _ in range(3))
    for w in words:
        one.update(w), context.update(w[:-1]), two.update(zip(w, w[1:]))
    n = sum(one.values())
    out = []
    for (d, _), w in zip(docs, words):
        total, backed = (math.log(one[w[0]] / n) if w else None), 0
        for a, b in zip(w, w[1:]):
            known = two[a, b] >= cutoff
            total += math.log(two[a, b] / context[a]) if known else math.log(backoff * one[b] / n)
            backed += not known
        out.append((d, len(w), backed, total))
    return out


def compare(df, docs, **options):
    key = lambda r: (str(r[0]), r[1], r[2], r[3] or 0)
    for a, b in zip(sorted((tuple(r)[:4] for r in df.collect()), key=key), sorted(brute(docs, **options), key=key), strict=True):
        assert a[:3] == b[:3] and (a[3] == b[3] if b[3] is None else a[3] == pytest.approx(b[3], abs=1e-6))


def test_table(spark, sf):
    compare(QUERIES["op10_lm"](spark, sf), [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_edges(spark, edge, none):
    compare(lm.score(edge), [(r["doc_id"], r["text"]) for r in edge.collect()])
    assert lm.score(none).count() == 0
