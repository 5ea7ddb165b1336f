import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from docsieve.llm import suffixes
from docsieve.llm.queries import QUERIES


def brute(docs, length=400):
    data = [(d, (t or "").encode()) for d, t in docs]
    count = collections.Counter(b[i : i + length] for _, b in data for i in range(len(b) - length + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def passages(docs, n=51):
    """doc_id and the words in runs of n words that another row holds too."""
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in docs]
    count = collections.Counter(x for w in split for x in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
    out = []
    for (d, _), w in zip(docs, split, strict=True):
        hit = {k for i in range(len(w) - n + 1) if count[tuple(w[i : i + n])] > 1 for k in range(i, i + n)}
        out.append((d, len(hit)))
    return sorted(out, key=repr)


def got(df, **options):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffixes.removed(df, **options).collect()), key=repr)


def test_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = QUERIES["op6_suffixes"](spark, sf).collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == brute(docs)
    assert sorted(((r["doc_id"], r["n_passage_words"]) for r in found), key=repr) == passages(docs)
    assert all(r["repeats_passage"] == (r["n_passage_words"] > 0) for r in found)


def test_edges(spark, edge, none):
    docs = [(r["doc_id"], r["text"]) for r in edge.collect() if not r["text"] or len(r["text"]) < 50000]
    assert got(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)
    whole = {r["doc_id"]: r for r in suffixes.removed(edge).collect()}
    assert len(suffixes.removed(edge).collect()) == edge.count() and whole[9]["n_removed"] == whole[9]["n_bytes"]
    assert whole[8]["n_removed"] == whole[8]["n_bytes"] and suffixes.removed(none).count() == 0


def test_small_alphabet(spark):
    """Many repeats of every kind: short windows, letters of a small alphabet, shared and shifted passages."""
    rng = random.Random(2)
    passage = "".join(rng.choice("ab") for _ in range(90))
    docs = [(i, "".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) + rng.choice(["", passage, passage[7:80], passage * 2]) + "".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(df, length=24, anchor=9) == brute(docs, 24)


def test_words(spark):
    """Runs of words of a small vocabulary, with other white space between them, shared, shifted and within one document."""
    rng = random.Random(5)
    vocabulary = ["a", "bb", "ccc", "é", "dd"]
    passage = [rng.choice(vocabulary) for _ in range(20)]
    docs = []
    for i in range(80):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 14))] + rng.choice([[], passage, passage[3:15], passage * 2, ["x"] * 40]) + [rng.choice(vocabulary) for _ in range(rng.randint(0, 14))]
        docs.append((i, "".join(x + rng.choice([" ", "\n", "  "]) for x in w)))
    docs += [(80, None), (81, "x " * 40 + "y"), (None, " ".join(passage)), (5, docs[5][1])]
    found = suffixes.removed(spark.createDataFrame(docs, "doc_id long, text string"), length=24, anchor=9, words=8).collect()
    assert sorted(((r["doc_id"], r["n_passage_words"]) for r in found), key=repr) == passages(docs, 8)
    cut = suffixes.removed(spark.createDataFrame(docs, "doc_id long, text string"), length=10**6, words=8, passages=True, carry=True).collect()
    whole = {r["doc_id"]: r["kept_text"] for r in cut}
    assert not whole[None] and whole[81].strip() == "y"


def test_order_decides(spark, monkeypatch):
    """Windows count as equal because the suffix order says so."""
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared = text(60)
    chunk = pa.table({"text": [text(30) + shared + text(30), text(30) + shared + text(30)], "mark": [1, 2]})
    c = suffixes.Chunk(chunk, 24, 9, 0).units[0]
    at, cls = c.windows(np.ones(len(c.keys), bool))
    strings = [c.data[i : i + 24].tobytes() for i in at]
    assert len(set(strings)) == len(set(cls.tolist())) < len(strings)
    monkeypatch.setattr(suffixes, "suffix_classes", lambda data, starts, length: (np.arange(len(starts)), np.arange(len(starts))))
    at, cls = c.windows(np.ones(len(c.keys), bool))
    assert len(set(cls.tolist())) > len(set(strings))


def test_order():
    rng = random.Random(7)
    for k in range(60):
        data = bytes(rng.choice(b"ab" if k % 2 else b"abcdef") for _ in range(rng.randint(80, 600)))
        data += data[:50] + data
        length = rng.choice([5, 8, 13, 40, 64])
        starts = np.array(sorted(rng.sample(range(len(data) - length + 1), 70)))
        order, group = suffixes.suffix_classes(np.frombuffer(data, np.uint8), starts, length)
        strings = [data[i : i + length] for i in starts[order]]
        assert strings == sorted(strings) and all((strings[i] == strings[i + 1]) == (group[i] == group[i + 1]) for i in range(69))
