import random
import re

from docsieve.llm import jaccard
from docsieve.llm.queries import QUERIES


def shingles(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=repr)


def got(df, **options):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.joined(df, **options).collect()), key=repr)


def test_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op4_jaccard"](spark, sf).collect()), key=repr) == brute(docs)


def test_edges(spark, edge, none):
    assert got(edge) == brute([(r["doc_id"], r["text"]) for r in edge.collect()])
    assert jaccard.joined(none).count() == 0


def test_chains_and_stars(spark):
    """Edited copies of a few texts, so that components hang together by chains, and a passage that all share."""
    rng = random.Random(5)
    shared = [f"s{i}" for i in range(30)]
    docs = []
    for base in range(4):
        words = [f"b{base}w{i}" for i in range(120)] + shared
        for _ in range(25):
            docs.append((len(docs), " ".join(words)))
            words = list(words)
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    docs += [(len(docs) + k, " ".join(shared + [f"own{k}x{i}" for i in range(rng.choice([2, 5, 60]))])) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs)
    assert got(df) == want and got(df, stars=0, block=16) == want
