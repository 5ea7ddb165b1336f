import math

import numpy as np

from docsieve.llm import embeddings
from docsieve.llm.queries import QUERIES


def brute(rows, least=0.93):
    ok = lambda i, v, k: i is not None and k is not None and v is not None and None not in v and all(map(math.isfinite, v)) and any(v)
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, v, k) in enumerate(rows):
        for b in range(a):
            j, w, m = rows[b]
            if k == m and ok(i, v, k) and ok(j, w, m) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    n[a] += 1
                    n[b] += 1
                    root[find(a)] = find(b)
    least_of = {}
    for a, (i, _, _) in enumerate(rows):
        if i is not None:
            least_of[find(a)] = min(least_of.get(find(a), i), i)
    return sorted(((i, n[a], least_of.get(find(a)) if i is not None else None, i is not None and least_of[find(a)] == i) for a, (i, _, _) in enumerate(rows)), key=repr)


def got(df, **options):
    return sorted((tuple(r) for r in embeddings.near_duplicates(df, **options).collect()), key=repr)


SCHEMA = "vec_id long, embedding array<float>, label int, dim string, rep int"


def test_clusters(spark):
    """Clusters of noisy copies around random centres; one list is split into blocks."""
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1):
        for size in (60, 2, 3, 1, 1, 1, 1):
            centre = rng.normal(size=24)
            rows += [(len(rows) + k, [float(np.float32(x)) for x in centre + rng.normal(size=24) * 0.05], label) for k in range(size)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert got(df) == brute(rows) and got(df, block=8) == brute(rows)


def test_edges(spark):
    e = [1.0, 0.0, 0.0]
    rows = [(1, e, 0), (2, [2.0, 0.0, 0.0], 0), (3, e, 1), (4, e, None), (5, None, 0), (6, [0.0, 0.0, 0.0], 0), (7, [1.0, None, 0.0], 0), (8, [float("nan"), 0.0, 1.0], 0), (9, [float("inf"), 0.0, 0.0], 0), (None, e, 0), (1, e, 0), (10, [1.0, 0.0], 0), (11, [], 0), (12, [0.9, 0.1, 0.0], 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert got(df) == brute(rows)
    assert embeddings.near_duplicates(spark.createDataFrame([], df.schema)).count() == 0


def test_sizes_of_components(spark):
    """Cosine has no unit: huge and tiny vectors link like any others."""
    rows = [(1, [1e200, 1e200], 0), (2, [1e200, 1e200], 0), (3, [1e-200, 1e-200], 0), (4, [1.0, 1.0], 0), (5, [1e300, 0.0], 0), (6, [5e-324, 0.0], 0), (7, [-0.0, 3.0], 0), (8, [0.0, 3.0], 0)]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert found == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (1, 7), 8: (1, 7)}


def test_recall(spark, sf):
    """Against all pairs of the small table, and of noisy copies near the threshold."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(300, 64))
    rows = []
    for k in range(300):
        noise = rng.normal(size=64)
        noise -= (noise @ base[k]) / (base[k] @ base[k]) * base[k]
        noise *= np.linalg.norm(base[k]) / np.linalg.norm(noise) * math.tan(math.acos(0.94))
        rows += [(2 * k, base[k].tolist(), 0), (2 * k + 1, (base[k] + noise).tolist(), 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    found = sum(r["n_links"] for r in embeddings.near_duplicates(df).collect())
    assert found >= 0.9 * 600
    assert QUERIES["op8_embeddings"](spark, sf).count() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
