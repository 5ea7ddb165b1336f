import random

import pytest

from docsieve.llm.components import components


@pytest.mark.parametrize("per_task", [0, 50, 10**6])
def test_forests_chains_and_hubs(spark, per_task):
    rng = random.Random(per_task)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101 + i) for i in range(60)] + [(300 + rng.randrange(30), 300 + rng.randrange(30)) for _ in range(25)] + [(None, 5), (7, None), (9, 9), (1, 0)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), per_task=per_task).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long"), per_task=per_task).count() == 0
