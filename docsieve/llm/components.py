"""Connected components over a distributed edge table: alternating large-star and small-star steps.

The same steps run at every size; only their number of tasks follows it: a step over no more than ``per_task`` edges is
one task, a larger one is shuffled.

Each step is a minimum per node and a join back; minima are taken before the shuffle, and the joins carry a second key so
that both sides are plain shuffles, which lets adaptive execution split a hub's rows. No node's neighbours are gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join whose two sides are always shuffled for it alone, so that skewed keys of ``left`` can be split.

    An aggregate of ``right`` by the same keys would else be joined where it stands, and then neither side can be split."""
    mark = F.xxhash64(*keys, F.lit(7))
    return left.withColumn("__mark", mark).join(right.withColumn("__mark", mark), [*keys, "__mark"], how).drop("__mark")


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs: (u, v). large: v is any neighbour; else v < u."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = spread_join(pairs, low, ["u"])
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))


PER_TASK = 200_000


def _dealt(df: DataFrame, tasks: int | None) -> DataFrame:
    return df.coalesce(tasks) if tasks else df


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60, per_task: int = PER_TASK) -> DataFrame:
    """(node, component) for each node of an edge; the component is its smallest node. Null ends and loops are ignored.

    No edges give no rows; edges that stand repeatedly, or both ways, count once."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    pairs = edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).filter(x.isNotNull() & y.isNotNull() & (x != y)).distinct()
    held, before = settled(pairs), None
    n = held.count()
    for _ in range(most):
        tasks = 1 if n <= per_task else None  # what is in one task needs no shuffle
        both = _dealt(held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v"))), tasks)
        wide = _dealt(_star(both, True), tasks).distinct()
        held = settled(_dealt(_star(wide, False), tasks).distinct())
        n, mark = held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, mark) == before:
            break
        before = (n, mark)
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
