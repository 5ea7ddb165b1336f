"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order. It is listed under every set of ``shared`` of
its first ``depth`` pivots, so the vectors of one list share at least that many; a list's members are verified against
each other by cosine in double precision. Equal vectors are one class first. A list of more than twice ``block`` members
is split into blocks, and each pair of blocks is a task of its own, so no list is held whole and none is cut short.
A pair that meets in several lists counts in the first list that both are in.

The pivots are chosen from a bounded sample (of 8 * ``pivots`` vectors, by a hash of their id); every vector is indexed. Only rows of the
same label (not null) and the same dimension are compared. Vectors that are null, zero, or hold null or non-finite
components link with nothing, and so do rows without a vec_id; very large and very small components are no exception.
Repeated rows are vectors of their own. Of pivots that are equally near the first chosen one counts as nearer. An empty
table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import settled
from .components import components, spread_join

THRESHOLD = 0.93
PIVOTS, DEPTH, SHARED, BLOCK, APART = 256, 7, 2, 2048, 0.7


def units(v: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision; scaled by their largest component first, so that no square overflows or vanishes."""
    x = v.astype(float)
    x /= np.abs(x).max(axis=1, initial=0)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def comparable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, v (array<float> or array<double>, null where it links with nothing), and a 128-bit digest of it."""
    kind = embeddings.schema["embedding"].dataType
    own = "array<float>" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "array<double>"
    raw = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(own).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.coalesce(finite & F.exists("v", lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    v = F.when(good, F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)).cast(own))  # -0 is 0
    return raw.select("vec_id", "label", v.alias("v")).withColumns({"d1": F.xxhash64("v"), "d2": F.xxhash64(F.lit(1), "v"), "dim": F.size("v")})


def pivot_sets(classes: DataFrame, pivots: int) -> dict[int, np.ndarray]:
    """For each dimension, at most ``pivots`` unit reference points that lie apart.

    They come from a sample of 8 * pivots vectors, those with the smallest hashes of their ids. A vector near a point that
    is already chosen is passed over: of a crowd of near copies one is a pivot, else its members would differ in theirs."""
    rows = classes.select("v", "dim").orderBy(F.xxhash64("rep"), "rep").limit(8 * pivots).collect()
    out: dict[int, np.ndarray] = {}
    for d in {r["dim"] for r in rows}:
        m = units(np.array([r["v"] for r in rows if r["dim"] == d], float).reshape(-1, d))
        near = np.zeros(len(m), bool)
        chosen: list[int] = []
        for i in range(len(m)):
            if not near[i] and len(chosen) < pivots:
                chosen.append(i)
                near |= m @ m[i] > APART
        out[d] = m[chosen]
    return out


def postings(classes: DataFrame, sets: dict[int, np.ndarray], depth: int, shared: int) -> DataFrame:
    """A row for each list of each class: label, dim, key, rep, copies, firsts (its nearest pivots), v as it is in the table."""
    kind = classes.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                dims = batch.column("dim").to_numpy()
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    own = batch.take(pa.array(at))
                    x = units(own.column("v").flatten().to_numpy().reshape(len(at), d))
                    points = sets.get(int(d), np.zeros((0, d)))
                    near = np.argsort(-(x @ points.T), axis=1, kind="stable")[:, :depth]  # the permutation's head
                    firsts = np.sort(near, axis=1)
                    width = min(shared, firsts.shape[1])
                    for pick in combinations(range(firsts.shape[1]), width):
                        key = np.zeros(len(at), np.int64)
                        for c in pick:
                            key = key * (len(points) + 1) + firsts[:, c] + 1
                        yield pa.RecordBatch.from_arrays(
                            [own.column("label"), own.column("dim"), pa.array(key), own.column("rep"), own.column("copies"), pa.array(list(firsts.astype(np.int32)), pa.list_(pa.int32())), own.column("v")],
                            ["label", "dim", "key", "rep", "copies", "firsts", "v"],
                        )

    return classes.select("label", "dim", "rep", "copies", "v").mapInArrow(run, f"label string, dim int, key long, rep long, copies long, firsts array<int>, v {kind}")


def _first_common(a: np.ndarray, b: np.ndarray, base: int, shared: int) -> np.ndarray:
    """The key of the first list that both rows of pivots are in: their ``shared`` smallest common pivots."""
    common = (a[:, :, None] == b[:, None, :]).any(2)
    rank = np.cumsum(common, 1)
    key = np.zeros(len(a), np.int64)
    for k in range(1, shared + 1):
        at = (common & (rank == k)).argmax(1)
        key = key * base + a[np.arange(len(a)), at] + 1
    return key


def verified(lists: DataFrame, threshold: float, sets: dict[int, np.ndarray], shared: int, chunk: int = 1 << 14) -> DataFrame:
    """From rows sorted by task within partitions: (rep, links, low), links counted at their first common list, low the smallest id linked in this task."""
    sizes = {d: len(p) + 1 for d, p in sets.items()}

    def tasks(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            mark = held.column("task").to_numpy()
            last = int(np.searchsorted(mark, mark[-1], "left")) if mark[0] != mark[-1] else 0
            if last:
                yield held.slice(0, last)
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in tasks(batches):
            whole = whole.combine_chunks()
            mark = whole.column("task").to_numpy()
            edges = np.flatnonzero(np.r_[True, mark[1:] != mark[:-1], True])
            size = np.diff(edges)
            many = size > 1
            if not many.any():
                continue
            begin, size = edges[:-1][many], size[many]
            rep, copies, side, key, dim, label = (whole.column(c).to_numpy() for c in ("rep", "copies", "side", "key", "dim", "label"))
            place, vectors = np.zeros(len(rep), np.int64), {}
            for d in np.unique(dim):
                own = np.flatnonzero(dim == d)
                place[own] = np.arange(len(own))
                vectors[int(d)] = units(whole.column("v").take(pa.array(own)).combine_chunks().flatten().to_numpy().reshape(len(own), d))
            # ordered pairs i < j of each task, a chunk at a time
            left = np.concatenate([np.arange(b, b + n - 1) for b, n in zip(begin, size)])
            until = np.repeat(begin + size, size - 1)
            count = until - left - 1
            found: list = []
            at = 0
            while at < len(left):
                to = max(at + 1, int(np.searchsorted(np.cumsum(count[at:]), chunk, "right")) + at)
                i = np.repeat(left[at:to], count[at:to])
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count[at:to]) - count[at:to], count[at:to])
                at = to
                # a task's keys may collide in 64 bits; blocks are compared across, or within when there is one
                ok = (key[i] == key[j]) & (dim[i] == dim[j]) & (label[i] == label[j]) & (rep[i] != rep[j]) & ((side[i] < 0) | (side[i] != side[j]))
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                for d in np.unique(dim[i]):
                    own = dim[i] == d
                    a, b = i[own], j[own]
                    near = np.einsum("ij,ij->i", vectors[int(d)][place[a]], vectors[int(d)][place[b]]) >= threshold
                    a, b = a[near], b[near]
                    if len(a):
                        fa, fb = (whole.column("firsts").take(pa.array(x)).combine_chunks().flatten().to_numpy().reshape(len(x), -1) for x in (a, b))
                        found.append((a, b, _first_common(fa, fb, sizes[int(d)], min(shared, fa.shape[1])) == key[a]))
            if not found:
                continue
            a, b, first = (np.concatenate(x) for x in zip(*found))
            links = np.bincount(a, first * copies[b], minlength=len(rep)) + np.bincount(b, first * copies[a], minlength=len(rep))
            low = rep.copy()
            while True:
                new = low.copy()
                np.minimum.at(new, a, low[b])
                np.minimum.at(new, b, low[a])
                if (new == low).all():
                    break
                low = new
            touched = np.unique(np.concatenate([a, b]))
            yield pa.RecordBatch.from_arrays([pa.array(rep[touched]), pa.array(links[touched].astype(np.int64)), pa.array(low[touched])], ["rep", "links", "low"])

    return lists.mapInArrow(run, "rep long, links long, low long")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, pivots: int = PIVOTS, depth: int = DEPTH, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of the input."""
    rows = comparable(embeddings)
    keys = ["label", "dim", "d1", "d2"]
    classes = settled(rows.filter("v IS NOT NULL").groupBy(*keys).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")))
    sets = pivot_sets(classes, pivots)
    listed = postings(classes, sets, depth, shared)
    crowded = listed.groupBy("label", "dim", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * block).select("label", "dim", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    split = listed.join(crowded, ["label", "dim", "key"], "left")
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    # a member of block i goes to each pair of blocks that holds i; alone is -1
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.withColumn("mine", F.coalesce(mine, F.lit(-1))).withColumn("other", other)
    # the pair (i, i) compares within: its members have no side
    split = split.withColumn("side", F.when(F.col("mine") == F.col("other"), F.lit(-1)).otherwise(F.col("mine")))
    tasked = split.withColumn("task", F.xxhash64("label", "dim", "key", F.least("mine", "other"), F.greatest("mine", "other")))
    dealt = tasked.select("task", "label", "dim", "key", "side", "rep", "copies", "firsts", "v").repartition("task").sortWithinPartitions("task")
    found = settled(verified(dealt, threshold, sets, shared))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found, "rep", "low").withColumnRenamed("node", "rep")
    named = classes.select(*keys, "rep", "copies").join(links, "rep", "left").join(groups, "rep", "left")
    named = named.select(*keys, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = spread_join(rows.select("vec_id", *keys, F.col("v").isNotNull().alias("good")), named, keys, "left")
    component = F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("good"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
