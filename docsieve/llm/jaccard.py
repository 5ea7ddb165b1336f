"""Exact Jaccard join of documents' n-gram sets by vertical partitioning.

Documents of equal sets are one class. N-grams stand in a global order, rarest first by the number of classes that hold
them over the whole corpus (ties by hash). An n-gram of one class alone can be in no overlap: it is counted, not kept,
and a class of which too little is left can have no partner. The order is cut into fragments; a class becomes a segment
in each. Overlaps of candidate pairs are counted fragment by fragment and summed per pair, which decides the link.

Candidates share an n-gram among the first |S| - need + 1 of both, have sizes that allow the threshold, and stand early
enough in both. A frequent n-gram's list is not paired out. In rounds, each list that holds several components compares
its members with one of them (the pivot), and the links join classes into components. Lists of one component are done.
What is left after the rounds are mostly classes that are near each other but not linked: their lists' members are dealt
to blocks, and each pair of blocks that could hold a link between components is a task, which counts all its overlaps
at once, by matrix products over fragments, and returns which classes hang together, not pairs. So no link between
components is lost, no pair becomes a row of its own, and no group is held by one task.

Null texts, and texts without words, have no n-grams and link with nothing; a text of fewer words than n has its whole
sequence as its one n-gram. Repeated rows are documents of one class. A null id is a member that names no component.
Keys are 64-bit hashes. Other columns than the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import SENT, answered, chunked, read_back, sent, sent_table
from .common import NONSPACE, U64, hashes, lean, mix, settled, shingles, spans, stored, texts
from .components import components, spread_join

SIZE = 5
#: Frequencies are counted by the first 48 bits of an n-gram's hash. Two n-grams that share them count as one more frequent
#: one: they stand later in the order, the same for all documents, and are not dropped as unshared. Sets hold all 64 bits.
_SHORT = U64(16)
#: Links have num * union <= den * intersection: 100 * i >= 80 * u.
THRESHOLD = (4, 5)
STARS, BLOCK = 2, 512


def sets(column: pa.ChunkedArray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams by row (sorted in a row), their rows, the size of each row's set, and the set's 64-bit class."""
    buf, bounds = texts(column)
    s, e, row = spans(buf, bounds, NONSPACE)
    gram, own = shingles(hashes(buf, s, e), row, n)
    order = np.lexsort((gram, own))
    gram, own = gram[order], own[order]
    new = np.r_[True, (gram[1:] != gram[:-1]) | (own[1:] != own[:-1])] if len(gram) else np.zeros(0, bool)
    gram, own = gram[new], own[new]
    rows = len(bounds) - 1
    size = np.bincount(own, minlength=rows)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(gram ^ U64(0x2545F4914F6CDD1D)), dtype=U64)])
    end = np.cumsum(size)
    return gram, own, size, mix(total[end] - total[end - size] + size.astype(U64) * U64(0xD6E8FEB86659FD93))


def _leads(size: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Whether a row is the first of its class; rows without n-grams are none."""
    _, first = np.unique(cls, return_index=True)
    lead = np.zeros(len(cls), bool)
    lead[first] = True
    return lead & (size > 0)


def fragment(df: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """The part of the global order that an n-gram is in: by frequency, and within by hash."""
    return np.minimum(np.log2(df).astype(np.int64), 7) * 4 + (gram >> U64(62)).astype(np.int64)


def described(docs: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """doc_id, mark, size, cls; and for the first row of a class that can have partners: need, grams (those shared, in the global order), segments."""
    rows, buckets = chunked(docs)
    num, den = threshold

    def name(table: pa.Table) -> pa.Table:
        gram, own, size, cls = sets(table.column("text"), n)
        keys, count = np.unique(gram[_leads(size, cls)[own]] >> _SHORT << _SHORT, return_counts=True)
        return sent_table(sent(table.column("chunk")[0].as_py(), 0, keys, count, buckets))

    def order(table: pa.Table, back: pa.Table) -> pa.Table:
        gram, own, size, cls = sets(table.column("text"), n)
        lead = _leads(size, cls)
        held = lead[own]
        gram, own = gram[held], own[held]
        df = read_back(back, 0)[0][np.unique(gram >> _SHORT, return_inverse=True)[1]].astype(np.int64) if len(gram) else np.zeros(0, np.int64)
        many = df > 1
        gram, own, df = gram[many], own[many], df[many]
        left = np.bincount(own, minlength=len(size))
        need = -(-num * size // den)
        fit = lead & (left >= need) & (left > 0)
        held = fit[own]
        gram, own, df = gram[held], own[held], df[held]
        by = np.lexsort((gram, df, own))
        gram, own, df = gram[by], own[by], df[by]
        part = fragment(df, gram)
        begin = np.searchsorted(own, np.arange(len(size) + 1))
        grams, segments = [], []
        signed = gram.view(np.int64)
        for r in range(len(size)):
            i, j = begin[r], begin[r + 1]
            if i == j:
                grams.append(None), segments.append(None)
                continue
            grams.append(signed[i : j - need[r] + 1])  # the prefix: what is left of the first size - need + 1
            k = np.lexsort((gram[i:j], part[i:j]))
            p, x = part[i:j][k], signed[i:j][k]
            cut = np.flatnonzero(np.r_[True, p[1:] != p[:-1], True])
            segments.append([{"part": int(p[a]), "grams": x[a:b]} for a, b in zip(cut[:-1], cut[1:])])
        many = pa.list_(pa.struct([("part", pa.int32()), ("grams", pa.list_(pa.int64()))]))
        return pa.Table.from_arrays(
            [table.column("doc_id"), table.column("mark"), pa.array(size.astype(np.int64)), pa.array(cls.view(np.int64)), pa.array(left.astype(np.int64)), pa.array(grams, pa.list_(pa.int64())), pa.array(segments, many)],
            ["doc_id", "mark", "size", "cls", "shared", "prefix", "segments"],
        )

    counts = answered(rows.groupBy("chunk").applyInArrow(lean(name), SENT))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(lean(order), f"doc_id {kind}, mark long, size long, cls long, shared long, prefix array<long>, segments array<struct<part:int,grams:array<bigint>>>")


def needed(a: Column, b: Column, threshold: tuple[int, int]) -> Column:
    """The overlap that sets of sizes a and b must have: i / (a + b - i) >= num / den."""
    num, den = threshold
    return F.ceil(num * (a + b) / F.lit(num + den))


def possible(threshold: tuple[int, int]) -> Column:
    """Of members a and b of a list: sizes and places allow a link."""
    num, den = threshold
    low, high = F.least("a.size", "b.size"), F.greatest("a.size", "b.size")
    return (den * low >= num * high) & (F.least("a.rest", "b.rest") >= needed(F.col("a.size"), F.col("b.size"), threshold))


def linked(pairs: DataFrame, segments: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs (a, b, size_a, size_b) whose partial overlaps, summed over the fragments, reach the threshold."""
    one = spread_join(pairs.withColumnRenamed("a", "cls"), segments, ["cls"]).withColumnsRenamed({"cls": "a", "grams": "grams_a"})
    both = spread_join(one.withColumnRenamed("b", "cls"), segments, ["cls", "part"]).withColumnRenamed("cls", "b")
    partial = both.select("a", "b", "size_a", "size_b", F.size(F.array_intersect("grams_a", "grams")).alias("n"))
    return partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum("n").alias("n")).filter(F.col("n") >= needed(F.col("size_a"), F.col("size_b"), threshold)).select("a", "b")


def mixed(lists: DataFrame, comps: DataFrame | None, k: int) -> DataFrame:
    """Lists of more than one component: gram, cls, size, rest, comp, and a member of each list as pivot (another one each round)."""
    members = lists.withColumn("comp", F.col("cls")) if comps is None else spread_join(lists, comps, ["cls"], "left").withColumn("comp", F.coalesce("comp", "cls"))
    heads = members.groupBy("gram").agg(F.min(F.struct(F.xxhash64("cls", F.lit(k)), "cls", "size", "rest", "comp")).alias("pivot"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    return stored(spread_join(members, heads.select("gram", *(F.col(f"pivot.{c}").alias(f"pivot_{c}") for c in ("cls", "size", "rest", "comp"))), ["gram"]), "lists")


def starred(lists: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs (a, b, size_a, size_b) of a list's pivot with the members of other components, each pair once."""
    a, b = F.struct("cls", "size", "rest"), F.struct(*(F.col(f"pivot_{c}").alias(c) for c in ("cls", "size", "rest")))
    pairs = lists.filter("comp <> pivot_comp").select(a.alias("a"), b.alias("b")).filter(possible(threshold))
    first = F.col("a.cls") < F.col("b.cls")
    low, high = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))
    return pairs.select(low.alias("x"), high.alias("y")).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), F.col("x.size").alias("size_a"), F.col("y.size").alias("size_b")).distinct()


def blocked(lists: DataFrame, classes: DataFrame, threshold: tuple[int, int], block: int, width: int = 4096) -> DataFrame:
    """(a, b): edges that join all classes of different components which a link joins, at most one for a class and task.

    Lists that share members are a cluster. Members outside the cluster's largest component meet each other and the rest."""
    num, den = threshold
    leads = lists.groupBy("gram").agg(F.min("cls").alias("lead"))
    clusters = components(spread_join(lists.select("gram", "cls"), leads, ["gram"]).select("cls", "lead").distinct(), "cls", "lead").withColumnsRenamed({"node": "cls", "component": "cluster"})
    members = settled(spread_join(lists.select("cls", "comp").distinct(), clusters, ["cls"]))
    mains = members.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"))
    mains = mains.select("cluster", F.col("main.comp").alias("main"), F.ceil((F.col("n") - F.col("main.n")) / block).cast("int").alias("outer"), F.ceil(F.col("main.n") / block).cast("int").alias("inner"))
    placed = spread_join(members, mains, ["cluster"])
    is_main = F.col("comp") == F.col("main")
    own = F.when(is_main, F.col("outer") + F.pmod(F.xxhash64("cls"), F.col("inner"))).otherwise(F.pmod(F.xxhash64("cls"), F.col("outer"))).cast("int")
    last = F.when(is_main, F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1
    dealt = placed.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.select("cluster", "cls", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    grams = classes.select("cls", "size", F.flatten(F.transform("segments", lambda s: s["grams"])).alias("grams"))

    def dense(held: np.ndarray, row: np.ndarray, n: int, at: int, to: int) -> np.ndarray:
        i, j = np.searchsorted(held, [at, to])
        out = np.zeros((n, to - at), np.float32)
        out[row[i:j], held[i:j] - at] = 1
        return out

    def compare(table: pa.Table) -> pa.Table:
        names, size, place = (table.column(c).to_numpy() for c in ("cls", "size", "block"))
        col = table.column("grams").combine_chunks()
        values, n = col.flatten().to_numpy(), np.diff(col.offsets.to_numpy())
        row = np.repeat(np.arange(len(names)), n)
        sides = [np.flatnonzero(place == table.column(c)[0].as_py()) for c in ("lo", "hi")]
        number = np.full((2, len(names)), -1)
        for k, side in enumerate(sides):
            number[k, side] = np.arange(len(side))
        common = np.intersect1d(values[number[0, row] >= 0], values[number[1, row] >= 0])
        if not len(common):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        place_of = np.searchsorted(common, values)
        place_of[place_of == len(common)] = 0
        held = common[place_of] == values
        by = np.argsort(place_of[held], kind="stable")
        index, row = place_of[held][by], row[held][by]
        parts = []
        for k in (0, 1):
            mine = number[k, row] >= 0
            parts.append((index[mine], number[k, row[mine]], len(sides[k])))
        overlap = np.zeros((len(sides[0]), len(sides[1])), np.float32)
        for at in range(0, len(common), width):  # a fragment's partial overlaps, summed
            to = min(at + width, len(common))
            overlap += dense(*parts[0], at, to) @ dense(*parts[1], at, to).T
        x, y = sides
        i, j = np.nonzero((num + den) * overlap.astype(np.int64) >= num * (size[x][:, None] + size[y][None, :]))
        i, j = x[i], y[j]
        low = names.copy()
        while True:
            new = low.copy()
            np.minimum.at(new, i, low[j])
            np.minimum.at(new, j, low[i])
            if (new == low).all():
                break
            low = new
        moved = low != names
        return pa.table({"a": pa.array(names[moved]), "b": pa.array(low[moved])})

    return spread_join(dealt, grams, ["cls"]).groupBy("cluster", "lo", "hi").applyInArrow(lean(compare), "a long, b long")


def joined(docs: DataFrame, n: int = SIZE, threshold: tuple[int, int] = THRESHOLD, stars: int = STARS, block: int = BLOCK) -> DataFrame:
    """doc_id, mark (a hash of id and text), n_shingles, component_id: a row for each document."""
    rows = stored(described(docs, n, threshold), "sets")
    classes = stored(rows.filter("prefix IS NOT NULL").select("cls", "size", "shared", "prefix", "segments").dropDuplicates(["cls"]), "classes")
    segments = classes.select("cls", F.explode("segments").alias("s")).select("cls", "s.part", "s.grams")
    lists = classes.select("cls", "size", "shared", F.posexplode("prefix").alias("at", "gram")).select("gram", "cls", "size", (F.col("shared") - F.col("at")).alias("rest"))
    comps = links = None
    for k in range(stars + 1):
        held = mixed(lists, comps, k)
        if held.isEmpty():
            break
        found = linked(settled(starred(held, threshold)), segments, threshold) if k < stars else blocked(held, classes, threshold, block)
        links = settled(found if links is None else found.unionByName(links))
        comps = settled(components(links).withColumnsRenamed({"node": "cls", "component": "comp"}))
        lists = held.select("gram", "cls", "size", "rest")
    own = rows.select("doc_id", "mark", "size", "cls")
    own = own.withColumn("comp", F.col("cls")) if comps is None else spread_join(own, comps, ["cls"], "left").withColumn("comp", F.coalesce("comp", "cls"))
    own = own.select("doc_id", "mark", "size", "comp")
    least = own.filter("size > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = spread_join(own, least, ["comp"], "left")
    return named.select("doc_id", "mark", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
