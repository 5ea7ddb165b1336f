"""Counting 64-bit keys over a corpus, and bringing the totals back to the documents.

Documents are dealt to chunks of a few MB by a hash of the row. A chunk names each of its distinct keys once, however
many of its documents hold it, so the hottest key of a corpus is one entry a chunk. Entries go to buckets by the key's
top bits, as sorted and compressed blocks; a bucket adds up and answers each block with the totals in the block's own
order. A chunk that computes its sorted distinct keys anew so reads its totals off by place: keys travel once, and never
back. Chunks and buckets are bounded by the input's size over their number, not by any key's frequency.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, lean

TARGET, LEAST = 4 << 20, 48
SENT = "bucket int, chunk int, kind int, data binary"
RETURNED = "chunk int, bucket int, kind int, data binary"


def chunked(docs: DataFrame, carry: bool = False, target: int = TARGET, least: int = LEAST) -> tuple[DataFrame, int]:
    """doc_id, text, mark (a hash of both), chunk, and with carry the other columns as a struct ``rest``; and how many buckets suit the input (a power of two)."""
    rest = [F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("rest")] if carry else []
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", F.col("text").cast("string")).alias("mark"), *rest)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(least, math.ceil(total / target))
    return rows.withColumn("chunk", F.pmod("mark", F.lit(n)).cast("int")), 1 << max(6, math.ceil(math.log2(max(1, total / target))))


def pack(a: np.ndarray) -> bytes:
    """Numbers as byte planes, compressed; unsigned 64-bit numbers are sorted keys and go as their differences, signed ones as they are."""
    a = np.ascontiguousarray(a)
    keys = a.dtype == U64
    if keys and len(a):
        a = np.diff(a, prepend=U64(0))
    width = a.dtype.itemsize
    planes = a.view(np.uint8).reshape(-1, width).T
    return bytes([width + keys]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    """Numbers of 4 bytes, sorted keys, or signed numbers of 8 bytes."""
    width = min(data[0], 8)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    a = np.ascontiguousarray(planes.T).view({4: np.uint32, 8: np.int64, 9: U64}[data[0]]).reshape(-1)
    return np.cumsum(a, dtype=U64) if data[0] == 9 else a


def block(*arrays: np.ndarray) -> bytes:
    """Several columns of one length; one of two dimensions is kept by rows."""
    parts = [bytes([a.shape[1] if a.ndim > 1 else 1]) + pack(a.reshape(-1)) for a in arrays]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def unblock(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        a, width = unpack(data[at + 5 : at + 4 + n]), data[at + 4]
        out.append(a.reshape(-1, width) if width > 1 else a)
        at += 4 + n
    return out


def sent(chunk: int, kind: int, keys: np.ndarray, counts: np.ndarray, buckets: int, *more: np.ndarray) -> list[tuple]:
    """Rows of SENT: the sorted distinct keys of a chunk, cut by their top bits."""
    shift = U64(64 - (buckets.bit_length() - 1))
    own = (keys >> shift).astype(np.int64)
    edges = np.searchsorted(own, np.arange(buckets + 1))
    return [(b, chunk, kind, block(keys[i:j], counts[i:j].astype(np.uint32), *(m[i:j] for m in more))) for b, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if j > i]


def rows_table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)


def sent_table(rows: list[tuple]) -> pa.Table:
    return rows_table(rows, ["bucket", "chunk", "kind", "data"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()])


def add_up(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each entry the total of its key, in 64 bits."""
    _, inverse = np.unique(keys, return_inverse=True)
    total = np.zeros(inverse.max(initial=-1) + 1, np.int64)
    np.add.at(total, inverse, counts.astype(np.int64))
    return total[inverse]


def answered(entries: DataFrame, totals: Callable = lambda kind, cols: [add_up(cols[0], cols[1])]) -> DataFrame:
    """From rows of SENT the rows of RETURNED: for each block, arrays of totals in the block's order. totals: (kind, columns) -> arrays."""

    def run(table: pa.Table) -> pa.Table:
        out = []
        kinds = table.column("kind").to_numpy()
        for kind in np.unique(kinds):
            own = table.filter(pa.array(kinds == kind))
            blocks = [unblock(x.as_py()) for x in own.column("data")]
            ends = np.cumsum([len(b[0]) for b in blocks])
            got = totals(int(kind), [np.concatenate(c) for c in zip(*blocks)])
            for k, (chunk, bucket) in enumerate(zip(own.column("chunk").to_pylist(), own.column("bucket").to_pylist())):
                i, j = (ends[k - 1] if k else 0), ends[k]
                out.append((chunk, bucket, int(kind), block(*(g[i:j] for g in got))))
        return rows_table(out, ["chunk", "bucket", "kind", "data"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()])

    return entries.groupBy("bucket").applyInArrow(lean(run), RETURNED)


def read_back(table: pa.Table, kind: int) -> list[np.ndarray]:
    """A chunk's totals in the order of its sorted distinct keys."""
    kinds, buckets = table.column("kind").to_numpy(), table.column("bucket").to_numpy()
    at = np.flatnonzero(kinds == kind)
    at = at[np.argsort(buckets[at], kind="stable")]
    blocks = [unblock(table.column("data")[int(k)].as_py()) for k in at]
    return [np.concatenate(c) for c in zip(*blocks)] if blocks else []
