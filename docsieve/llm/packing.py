"""Packing documents into fixed token windows by concatenate-and-cut.

Pass one tokenises each scan partition once, in place, and stores (partition, running offset, ids). The totals of the
partitions (one number each) get a prefix sum, which makes every running offset global. Pass two cuts each document at
the multiples of the window: no row needs another row, so nothing is shuffled and no group is ever gathered.

Nulls and empty texts are documents with only the end id; a null id is carried. Repeated rows are documents of their
own. A very long text is encoded whole by the tokenizer file, and cut into as many pieces as it fills windows. An empty
table gives no pieces. There are no ties: offsets follow the scan partitions and the rows in them. Other columns of the
input are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW = 2048
END_ID = 1
#: Texts with other characters go to the reference implementation of the vocabulary, so that both agree on character classes.
_LATIN = re.compile(r"[^\x00-ɏ‐-‧]")
#: Longer texts go to it as well: the ranks' pattern engine has a bounded stack, and its merging is quadratic in a run without a break.
_LONG = 100_000
_loaded: dict = {}


def encoder(name: str, fast: str | None):
    """text -> ids. ``name`` is the tokenizer file; ``fast`` the same vocabulary as ranks, which gives the same ids sooner."""
    if (name, fast) not in _loaded:
        import public_tokenizers as P
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(P.path(name))
        plain = lambda text: slow.encode(text, add_special_tokens=False).ids
        if fast:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(fast), "rb"))}
            special = {t.content: i for i, t in slow.get_added_tokens_decoder().items()}
            quick = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens=special)

            def both(text: str) -> list[int]:
                if len(text) > _LONG or _LATIN.search(text):
                    return plain(text)
                try:
                    return quick.encode(text, allowed_special="all")
                except ValueError:  # its pattern engine gives up on long runs of one kind
                    return plain(text)

            _loaded[name, fast] = both
        else:
            _loaded[name, fast] = plain
    return _loaded[name, fast]


def tokenized(docs: DataFrame, tokenizer: str, fast: str | None, end_id: int) -> DataFrame:
    """Pass one: (part, local_start, doc_id, doc_tokens, ids), ids as little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(tokenizer, fast), TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, size, i = batch.num_rows, 0, 0
            ids: list[bytes] = []
            for j, text in enumerate(batch.column(1)):
                ids.append(np.array([*encode(text.as_py() or ""), end_id], "<u4").tobytes())
                size += len(ids[-1])
                if size > 8 << 20 or j == rows - 1:
                    n = np.array([len(x) // 4 for x in ids], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(n), part, np.int32)), pa.array(at + np.cumsum(n) - n), batch.column(0).slice(i, len(n)), pa.array(n), pa.array(ids, pa.binary())],
                        ["part", "local_start", "doc_id", "doc_tokens", "ids"],
                    )
                    at += int(n.sum())
                    i, ids, size = j + 1, [], 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"part int, local_start long, doc_id {kind}, doc_tokens long, ids binary")


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str = "byte_bpe_50k.json", fast: str | None = "byte_bpe_50k.tiktoken", end_id: int = END_ID) -> DataFrame:
    """Pieces of documents in sequences of ``window`` tokens; all sequences but the last are full.

    Returns doc_id, doc_tokens, start, length, ids (binary, little-endian unsigned 32-bit), sequence_id, offset.
    """
    spark = docs.sparkSession
    tokens = stored(tokenized(docs, tokenizer, fast, end_id), "tokens")
    totals = sorted((r[0], r[1]) for r in tokens.groupBy("part").agg(F.sum("doc_tokens")).collect())  # one row a scan partition
    base, rows = 0, []
    for part, n in totals:
        rows.append((part, base))
        base += n
    # one row of 12 bytes a scan partition, whatever the rows hold
    offsets = F.broadcast(spark.createDataFrame(rows, "part int, base long"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, n = (batch.column(k).to_numpy() for k in ("begin", "doc_tokens"))
            first = begin // window
            pieces = (begin + n - 1) // window - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            lo, hi = np.maximum(begin[row], seq * window), np.minimum((begin + n)[row], (seq + 1) * window)
            blobs = batch.column("ids")
            held, views, ids = -1, None, []
            for r, a, b in zip(row.tolist(), (lo - begin[row]).tolist(), (hi - begin[row]).tolist()):
                if r != held:
                    held, views = r, blobs[r].as_py()
                ids.append(views[4 * a : 4 * b])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(n[row]), pa.array(lo - begin[row]), pa.array(hi - lo), pa.array(ids, pa.binary()), pa.array(seq), pa.array(lo - seq * window)],
                ["doc_id", "doc_tokens", "start", "length", "ids", "sequence_id", "offset"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = tokens.join(offsets, "part").select("doc_id", "doc_tokens", (F.col("base") + F.col("local_start")).alias("begin"), "ids")
    return placed.mapInArrow(cut, f"doc_id {kind}, doc_tokens long, start long, length long, ids binary, sequence_id long, offset long")


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The padded windows themselves: sequence_id, n_tokens, ids, and the starts of documents inside (at most ``window`` pieces each)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "start", F.hex("ids").alias("ids"))))
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: p["ids"]), ""))
    size = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["length"])
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(window) - F.col("n_tokens")).cast("int")))
    return (
        pieces.groupBy("sequence_id").agg(parts.alias("parts")).withColumn("n_tokens", size)
        .select("sequence_id", "n_tokens", F.concat(joined, pad).alias("ids"), F.transform(F.filter("parts", lambda p: p["start"] == 0), lambda p: p["offset"]).alias("document_starts"))
    )
