"""Exact removal of repeated strings with suffix sorting.

A byte goes if some string of ``length`` bytes over it starts anywhere else in the corpus, in the same document or
another. Every such string (a window) has one anchor: of its runs of ``anchor`` bytes the one with the least hash, the
last on a tie. Equal windows have equal anchors at equal places, so only windows under a shared anchor need a look.

Neighbouring windows of one anchor form a stretch. First the stretches are counted over the corpus by (anchor, content):
one that is there twice goes whole, and one whose anchor nobody shares stays. What is left are anchors under which
a stretch that is there once meets others, at the ends of a passage or beside an edit. There the windows themselves are
suffix-sorted within a chunk (deep-shallow: multikey quicksort on words of eight bytes to a shallow depth, blind tries
for the groups that are still equal). Windows that agree for ``length`` bytes in that order are a class; the classes are
counted over the corpus, and each window reads the total of its class. All counts go through hash buckets with one entry
a chunk and key, so a passage that a third of all documents share is as cheap as any other.

The same is done with words (runs of other than ASCII white space) in place of bytes: a passage is ``words`` consecutive
words that another document holds too. Such words are reported, and cut with ``passages``, but change no byte figure.

Null texts are empty, nothing is removed from a text shorter than ``length`` bytes, matches never cross documents, and
all is judged on the input. Repeated rows are documents like any other: they remove each other. An empty table gives an
empty one. Ties (equal windows) are one class. A text larger than a chunk makes a chunk of its own size: a document is
never split. Other columns are read only with ``carry``, which nests them in one struct, so no name of theirs clashes.
Between chunks strings are told apart by hashes of their bytes, of 128 bits (stretches) and 88 bits (windows).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .chunks import SENT, answered, chunked, read_back, sent, sent_table
from .common import _BYTE, NONSPACE, U64, hashes, lean, mix, powers, spans, texts

LENGTH, ANCHOR, SHALLOW = 400, 200, 2
#: More than 50 words.
WORDS = 51
STRETCHES, WINDOWS = 0, 1
_STEP = 1 << 18
_OTHER = mix(_BYTE + U64(1))
_LOW = U64((1 << 20) - 1)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, U64(2**64 - 1), U64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def ordered(table: pa.Table) -> pa.Table:
    """A chunk's rows in an order of their own: a shuffle brings them in any order, and stretches are cut by place."""
    return table.take(pa.array(np.argsort(table.column("mark").to_numpy(), kind="stable")))


def digests(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """128-bit hashes of byte runs [first, end), as rows of two numbers."""
    view, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(view[i:j]) for i, j in zip(first.tolist(), end.tolist())]), U64).reshape(-1, 2)


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the keys, the first before all others; the first place of each distinct key in that order; and each row's number among them."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        own = k[order]
        new[1:] |= own[1:] != own[:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), number


class Stretches:
    """A chunk's stretches: first and last window, anchor hash, and which of the distinct (anchor, content) each is.

    data: the bytes of all symbols, ``width`` each (8: a word's hash); bounds: of the documents, in symbols."""

    def __init__(self, data: np.ndarray, width: int, bounds: np.ndarray, length: int, anchor: int):
        self.data, self.width, self.bounds, self.length = data, width, bounds, length
        value: Callable = (lambda i, j: _BYTE[data[i:j]]) if width == 1 else (lambda i, j: data.view(U64)[i:j])
        n = len(data) // width
        edge = np.zeros(n + 1, np.int8)
        long = bounds[1:] - bounds[:-1] >= length
        edge[bounds[:-1][long]] += 1
        edge[bounds[1:][long] - length + 1] -= 1
        valid = np.cumsum(edge[:n], dtype=np.int8).astype(bool)  # where a window starts
        parts = []
        for i in range(0, n, _STEP):
            here = valid[i : i + _STEP]
            if not here.any():
                continue
            m = int(np.flatnonzero(here)[-1]) + 1
            raw = value(i, i + m + length - 1)
            p, q = powers(len(raw) + 1)
            total = np.zeros(len(raw) + 1, U64)
            np.cumsum(raw * p[: len(raw)], out=total[1:])
            gram = mix((total[anchor:] - total[:-anchor]) * q[: len(raw) - anchor + 1])
            low = least((gram & ~_LOW) | (_LOW - np.arange(len(gram), dtype=U64)), length - anchor + 1)
            at = (_LOW - (low & _LOW)).astype(np.int64)
            here = here[:m]
            new = here.copy()
            new[1:] &= ~(here[:-1] & (at[1:] == at[:-1]))
            first = np.flatnonzero(new)
            stop = here.copy()
            stop[:-1] &= ~(here[1:] & (at[1:] == at[:-1]))
            parts.append((first + i, np.flatnonzero(stop) + i, gram[at[first]]))
        self.first, self.last, anchors = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64))
        content = self.digests(self.first, self.last + length)
        order, lead, self.kind = grouped(anchors, content[:, 0], content[:, 1])
        self.sample = order[lead]  # one stretch of each kind
        self.keys, self.contents = anchors[self.sample], content[self.sample]

    def digests(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return digests(self.data, first * self.width, end * self.width)

    def names(self, at: np.ndarray) -> np.ndarray:
        """Two 64-bit hashes of the window at each place, by rolling sums over two tables of symbol values."""
        out = np.zeros((len(at), 2), U64)
        block = at // _STEP
        for k in np.unique(block).tolist():
            own = np.flatnonzero(block == k)
            first = at[own] - k * _STEP
            end = first + self.length
            data = self.data[k * _STEP * self.width : (k * _STEP + int(end.max())) * self.width]
            p, q = powers(int(end.max()) + 1)
            for j in (0, 1):
                value = (_BYTE, _OTHER)[j][data] if self.width == 1 else mix(data.view(U64) + U64(j))
                total = np.zeros(len(value) + 1, U64)
                np.cumsum(value * p[: len(value)], out=total[1:])
                out[own, j] = mix((total[end] - total[first]) * q[first])
        return out

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, "right") - 1

    def times(self, number: np.ndarray, at: np.ndarray, n: int, apart: bool) -> np.ndarray:
        """How often each of n kinds occurs; apart: in how many documents."""
        if apart and len(number):
            docs = len(self.bounds)
            number = np.unique(number * docs + self.document(at)) // docs
        return np.bincount(number, minlength=n)

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All windows of the stretches of the chosen kinds, and the class of each by the suffix order of one stretch of each kind.

        Classes are numbered in that order."""
        own = self.sample[chosen]
        n = self.last[own] - self.first[own] + 1
        begin = np.full(len(self.keys), -1)
        begin[chosen] = np.cumsum(n) - n
        starts = np.repeat(self.first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        order, group = suffix_classes(self.data, starts * self.width, self.length * self.width)
        cls = np.empty(len(starts), np.int64)
        cls[order] = group
        all_own = np.flatnonzero(begin[self.kind] >= 0)
        n = self.last[all_own] - self.first[all_own] + 1
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(self.first[all_own], n) + inside, cls[np.repeat(begin[self.kind[all_own]], n) + inside]


def _word(view: np.ndarray, at: np.ndarray) -> np.ndarray:
    return view[at].view(">u8").ravel().astype(U64)


def suffix_classes(buf: np.ndarray, starts: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``starts`` by their first ``length`` bytes, and for each place in that order its class.

    Suffixes of a class agree for ``length`` bytes. All groups of a depth are treated at once."""
    m = len(starts)
    if not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([buf, np.zeros(16, np.uint8)]), 8)
    order, group = np.arange(m), np.zeros(m, np.int64)
    words = -(-length // 8)
    tail = U64(2**64 - 1) << U64(8 * (8 * words - length))  # the bytes of the last word that count

    def word(who: np.ndarray, d: int) -> np.ndarray:
        w = _word(view, starts[who] + 8 * d)
        return w & tail if d == words - 1 else w

    # shallow: ternary partitions by one word after another
    for d in range(min(shallow, words)):
        w = word(order, d)
        step = np.lexsort((w, group))
        order, group, w = order[step], group[step], w[step]
        group = np.cumsum(np.r_[True, (group[1:] != group[:-1]) | (w[1:] != w[:-1])]) - 1
    depth = np.full(m, shallow, np.int64)
    size = np.bincount(group)
    active = size[group] > 1
    if shallow >= words:
        active[:] = False
    settled = ~active
    # deep: each group's first suffix is a path; the others leave it at their first differing byte
    while True:
        at = np.flatnonzero(~settled)
        if not len(at):
            break
        g = group[at]
        new = np.r_[True, g[1:] != g[:-1]]
        lead = at[np.flatnonzero(new)][np.cumsum(new) - 1]
        mismatch = np.full(len(at), length, np.int64)
        branch = np.zeros(len(at), np.int64)
        side = np.zeros(len(at), np.int64)
        going = np.flatnonzero(~new)
        at_word = depth[at].copy()
        while len(going):
            d = at_word[going]
            offset = 8 * d
            x, y = _word(view, starts[order[at[going]]] + offset), _word(view, starts[order[lead[going]]] + offset)
            final = d == words - 1
            x[final] &= tail
            y[final] &= tail
            diff = x ^ y
            off = np.flatnonzero(diff)
            if len(off):
                byte = np.zeros(len(off), np.int64)
                rest = diff[off]
                for shift in (32, 16, 8):
                    high = (rest >> U64(64 - shift)) == 0
                    byte[high] += shift // 8
                    rest = np.where(high, rest << U64(shift), rest)
                who = going[off]
                mismatch[who] = offset[off] + byte
                branch[who] = ((x[off] >> (U64(56) - U64(8) * byte.astype(U64))) & U64(255)).astype(np.int64)
                side[who] = np.where(x[off] < y[off], -1, 1)
            at_word[going] += 1
            going = going[(diff == 0) & (at_word[going] < words)]
        # below the path: the earliest to leave come first; above it: the latest
        rank = np.where(side < 0, mismatch, np.where(side > 0, 2 * length + 2 - mismatch, length + 1)) * 256 + np.where(side == 0, 0, branch)
        step = np.lexsort((rank, g))
        order[at], rank, g2 = order[at][step], rank[step], g[step]
        depth[at] = np.where(side == 0, words, mismatch // 8)[step]
        whole = side[step] == 0
        split = np.r_[True, (g2[1:] != g2[:-1]) | (rank[1:] != rank[:-1])]
        # new group numbers that keep the order among all
        fresh = np.r_[True, group[1:] != group[:-1]]
        fresh[at] = split | fresh[at] if len(at) else fresh[at]
        group = np.cumsum(fresh) - 1
        size = np.bincount(group)
        settled[at] = whole | (size[group[at]] == 1)
    return order, group


def _halves(numbers: np.ndarray) -> np.ndarray:
    """Unsorted 64-bit numbers as pairs of 32-bit ones, which travel as they are."""
    return np.ascontiguousarray(numbers).view(np.uint32).reshape(len(numbers), 2 * (numbers.shape[1] if numbers.ndim > 1 else 1))


def meet(kind: int, cols: list[np.ndarray]) -> list[np.ndarray]:
    """A bucket's answers, totals cut to 2. Stretches: the total of (anchor, content), and whether the anchor has several contents, one of them alone; windows: the total of the class, and its number in its chunk."""
    key, n, more, *own = cols
    if kind % 2 == WINDOWS:
        _, _, number = grouped(key, more)
        return [np.minimum(np.bincount(number, n), 2).astype(np.uint32)[number], *own]
    order, lead, number = grouped(key, *np.ascontiguousarray(more).view(U64).T)
    total = np.minimum(np.bincount(number, n), 2)
    anchors, inverse = np.unique(key[order[lead]], return_inverse=True)
    mixed = (np.bincount(inverse) > 1) & (np.bincount(inverse, total < 2) > 0)
    return [x.astype(np.uint32)[number] for x in (total, mixed[inverse])]


class Chunk:
    """A chunk's documents in an order of their own, with their stretches of bytes (unit 0) and of words (unit 1)."""

    def __init__(self, table: pa.Table, length: int, anchor: int, words: int):
        self.table = ordered(table)
        self.buf, self.bounds = texts(self.table.column("text"))
        self.units = [Stretches(self.buf, 1, self.bounds, length, anchor)]
        if words:
            self.s, self.e, row = spans(self.buf, self.bounds, NONSPACE)
            bounds = np.searchsorted(row, np.arange(len(self.bounds)))
            self.units.append(Stretches(hashes(self.buf, self.s, self.e, fold=False).view(np.uint8), 8, bounds, words, max(1, words // 2)))

    def repeated(self, back: pa.Table, unit: int) -> np.ndarray:
        """Whether each symbol is in a window that occurs elsewhere."""
        c = self.units[unit]
        edge = np.zeros(len(c.data) // c.width + 1, np.int32)
        if len(c.keys):
            total, mixed = read_back(back, 2 * unit + STRETCHES)
            whole = total[c.kind] > 1
            np.add.at(edge, c.first[whole], 1)
            np.add.at(edge, c.last[whole] + c.length, -1)
            if mixed.any():
                at, cls = c.windows(mixed > 0)
                total, own = read_back(back, 2 * unit + WINDOWS)
                totals = np.empty(len(own), np.int64)
                totals[own] = total
                at = at[totals[cls] > 1]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + c.length, -1)
        return np.cumsum(edge[:-1], dtype=np.int32) > 0

    def named(self, unit: int, at: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of the classes by their hashes, and the hashes in it."""
        lead = np.zeros(cls.max(initial=-1) + 1, np.int64)
        lead[cls[::-1]] = at[::-1]
        name = self.units[unit].names(lead)
        order = np.lexsort((name[:, 1], name[:, 0]))
        return order, name[order]


def removed(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, carry: bool = False, words: int = WORDS, passages: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, n_passage_words, spans (array of (start, end) bytes removed), kept (binary): a row for each document.

    n_passage_words: words in passages of ``words`` words that another document holds too (0: not looked for). passages:
    these are removed as well, from the first byte of a passage to its last. With carry also ``rest``, a struct of the
    document's columns but the text, and ``kept_text``, without the bytes that cuts leave of a character."""
    rows, buckets = chunked(docs, carry)
    units = range(2 if words else 1)

    def stretches(table: pa.Table) -> pa.Table:
        chunk, out = Chunk(table, length, anchor, words), []
        for unit in units:
            c = chunk.units[unit]
            counts = c.times(c.kind, c.first, len(c.keys), unit == 1)
            out += sent(table.column("chunk")[0].as_py(), 2 * unit + STRETCHES, c.keys, counts, buckets, _halves(c.contents))
        return sent_table(out)

    first = answered(rows.groupBy("chunk").applyInArrow(lean(stretches), SENT), meet)

    def windows(table: pa.Table, back: pa.Table) -> pa.Table:
        if not table.num_rows or not back.num_rows:
            return sent_table([])
        chunk, out = Chunk(table, length, anchor, words), []
        for unit in units:
            c = chunk.units[unit]
            if len(c.keys) and (mixed := read_back(back, 2 * unit + STRETCHES)[1]).any():
                at, cls = c.windows(mixed > 0)
                order, name = chunk.named(unit, at, cls)
                out += sent(table.column("chunk")[0].as_py(), 2 * unit + WINDOWS, name[:, 0], c.times(cls, at, len(order), unit == 1)[order], buckets, (name[:, 1] >> U64(40)).astype(np.uint32), order.astype(np.uint32))
        return sent_table(out)

    second = answered(rows.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(lean(windows), SENT), meet)

    def cut(table: pa.Table, back: pa.Table) -> pa.Table:
        chunk = Chunk(table, length, anchor, words)
        table, bounds, gone = chunk.table, chunk.bounds, chunk.repeated(back, 0)
        held = np.zeros(len(bounds) - 1, np.int64)
        if words:
            hit, c = chunk.repeated(back, 1), chunk.units[1]
            held = np.diff(np.concatenate([[0], np.cumsum(hit)])[c.bounds])
            if passages and hit.any():
                at = np.flatnonzero(hit)
                doc = c.document(at)
                new = np.r_[True, (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])]
                edge = np.zeros(len(chunk.buf) + 1, np.int8)
                edge[chunk.s[at[new]]] += 1
                edge[chunk.e[at[np.r_[new[1:], True]]]] -= 1
                gone |= np.cumsum(edge[:-1], dtype=np.int8) > 0
        n = np.diff(bounds)
        lost = np.concatenate([[0], np.cumsum(gone)])[bounds]
        lost = lost[1:] - lost[:-1]
        kept, cuts = [], []
        for i, j, x in zip(bounds[:-1].tolist(), bounds[1:].tolist(), lost.tolist()):
            own = chunk.buf[i:j]
            if not x:
                kept.append(own.tobytes()), cuts.append([])
                continue
            mask = gone[i:j]
            turn = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
            kept.append(own[~mask].tobytes()), cuts.append([{"start": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2])])
        pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        out = [table.column("doc_id"), pa.array(n), pa.array(lost.astype(np.int64)), pa.array([len(s) for s in cuts], pa.int64()), pa.array(held), pa.array(cuts, pairs), pa.array(kept, pa.binary())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "n_passage_words", "spans", "kept"]
        if carry:
            out += [table.column("rest"), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())]
            names += ["rest", "kept_text"]
        return pa.Table.from_arrays(out, names)

    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    counts = [StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans", "n_passage_words")]
    kind = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *counts, StructField("spans", ArrayType(span)), StructField("kept", BinaryType())])
    if carry:
        kind = kind.add("rest", rows.schema["rest"].dataType).add("kept_text", StringType())
    return rows.groupBy("chunk").cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(lean(cut), kind)
