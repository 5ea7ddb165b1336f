"""Counterfactual-regularised toxicity classifier.

A logistic model over the distinct words of a text and their beginnings. It is fitted on a bounded sample of labelled
rows; for each sampled text that names an identity group, the terms are swapped for others of their set, and the squared
change of the logit is added to the loss. Weights that only follow the mention of a group are so driven to those of the
other groups, and together with the shrinkage to none at all, while insulting words keep theirs.

The sample is fitted on the driver: ``MAX_ROWS`` rows with at most ``KEEP`` features each, which are chosen on the cluster,
whatever the corpus holds. Scoring is one pass over whole texts without a shuffle. A null or empty text, or one without
letters, scores the bias. Null labels and null ids are not learned from; a doc_id labelled twice counts as toxic if it is
toxic once, and of documents with one id the text with the least hash is learned from, while each gets a score. Ties
between features go to the smaller number. Without labels of both classes the score is the smoothed share of toxic
labels. An empty table gives an empty one. ``score`` keeps all columns and adds one of the name given, which must be new.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALPHA, U64, hashes, slices, spans, stored, texts

MAX_ROWS, KEEP = 6000, 4096
BITS = 20
THRESHOLD = 0.3
#: Sets of identity terms; a term is swapped for another of its own set.
IDENTITY = (
    ("women", "men", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslime", "christen", "juden", "musulmans", "chrétiens", "juifs", "musulmanes", "cristianos", "judíos"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("immigrants", "citizens", "refugees", "migrants", "foreigners", "locals"),
    ("old", "young", "elderly", "disabled"),
)


def _word_hash(words: list[str]) -> np.ndarray:
    parts = [w.encode() for w in words]
    ends = np.cumsum([len(p) for p in parts])
    return hashes(np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts], ends)


def groups() -> dict[int, np.ndarray]:
    """Word hash of an identity term -> hashes of the others of its set."""
    out: dict[int, np.ndarray] = {}
    for terms in IDENTITY:
        own = _word_hash(list(terms))
        for k, h in enumerate(own.tolist()):
            out.setdefault(h, np.delete(own, k))
    return out


def features(buf: np.ndarray, bounds: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers and their rows (repeats included), and the words' hashes and rows.

    A word's features are itself and its first four, five and six bytes; the beginnings of a word share no number with a word on purpose."""
    s, e, row = spans(buf, bounds, ALPHA)
    whole = hashes(buf, s, e)
    feats, rows = [whole], [row]
    for n in (4, 5, 6):
        long = np.flatnonzero(e - s > n)
        feats.append(hashes(buf, s[long], s[long] + n) ^ U64(0x5851F42D4C957F2D + n))
        rows.append(row[long])
    return (np.concatenate(feats) >> U64(64 - bits)).astype(np.uint32), np.concatenate(rows), whole, row


def term_features(bits: int = BITS) -> dict[int, np.ndarray]:
    """Word hash of an identity term -> all its features, the word's and its beginnings'."""
    out = {}
    for term in {t for terms in IDENTITY for t in terms}:
        buf = np.frombuffer(term.encode(), np.uint8)
        feat, _, whole, _ = features(buf, np.array([0, len(buf)]), bits)
        out[int(whole[0])] = feat
    return out


def swapped(feat: np.ndarray, whole: np.ndarray, swaps: dict[int, np.ndarray], own: dict[int, np.ndarray]) -> tuple[list[int], list[int]]:
    """Features that a text loses and gains when its identity terms are swapped: those that its other words do not give as well.

    feat, whole: the text's features and words with repeats. own: term_features."""
    named, times = np.unique(whole[np.isin(whole, np.array(sorted(swaps), U64))], return_counts=True)
    numbers, count = np.unique(feat, return_counts=True)
    new = []
    for k, (h, n) in enumerate(zip(named.tolist(), times.tolist(), strict=True)):
        np.subtract.at(count, np.searchsorted(numbers, own[h]), n)
        new.append(own[int(swaps[h][(len(whole) + k) % len(swaps[h])])])
    after = np.union1d(numbers[count > 0], np.concatenate(new)) if new else numbers
    return np.setdiff1d(numbers, after).tolist(), np.setdiff1d(after, numbers).tolist()


@dataclass
class Model:
    bias: float
    numbers: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bits: int = BITS

    def logits(self, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        n = len(bounds) - 1
        out = np.full(n, self.bias)
        if not len(self.numbers):
            return out
        for i, j in slices(bounds):
            own = bounds[i : j + 1] - bounds[i]
            feat, row, _, _ = features(buf[bounds[i] : bounds[j]], own, self.bits)
            at = np.searchsorted(self.numbers, feat)
            at[at == len(self.numbers)] = 0
            hit = self.numbers[at] == feat
            pair = np.unique(row[hit] * len(self.numbers) + at[hit])  # presence, not counts
            out[i:j] += np.bincount(pair // len(self.numbers), self.weights[pair % len(self.numbers)], minlength=j - i)
        return out


def held_out(column="doc_id"):
    """Whether crc32(doc_id as text) mod 4 is 2; a null id is not."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


SAMPLED = "toxic int, features array<int>, lost array<int>, won array<int>"


def sample(docs: DataFrame, labels: DataFrame, max_rows: int, bits: int) -> DataFrame:
    """Distinct features and swapped-out terms of at most max_rows labelled texts, chosen by a hash of their id."""
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    half = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows // 2) for y in (0, 1)]
    chosen = F.broadcast(half[0].unionByName(half[1]))  # max_rows rows of two numbers
    # an id that stands repeatedly is one row: its least text by hash, found before the shuffle
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swaps, terms, kind = groups(), term_features(bits), pa.list_(pa.int32())
        for batch in batches:
            buf, bounds = texts(batch.column(1))
            toxic = batch.column(0).to_pylist()
            for i in range(batch.num_rows):
                own = buf[bounds[i] : bounds[i + 1]]
                feat, _, whole, _ = features(own, np.array([0, len(own)]), bits)
                lost, won = swapped(feat, whole, swaps, terms)
                cells = [pa.array([toxic[i]], pa.int32()), pa.array([np.unique(feat).astype(np.int32)], kind), pa.array([lost], kind), pa.array([won], kind)]
                yield pa.RecordBatch.from_arrays(cells, ["toxic", "features", "lost", "won"])

    return rows.select("toxic", "x.text").mapInArrow(run, SAMPLED)


def telling(rows: DataFrame, keep: int, least: float = 2.5) -> list[int]:
    """At most ``keep`` features that tell the classes apart more than their sampling error does, sorted."""
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n, m = size.get(1, 0), size.get(0, 0)
    if not n or not m:
        return []
    seen = rows.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n")).filter("n >= 3")
    p, q = (F.col("pos") + 0.5) / (n + 1), (F.col("n") - F.col("pos") + 0.5) / (m + 1)
    z = F.abs(p - q) / F.sqrt(p * (1 - p) / (n + 1) + q * (1 - q) / (m + 1))
    return sorted(r["f"] for r in seen.withColumn("z", z).filter(F.col("z") > least).orderBy(F.desc("z"), "f").limit(keep).collect())


def cells(rows: pa.Table, name: str, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place among the chosen features of each number in a column of lists."""
    parts = [x for x in rows.column(name).chunks if len(x)]
    n = np.concatenate([np.zeros(0, np.int64), *(np.diff(x.offsets.to_numpy()) for x in parts)])
    numbers = np.concatenate([np.zeros(0, np.int32), *(x.flatten().to_numpy() for x in parts)])
    at = np.searchsorted(chosen, numbers)
    known = np.append(chosen, -1)[at] == numbers
    return np.repeat(np.arange(len(n)), n)[known], at[known]


def fit(rows: pa.Table, chosen: list[int], bits: int = BITS, shrink: float = 1e-3, fairness: float = 1.0, steps: int = 300, base_rate: float | None = None) -> Model:
    """Minimise log loss + shrink * |w|^2 + fairness * the mean, over the texts whose score can change, of the squared change of the logit under swapped identity terms."""
    y = rows.column("toxic").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.05
        return Model(float(np.log(share / (1 - share))), bits=bits)
    row, col = cells(rows, "features", np.array(chosen, np.int64))
    # the change of each feature under the swap
    lost, won = (cells(rows, c, np.array(chosen, np.int64)) for c in ("lost", "won"))
    crow, ccol = (np.concatenate([a, b]) for a, b in zip(lost, won, strict=True))
    cval = np.repeat([-1.0, 1.0], [len(lost[0]), len(won[0])])
    n, d, named = len(y), len(chosen), max(1, len(np.unique(crow)))
    rate = float(y.mean()) if base_rate is None else base_rate
    weight = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))
    w, b = np.zeros(d), float(np.log(rate / (1 - rate)))
    m1, m2 = np.zeros(d + 1), np.zeros(d + 1)
    for t in range(1, steps + 1):  # Adam on the whole sample
        logit = b + np.bincount(row, w[col], minlength=n)
        err = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / n
        change = np.bincount(crow, cval * w[ccol], minlength=n)
        grad = np.bincount(col, err[row], minlength=d) + 2 * shrink * w + 2 * fairness / named * np.bincount(ccol, cval * change[crow], minlength=d)
        g = np.append(grad, err.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(float(b), np.array(chosen, np.uint32), w, bits)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS, keep: int = KEEP, **options) -> Model:
    """The model of a bounded sample: at most max_rows rows with at most ``keep`` features each reach the driver."""
    rows = stored(sample(docs, labels, max_rows, bits), "sample")
    chosen = telling(rows, keep)
    of = lambda c: F.array_intersect(c, F.from_json(F.lit(str(chosen)), "array<int>")).alias(c)
    held = rows.select("toxic", *map(of, ("features", "lost", "won"))).toArrow()
    y = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    return fit(held, chosen, bits, base_rate=min(max(y, 1e-3), 1 - 1e-3) if y is not None else None, **options)


def score(docs: DataFrame, model: Model, name: str = "score", text: str = "text") -> DataFrame:
    """The documents with one more column, the probability that a text is toxic."""
    schema = docs.schema
    at = schema.fieldNames().index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, bounds = texts(batch.column(at))
            p = 1 / (1 + np.exp(-np.clip(model.logits(buf, bounds), -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*batch.schema.names, name])

    return docs.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, `{name}` double")
