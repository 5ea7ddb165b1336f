"""Shared plumbing: reading tables, durable intermediate tables, byte-level tokenising."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import ship

U64 = np.uint64


try:
    _LIBC = ctypes.CDLL(None)
    _LIBC.malloc_trim, _LIBC.mallopt  # noqa: B018
except (OSError, AttributeError):  # not the GNU library
    _LIBC = None
if _LIBC:
    _LIBC.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD: smaller arrays reuse memory instead of mapping it anew
    _LIBC.mallopt(-1, 256 << 20)  # M_TRIM_THRESHOLD
    pa.set_memory_pool(pa.system_memory_pool())


def _lean(f, *tables):
    try:
        return f(*tables)
    finally:
        if _LIBC:
            _LIBC.malloc_trim(0)


def lean(f):
    """A function of one or two Arrow tables after which the process gives its free memory back.

    Python workers live as long as their executor and run one stage after another; what one group needed would stay theirs."""
    return (lambda table: _lean(f, table)) if f.__code__.co_argcount == 1 else (lambda table, back: _lean(f, table, back))

# --------------------------------------------------------------------------- tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by name."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``; where it is unset, one of our own on a local master, an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return str(held.get()).rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="docsieve-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/docsieve-{uuid.uuid4().hex}/{name}"


_written: list[str] = []


def _removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete the folders of scratch tables."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place.getParent(), True)


@atexit.register
def _swept() -> None:
    """What is still stored when the driver ends goes, if the session is still there."""
    spark = SparkSession.getActiveSession() if _written else None
    if spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):
            _removed(spark, _written)


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Tables that are stored inside go at the end, and shuffle files that only they needed: settle what is to stay before."""
    held = len(_written)
    try:
        yield
    finally:
        _removed(spark, _written[held:])
        del _written[held:]
        freed(spark)


def freed(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of frames that nothing refers to any more; else it waits until memory runs short."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str = "table", codec: str = "zstd") -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back: it survives lost executors and its size is known.

    The shuffle files that made it are freed unless the caller still holds a frame of theirs."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _written.append(path)
    df.write.option("compression", codec).parquet(path)
    schema = df.schema
    del df
    freed(spark)
    return spark.read.schema(schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage of a narrow table with a reliable checkpoint in the shared folder."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


# --------------------------------------------------------------------------- bytes

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**64 - 1, size=256, dtype=U64, endpoint=False)
_R = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_R_INV = pow(_R, -1, 2**64)
BLOCK = 1 << 19

#: ASCII letters and digits, and every byte of a multi-byte character.
ALNUM = np.zeros(256, bool)
ALNUM[0x80:] = ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
#: ASCII letters, and every byte of a multi-byte character.
ALPHA = ALNUM.copy()
ALPHA[0x30:0x3A] = False
#: Everything but the six ASCII white-space bytes.
NONSPACE = np.ones(256, bool)
NONSPACE[0x20] = False
NONSPACE[0x09:0x0E] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("p", ())) < n:
        n = max(n, BLOCK + 1)
        _tables["p"], _tables["q"] = _powers(_R, n), _powers(_R_INV, n)
    return _tables["p"], _tables["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the bounds of its rows in them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    bounds = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8).copy() if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    first = bounds[0]
    buf = np.frombuffer(data, np.uint8)[first : bounds[-1]] if data is not None and bounds[-1] > first else np.zeros(0, np.uint8)
    return buf, bounds - first


def slices(bounds: np.ndarray, target: int = 1 << 21):
    """Runs of rows of about ``target`` bytes, as (first row, end row)."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + target, "right")) - 1)
        yield i, j
        i = j


def spans(buf: np.ndarray, bounds: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of a kind, none across rows: starts, ends and the row of each."""
    w = kind[buf]
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    start, end = w.copy(), w.copy()
    start[1:] &= ~w[:-1]
    end[:-1] &= ~w[1:]
    full = bounds[1:] > bounds[:-1]
    first, last = bounds[:-1][full], bounds[1:][full] - 1
    start[first], end[last] = w[first], w[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(bounds, s, "right") - 1


def hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each byte run [s, e); runs are ordered by start. With fold, A-Z count as a-z."""
    out = np.zeros(len(s), U64)
    value = _BYTE[LOWER] if fold else _BYTE
    i = 0
    while i < len(s):
        at = s[i]
        j = max(i + 1, int(np.searchsorted(s, at + BLOCK, "left")))
        until = int(e[i:j].max())
        p, q = powers(until - at + 1)
        total = np.zeros(until - at + 1, U64)
        np.cumsum(value[buf[at:until]] * p[: until - at], out=total[1:])
        a, b = s[i:j] - at, e[i:j] - at
        out[i:j] = mix((total[b] - total[a]) * q[a] + (b - a).astype(U64) * U64(0xD6E8FEB86659FD93))
        i = j
    return out


def shingles(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of n words (a row of fewer words, but some, has its whole sequence as its one run) and their rows."""
    if not len(words):
        return words, row
    m = len(words)
    total = np.zeros(m, U64)
    for k in range(n):
        total[: m - k] += words[k:] * U64(pow(0xA0761D6478BD642F, k, 2**64))
    last = np.zeros(m, bool)
    if m >= n:
        last[: m - n + 1] = row[: m - n + 1] == row[n - 1 :]
    out, own = mix(total[last]), row[last]
    size = np.bincount(row)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        first = np.searchsorted(row, short)
        extra = []
        for r, f in zip(short, first):
            x = np.full(1, 0x1234567, U64)
            for k in range(size[r]):
                x = mix(x + words[f + k : f + k + 1] * U64(0xE7037ED1A0B428DB))
            extra.append(x)
        out, own = np.concatenate([out, *extra]), np.concatenate([own, short])
        order = np.argsort(own, kind="stable")
        out, own = out[order], own[order]
    return out, own
