"""Intermediate tables that survive lost executors: Parquet in the shared folder that the session names."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_held: list[str] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own on a local master and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not hasattr(sc, "_docsieve_folder"):
        sc._docsieve_folder = tempfile.mkdtemp(prefix="docsieve-")
        atexit.register(shutil.rmtree, sc._docsieve_folder, ignore_errors=True)
    return f"file://{sc._docsieve_folder}"


def held(df: DataFrame, name: str) -> DataFrame:
    """The frame, computed once and read back; several plans over it read the table, not what made it."""
    path = f"{folder(df.sparkSession)}/docsieve-{uuid.uuid4().hex}/{name}"
    _held.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _dropped(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def released(spark: SparkSession):
    """Tables held inside go at the end: write the result before."""
    first = len(_held)
    try:
        yield
    finally:
        _dropped(spark, _held[first:])
        del _held[first:]


@atexit.register
def _at_end() -> None:
    spark = SparkSession.getActiveSession() if _held else None
    if spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):
            _dropped(spark, _held)
