"""Session set-up: defaults for own sessions, and shipping the package to the executors' Python."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Arrow batches are bounded by bytes, not only by rows: 10,000 long texts at once would take hundreds of MB a task.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects; ``conf`` names use ``_`` for ``.``."""
    builder = SparkSession.builder.appName("docsieve")
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python this package, once a context: workers need not find it on a path of their own.

    A session that does not bound its Arrow batches in bytes gets a bound."""
    sc = spark.sparkContext
    if BATCH[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH)
    if not getattr(sc, "_docsieve_shipped", False):
        here = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="docsieve-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        name = os.path.join(folder, "docsieve.zip")
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as out:
            for path in sorted(here.rglob("*.py")):
                out.write(path, path.relative_to(here.parent))
        sc.addPyFile(name)
        sc._docsieve_shipped = True
    return spark
