"""Streams: documents scored as they come, the latest report of each, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import durable
from ..plans import report


def scored_stream(docs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes through the batch plan and is written with its number, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        with durable.released(batch.sparkSession):
            out = report.check(batch.select("doc_id", "text")).select("doc_id", "readiness", "verdict")
            out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def latest(reports: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The newest report of each document in a stream of (doc_id, at, readiness); reports later than the delay are dropped."""
    held = reports.withWatermark("at", delay)
    return held.groupBy("doc_id").agg(F.max(F.struct("at", "readiness")).alias("last")).select("doc_id", "last.at", "last.readiness")


def event_windows(events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling or sliding windows, with late rows up to the delay."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of each user: a pause of the gap ends one."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
