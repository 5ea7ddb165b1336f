"""The same operators over streams."""

from pyspark.sql import functions as F

from docsieve.streaming import reports

from .conftest import SF


def test_event_windows(spark, tmp_path):
    source = str(tmp_path / "events")
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    query = reports.event_windows(stream).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    batch = reports.event_windows(spark.read.parquet(source))
    assert spark.table("windows").agg(F.sum("n")).first()[0] == batch.agg(F.sum("n")).first()[0] == spark.read.parquet(source).count()


def test_scored_stream(spark, tmp_path):
    source = str(tmp_path / "docs")
    spark.read.parquet(f"{SF}/documents.parquet").limit(5).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    query = reports.scored_stream(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).select("doc_id").distinct().count() == 5
