"""The corpus pipeline: documents to packed token sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read as the next one's docs.
All but the last return the columns of documents, whatever their names: what a stage computes is nested beside them or
joined by hashes. Rows are told apart by their id and a hash of their text, so ids may be null or repeated; rows equal in
both are copies of one document. Null and empty texts are clean documents of no words. Very long texts are read whole. Of
ties (equal ids in a group) one row stays. An empty table goes through all stages empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsieve.llm import decontaminate, jaccard, packing, suffixes, toxicity
from docsieve.llm.common import scratch_path, settled, table, temporary
from docsieve.llm.words import ascii_lower
from docsieve.session import ship


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    nested = docs.select(F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("row"))
    return toxicity.score(nested, model).filter(F.col("score") < toxicity.THRESHOLD).select("row.*")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, once."""
    ship(spark)
    with temporary(spark):
        found = jaccard.joined(docs)
        kept = settled(found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "mark").distinct())
        del found
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("doc_id", F.col("text").cast("string")).alias("own"))
    here = (F.col("own") == F.col("mark")) & F.col("row.doc_id").eqNullSafe(F.col("doc_id"))
    return rows.join(kept, here, "left_semi").withColumn("id", F.col("row.doc_id")).dropDuplicates(["own", "id"]).select("row.*")


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings and passages of over 50 words that repeat are cut out of the texts; a character that loses a byte goes with it."""
    ship(spark)
    found = suffixes.removed(docs, carry=True, passages=True)
    own = {c: F.col(f"rest.`{c}`") for c in docs.columns if c != "text"}
    if "n_chars" in own:
        own["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return found.select(*[(F.col("kept_text") if c == "text" else own[c]).alias(c) for c in docs.columns])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    with temporary(spark):
        gone = settled(decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("own"))
    here = (F.col("own") == F.col("mark")) & F.col("row.doc_id").eqNullSafe(F.col("doc_id"))
    return rows.join(decontaminate.small(gone, decontaminate.MOST), here, "left_anti").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, with their ids."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard", jaccard_stage),
    ("suffix_dedup", suffix_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
#: Training, hashing of sets and suffixes, and tokenising have no SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
