"""Record files as a stream: parse, drop repeated ids within the watermark, upsert by key.

The parsers are functions of DataFrames, so the batch operators serve the stream as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import parsing

SCHEMA = "enc_oid bigint, arrived timestamp, admission string, discharge string"


def record_stream(spark: SparkSession, folder: str, delay: str = "1 hour") -> DataFrame:
    """JSON-lines files -> records, each id once within the delay."""
    rows = spark.readStream.schema(SCHEMA).json(folder)
    return rows.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["enc_oid"])


def drug_stream(records: DataFrame) -> DataFrame:
    """Admission drugs of arriving records with their tier."""
    return parsing.admission_items(records.select("enc_oid", "arrived", F.col("admission").alias("text")))


def tier_counts(drugs: DataFrame, window: str = "1 hour") -> DataFrame:
    return drugs.groupBy(F.window("arrived", window).alias("w"), "tier").agg(F.count("*").alias("n")).select("w.start", "tier", "n")


def upsert(path: str):
    """A foreachBatch function: a batch's rows replace a path's rows of the same id.

    Each batch is a folder of its own, so a batch that runs twice overwrites itself; ``latest``
    reads the newest row of each id.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:08d}")

    return run


def latest(spark: SparkSession, path: str, key: str = "enc_oid") -> DataFrame:
    from ..operators.search import first_of

    return first_of(spark.read.option("basePath", path).parquet(path), [key], [F.desc("batch")])
