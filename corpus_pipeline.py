"""The corpus pipeline: language, toxicity, near duplicates, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet into the shared folder and reads it back as the next stage's documents. All stages but
the last return the columns of documents.

Rows are told apart by their number in the stage's scan of docs, not by doc_id: rows with a null
or a repeated id are documents of their own in every stage. docs must therefore be a table as it
is read (whose scan numbers its rows alike each time), which it is as each stage's result is written.

Edge cases, in every stage: an empty table gives an empty result; null texts are documents without
words; columns beyond those of documents are carried along, whatever their names. Language ID
rejects texts that are null or have no letter; toxicity keeps them; near duplicates keep them all;
the mix never takes documents without words; packing gives each its end id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import langid, mixing, neardup, packing, toxicity
from siftwell.llm.common import fresh, written

#: A document is rejected as of no language if it has no letters, or if its best language has
#: less than this share of its letters.
LEAST_SHARE = 0.35
#: Near duplicates share this percentage of their five-word shingles at least.
NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    kept = {c: fresh(docs, c) for c in docs.columns if c.lower() in ("lang_pred", "score")}  # names that the operator gives its results
    found = langid.identify(docs.withColumnsRenamed(kept), langid.train(docs))
    rows = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return rows.select([F.col(kept.get(c, c)).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    name = fresh(docs, "toxicity_score")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, name).where(F.col(name) < toxicity.THRESHOLD).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the first in the table."""
    row = fresh(docs, "near_row")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    found = neardup.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), NEAR_PERCENT)
    gone = found.where("not kept").select(F.col("doc_id").alias(row))
    return rows.join(gone, row, "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times, in the order of virtual finish time."""
    return mixing.mixed_stream(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences; written here, so that texts reach the workers in small batches."""
    return written(packing.packed(docs, public_tokenizers.path("word_bpe_49k.json")), "pipeline-packing")


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language ID and toxicity are learned, packing follows a tokenizer: not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
