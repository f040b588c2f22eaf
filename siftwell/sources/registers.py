"""Keyed registers: run fingerprints, resumable work, cached responses, file fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(config: Column) -> Column:
    """SHA-256 of a struct's JSON."""
    return F.sha2(F.to_json(config), 256)


def remaining(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of work that no stored result has."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def open_run(spark: SparkSession, path: str, name: str, configuration: str) -> bool:
    """Register a run's configuration; True for a new run, False to resume; another one is refused."""
    mark = spark.range(1).select(F.sha2(F.lit(configuration), 256)).first()[0]
    try:
        old = spark.read.parquet(path).where(F.col("name") == name).select("fingerprint").distinct().collect()
    except Exception as e:  # no register yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        old = []
    if not old:
        spark.createDataFrame([(name, mark)], "name string, fingerprint string").write.mode("append").parquet(path)
        return True
    if {r.fingerprint for r in old} != {mark}:
        raise ValueError(f"run {name} was started with another configuration")
    return False


def cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answered, missing): requests(key struct columns) joined to cache(fingerprint, model, response)."""
    keyed = requests.withColumn("fingerprint", fingerprint(F.struct(*requests.columns)))
    return keyed.join(cache, "fingerprint"), keyed.join(cache.select("fingerprint"), "fingerprint", "left_anti")


def replay(requests: DataFrame, cache: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(parsed, errors): cached responses parsed by a schema; those that don't parse go to errors."""
    hit, missing = cached(requests, cache)
    p = hit.withColumn("parsed", F.from_json("response", schema, {"mode": "PERMISSIVE"}))
    bad = F.col("parsed").isNull() | F.forall(F.array(*[F.col(f"parsed.{c.split(' ')[0]}").isNull() for c in schema.replace("struct<", "").split(", ")]), lambda x: x)
    errors = p.where(bad).select(*requests.columns, F.lit("unreadable").alias("error")).unionByName(missing.select(*requests.columns, F.lit("no response").alias("error")))
    return p.where(~bad).drop("response"), errors


def within_budget(costs: DataFrame, order: str, cost: str, cap: float) -> DataFrame:
    """Requests in order until their running cost passes the cap (a log of one run)."""
    from pyspark.sql import Window

    total = F.sum(cost).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return costs.withColumn("spent", total).where(F.col("spent") <= cap)


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, read by Spark wherever they lie."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
