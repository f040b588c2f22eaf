"""Shared helpers: the folder all executors share, written tables, held-out rule."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..store import shared_dir  # noqa: F401


def by_value(name: str) -> None:
    """Pickle a module's functions by value, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


#: Arrow batches of what is written on the way: bytes and rows.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


def written(df: DataFrame, name: str) -> DataFrame:
    """``store.written`` with small Arrow batches while it writes, so that several batches of texts or sets
    fit beside each other in JVM and workers; the session's settings are then as before."""
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in BATCH}
    try:
        for k, v in BATCH.items():
            conf.set(k, v)
        return store.written(df, name)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def release() -> None:
    """Give freed memory of this Python worker back to the system; workers outlive their tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text, modulo 4, is 2 (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker process."""
    return sys.__dict__.setdefault("_siftwell_cache", {})


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts: one number, by which ranges and tasks are sized."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs has not (Spark ignores case)."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name
