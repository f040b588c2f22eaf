"""Extendible hashing into byte-limited shards (native DataFrame operations only).

A document's address is 60 bits of the MD5 of its id and text, and after those 60 bits of
its row number's hash, which tell repeated rows apart. The directory holds, for each bucket,
the bytes below a bit prefix; a bucket within the limit is a shard, and only an oversized
bucket is split on another bit. All bucket sizes down to ``step`` bits come from one
pre-aggregation; only buckets that are too large at that depth go another round.

Edge cases: null text has 0 bytes; a null id is an id of its own; a document larger than the
limit becomes a shard alone (oversize = true), since nothing smaller exists; repeated rows are
spread over shards like any others (which of them goes where hangs on their row numbers, so on how
the table is split into tasks); an empty table gives an empty result; extra columns are written by
``write_shards`` untouched, but for one named shard_id, which is overwritten.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

BITS, STEP, MOST = 60, 10, 120


def _bits(text, n: int = 15):
    return F.conv(F.substring(F.md5(text), 1, n), 16, 10).cast("long")


def addressed(docs: DataFrame) -> DataFrame:
    key = F.concat(F.lit("shard:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(F.col("text")), F.lit("")))
    rid = F.monotonically_increasing_id()
    return docs.select(
        rid.alias("rid"), "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), _bits(key).alias("a"),
    ).withColumn("b", _bits(F.concat(F.lit("row:"), F.col("rid").cast("string"))))


def _prefix(depth):
    """The first ``depth`` bits (a column) of a and b as one comparable string of two numbers."""
    d = depth if not isinstance(depth, int) else F.lit(depth)
    hi = F.expr(f"a div cast(power(2, {BITS}) / power(2, least({BITS}, shard_at)) as bigint)")
    lo = F.expr(f"b div cast(power(2, {BITS}) / power(2, greatest(0, shard_at - {BITS})) as bigint)")
    return d, hi, F.when(d > BITS, lo).otherwise(F.lit(0).cast("long"))


def assign_shards(rows: DataFrame, max_bytes: int) -> DataFrame:
    """(rid, n_bytes, a, b) -> rid, shard_id, depth, shard_bytes, shard_docs, oversize."""
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    low, pending, done = 0, rows, []
    high = min(MOST, max(2, math.ceil(math.log2(max(1, total / max_bytes))) + 4))
    while True:
        cell = pending.withColumn("shard_at", F.lit(high))
        _, hi, lo = _prefix(high)
        cell = cell.withColumn("hi", hi).withColumn("lo", lo)
        leaves = cell.groupBy("hi", "lo").agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n"), F.min("a").alias("a"), F.min("b").alias("b"))
        nodes = leaves.withColumn("shard_at", F.explode(F.sequence(F.lit(low), F.lit(high))))
        _, phi, plo = _prefix(F.col("shard_at"))
        nodes = nodes.withColumn("phi", phi).withColumn("plo", plo)
        sums = nodes.groupBy("shard_at", "phi", "plo").agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n").alias("shard_docs"))
        sums = sums.where((F.col("shard_bytes") <= max_bytes) | (F.col("shard_docs") == 1) | (F.lit(high) >= MOST) & (F.col("shard_at") == high))
        entry = nodes.select("hi", "lo", "shard_at", "phi", "plo").join(sums, ["shard_at", "phi", "plo"])
        entry = entry.groupBy("hi", "lo").agg(F.min(F.struct("shard_at", "phi", "plo", "shard_bytes", "shard_docs")).alias("e"))
        name = F.concat_ws("-", F.lpad(F.col("e.shard_at").cast("string"), 3, "0"), F.hex("e.phi"), F.when(F.col("e.shard_at") > BITS, F.hex("e.plo")))
        mapped = cell.join(entry, ["hi", "lo"], "left")
        found = written(
            mapped.select("rid", "n_bytes", "a", "b", F.when(F.col("e").isNotNull(), name).alias("shard_id"), F.col("e.shard_at").alias("depth"), F.col("e.shard_bytes").alias("shard_bytes"), F.col("e.shard_docs").alias("shard_docs")),
            "shards",
        )
        done.append(found.where("shard_id is not null").select("rid", "shard_id", F.col("depth").cast("int"), "shard_bytes", "shard_docs", (F.col("shard_bytes") > max_bytes).alias("oversize")))
        if high >= MOST or found.where("shard_id is null").limit(1).count() == 0:
            break
        pending, low, high = found.where("shard_id is null").select("rid", "n_bytes", "a", "b"), high, min(MOST, high + STEP)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def sharded_rows(docs: DataFrame, max_bytes: int) -> DataFrame:
    """rid, doc_id, n_bytes, shard_id, depth, shard_bytes, shard_docs, oversize; rid: the row's number in its scan."""
    rows = written(addressed(docs), "shard-rows")
    return rows.select("rid", "doc_id", "n_bytes").join(assign_shards(rows, max_bytes), "rid")


def shard_table(docs: DataFrame, max_bytes: int) -> DataFrame:
    """doc_id, n_bytes, shard_id, depth, shard_bytes, shard_docs, oversize; one row per input row."""
    return sharded_rows(docs, max_bytes).drop("rid")


def directory(shards: DataFrame) -> DataFrame:
    """The directory's buckets: shard_id, depth, bytes and documents."""
    return shards.groupBy("shard_id", "depth").agg(F.first("shard_bytes").alias("shard_bytes"), F.first("shard_docs").alias("shard_docs"), F.first("oversize").alias("oversize"))


def write_shards(docs: DataFrame, path: str, max_bytes: int) -> None:
    """Write documents, each row once, in a folder per shard. docs: a table as it is read, whose rows keep their numbers.

    A column of docs named shard_id is overwritten.
    """
    rid = fresh(docs, "shard_row")
    ids = sharded_rows(docs, max_bytes).select(F.col("rid").alias(rid), "shard_id")
    docs.drop("shard_id").withColumn(rid, F.monotonically_increasing_id()).join(ids, rid).drop(rid).repartition("shard_id").write.partitionBy("shard_id").parquet(path)
