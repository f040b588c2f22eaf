"""Weighted fair queueing of sources (native DataFrame operations only).

Every document of a source stands in that source's queue in a fixed shuffled order
(MD5 of id and text). A queue is served at the rate of its target, so the virtual finish
time of a document is the source's cumulative words up to and with it, divided by the
target. Copies 0, 1 and 2 of a queue follow each other. All queues are merged by range
buckets of the finish time and cut where the budget (all words) ends.

Targets: sources in code point order, null last, weigh 5, 2, 1, 5, ...; a target stops at
``max_repeats`` times its source's size, and what is over is shared again by weight.

Edge cases: null or empty text has size 0 and is never taken; a null source is a source of
its own; repeated rows are separate documents; an empty table gives an empty result; other
columns are ignored, so clashing names do no harm. A source without words has target 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, text_bytes, written

WORD = r"[^\x20\x09-\x0D]+"
#: Documents in a cell of a queue or of the finish time, about.
CELL = 4096
#: Bytes of text in a task of the sorted mix.
PART_BYTES = 64 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fair_targets(sizes: DataFrame, weights=(5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """(skey, source, source_size) -> the same with weight and target.

    Water filling in closed form: with sources in ascending order of cap/weight, the level
    after capping the first k is (total - caps of those k) / (weights of the rest); the
    first source whose cap/weight reaches its level, and all after it, stay uncapped. From
    there on levels only fall, so the level sought is the largest that a source reaches.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (turn + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * max_repeats)
    # compared as cap / weight; ties need no order since equal ratios cap alike
    ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("skey"))
    before, rest = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = weighed.withColumn(
        "level",
        (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(rest).cast("double"),
    )
    full = level.withColumn("level", F.max(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))).over(every))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return full.select("skey", "source", "source_size", "weight", target.alias("target"))


def weighted_fair_mix(docs: DataFrame, weights=(5, 2, 1), max_repeats: int = 3, key: str | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, finish (of copy 0).

    key: a column that is carried along as ``key``. Equal inputs give equal results: nothing depends
    on partitions or on sampling.
    """
    mark = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(F.col("text")), F.lit(""))))
    sized = written(
        docs.select(
            F.monotonically_increasing_id().alias("rid"), "doc_id", "source", word_count(F.col("text")).alias("size"), mark.alias("h"),
            F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("null")).alias("skey"), *([F.col(key).alias("key")] if key else []),
        ),
        "mix-sizes",
    )
    # cells grow in number with the documents: hex digits of a queue's order, steps of the finish time
    n = sized.count()
    digits = max(1, min(15, math.ceil(math.log(max(1, n / CELL), 16)) + 1))
    steps = 1 << max(8, math.ceil(math.log2(max(1, n / CELL))) + 2)
    sized = sized.withColumn("queue", F.substring("h", 1, digits))
    queues = sized.groupBy("skey", "queue").agg(F.sum("size").alias("words"), F.first("source").alias("source"))
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("skey").orderBy("queue").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    queues = queues.withColumn("ahead", ahead).withColumnRenamed("words", "queue_words")
    targets = fair_targets(queues.groupBy("skey").agg(F.first("source").alias("source"), F.sum("queue_words").alias("source_size")), weights, max_repeats)
    queues = queues.select("skey", "queue", "ahead").join(targets.select("skey", "source_size", "target"), "skey")
    inside = Window.partitionBy("skey", "queue").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sized.withColumn("upto", F.sum("size").over(inside)).join(queues, ["skey", "queue"])

    def finish(k: int) -> Column:
        at = (F.lit(k) * F.col("source_size") + F.col("ahead") + F.col("upto")).cast("double") / F.col("target")
        return F.when((F.col("size") > 0) & (F.col("target") > 0), at)

    placed = written(
        placed.select("rid", "doc_id", "source", "skey", "h", "size", "source_size", "target", *(["key"] if key else []), F.array(*[finish(k) for k in range(max_repeats)]).alias("finish")),
        "mix-finish",
    )
    bucket = lambda f: F.least(F.floor(f * steps), F.lit(4 * steps))
    copies = placed.select("rid", "skey", "h", "size", F.posexplode("finish").alias("copy", "at")).where("at is not null").withColumn("bucket", bucket(F.col("at")))
    sums = copies.groupBy("bucket").agg(F.sum("size").alias("words"))
    total = F.lit(placed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    upto = F.sum("words").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = sums.withColumn("upto", upto).where(F.col("upto") > total).orderBy("bucket").limit(1).select("bucket", (F.col("upto") - F.col("words")).alias("before")).first()
    edge, before = (cut[0], cut[1]) if cut else (4 * steps + 1, 0)
    line = Window.partitionBy("bucket").orderBy("at", "skey", "h", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = copies.where(F.col("bucket") == edge).withColumn("upto", F.sum("size").over(line) + before).where(F.col("upto") <= total)
    last = last.groupBy("rid").agg(F.count("*").alias("more"))
    whole = F.aggregate(F.col("finish"), F.lit(0), lambda n, f: n + F.when(f.isNotNull() & (bucket(f) < edge), 1).otherwise(0))
    taken = placed.withColumn("whole", whole).join(last, "rid", "left")
    taken = taken.withColumn("copies", F.col("whole") + F.coalesce(F.col("more"), F.lit(0)))
    return taken.select("doc_id", "source", "size", "source_size", "target", F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"), F.col("finish")[0].alias("finish"), "skey", "h", *(["key"] if key else []))


def mixed_stream(docs: DataFrame, weights=(5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """The mix itself: documents with all their columns, a row per admitted copy, in the order of virtual finish time.

    The finish times of the admitted copies lie in equal words, so ranges of them are known without
    sampling: rows go to a range of the finish time each, and are sorted there.
    """
    rid, copy, at, part = (fresh(docs, x) for x in ("mix_row", "mix_copy", "mix_finish", "mix_part"))
    rows = docs.withColumn(rid, F.monotonically_increasing_id())
    taken = weighted_fair_mix(rows, weights, max_repeats, rid).where("copies > 0")
    taken = written(taken.select(F.col("key").alias(rid), F.col("copies").alias(copy), F.col("finish").alias(at), (F.col("source_size") / F.col("target")).alias("again")), "mix-taken")
    most = taken.agg(F.max(F.col(at) + F.col("again") * (F.col(copy) - 1))).first()[0] or 1.0
    parts = max(1, -(-text_bytes(docs) // PART_BYTES))
    each = taken.select(rid, at, "again", F.explode(F.sequence(F.lit(0), F.col(copy) - 1)).alias(copy)).select(rid, copy, (F.col(at) + F.col("again") * F.col(copy)).alias(at))
    placed = rows.join(each, rid).withColumn(part, F.least(F.floor(F.col(at) / F.lit(most) * parts), F.lit(parts - 1)).cast("int"))
    return placed.repartitionById(parts, F.col(part)).sortWithinPartitions(at, rid, copy).select(*docs.columns)
