"""Interval operators over spans [start, end): merging, overlap and containment joins, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_groups(df: DataFrame, keys: list[str], start: str, end: str, tie: list[str], touching: bool = False) -> DataFrame:
    """Adds ``grp``: the number of the span's group within its keys.

    A group opens where a span starts at or after the running greatest end (after it, with
    ``touching``). One sort by key and start, no self-join.
    """
    w = Window.partitionBy(*keys).orderBy(start, end, *tie)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = reach.isNull() | ((F.col(start) > reach) if touching else (F.col(start) >= reach))
    flagged = df.withColumn("_opens", opens.cast("long"))
    return flagged.withColumn("grp", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_opens")


def merged(df: DataFrame, keys: list[str], start: str, end: str, tie: list[str], touching: bool = False) -> DataFrame:
    """One row per group: keys, grp, start, end, n."""
    return merge_groups(df, keys, start, end, tie, touching).groupBy(*keys, "grp").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"))


def binned(df: DataFrame, start: str, end: str, width: int, name: str = "_bin") -> DataFrame:
    """A row per bin that a span touches: overlap becomes an equi-join with a residual test."""
    last = F.greatest(F.col(start), F.col(end) - 1)
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(last / width))))


def overlap_latest(spans: DataFrame, scopes: DataFrame, keys: list[str], width: int = 256) -> DataFrame:
    """Each span with the latest-starting scope that overlaps it (inner).

    spans: keys, id, start, end; scopes: keys, s_start, s_end, s_id.
    """
    a, b = binned(spans, "start", "end", width), binned(scopes, "s_start", "s_end", width)
    hit = a.join(b, [*keys, "_bin"]).where("s_start < end and start < s_end")
    best = hit.groupBy(*keys, "id").agg(F.max(F.struct("s_start", "s_end", "s_id")).alias("b"))
    return spans.join(best, [*keys, "id"]).select(*spans.columns, "b.s_start", "b.s_end", "b.s_id")


def contained_first(spans: DataFrame, scopes: DataFrame, keys: list[str], width: int = 256) -> DataFrame:
    """Each span with the first scope (by start, then id) that covers it."""
    b = binned(scopes, "s_start", "s_end", width)
    a = spans.withColumn("_bin", F.floor(F.col("start") / width))
    hit = a.join(b, [*keys, "_bin"]).where("start >= s_start and end <= s_end")
    best = hit.groupBy(*keys, "id").agg(F.min(F.struct("s_start", "s_id", "s_end")).alias("b"))
    return spans.join(best, [*keys, "id"]).select(*spans.columns, "b.s_start", "b.s_end", "b.s_id")


def longest_wins(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", label: str = "label") -> DataFrame:
    """Non-overlapping spans per key: longer first, then earlier, then smaller label.

    The choice is sequential within a key (a text), which bounds the array.
    """
    item = F.struct((F.col(start) - F.col(end)).alias("k"), F.col(start).alias("s"), F.col(label).alias("l"), F.col(end).alias("e"))
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("all"))
    empty = F.slice("all", 1, 0)
    keep = F.aggregate("all", empty, lambda acc, x: F.when(F.exists(acc, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])), acc).otherwise(F.concat(acc, F.array(x))))
    return packed.select(*keys, F.explode(keep).alias("x")).select(*keys, F.col("x.s").alias(start), F.col("x.e").alias(end), F.col("x.l").alias(label))


def greedy_matches(gold: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """One-to-one overlap matching per key in order of start: (keys, gold start, found start or null).

    Each gold span takes the first unused found span that overlaps it, so a found span counts once.
    """
    g = gold.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("g"))
    f = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("f"))
    both = g.join(f, keys, "left")
    none = F.lit(None).cast("long")

    def step(acc, x):
        free = F.filter(F.coalesce("f", F.array().cast("array<struct<start:bigint,end:bigint>>")), lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]) & ~F.array_contains(acc["used"], y["start"] * 1000003 + y["end"]))
        pick = F.when(F.size(free) > 0, free[0])
        used = F.when(pick.isNotNull(), F.concat(acc["used"], F.array(pick["start"] * 1000003 + pick["end"]))).otherwise(acc["used"])
        return F.struct(used.alias("used"), F.concat(acc["out"], F.array(F.struct(x["start"].alias("gold"), F.coalesce(pick["start"], none).alias("found")))).alias("out"))

    zero = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast("array<struct<gold:bigint,found:bigint>>").alias("out"))
    return both.select(*keys, F.explode(F.aggregate("g", zero, step)["out"]).alias("m")).select(*keys, F.col("m.gold").alias("gold_start"), F.col("m.found").alias("found_start"))
