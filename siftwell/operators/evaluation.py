"""Folds, set metrics over code prefixes, top-k metrics, intervals and bootstrap."""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED, FOLDS, LEVELS = 20260915, 5, (1, 3, 4, 5, 7)
#: Of a bootstrap: tasks that share its rounds, and draws that are made at a time.
BLOCKS, SLICE = 125, 100_000


def hash32(text: Column) -> Column:
    """The first 32 bits of the SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def hash_of(key: Column, seed: int = SEED) -> Column:
    return hash32(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_fold(key: Column, k: int = FOLDS, seed: int = SEED) -> Column:
    return (hash_of(key, seed) % k).cast("int")


def stratified_folds(df: DataFrame, key: str, stratum: str, k: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Round robin within each stratum, in hash order: fold sizes differ by one at most."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(digest, key)) - 1
    return df.withColumn("fold", (turn % k).cast("int"))


def first_stratum(df: DataFrame, key: str, value: str, order: tuple[str, ...]) -> DataFrame:
    """(key, stratum): the first of ``order`` that any of the key's values begins with, else 'other'."""
    place = F.lit(len(order))
    for i, p in reversed(list(enumerate(order))):
        place = F.when(F.col(value).startswith(p), i).otherwise(place)
    best = df.groupBy(key).agg(F.min(place).alias("place"))
    return best.select(key, F.element_at(F.array(*[F.lit(x) for x in (*order, "other")]), (F.col("place") + 1).cast("int")).alias("stratum"))


def hash_split(key: Column, share: float, seed: int = SEED) -> Column:
    return hash_of(key, seed).cast("double") / F.lit(float(0xFFFFFFFF)) < share


def truncated(df: DataFrame, value: str, levels) -> DataFrame:
    """Distinct (level, enc, c): class prefixes at each level, cut before making distinct."""
    level = F.explode(F.array(*[F.lit(n) for n in levels])).alias("level")
    return df.select("enc", value, level).select("level", "enc", F.col(value).substr(F.lit(1), F.col("level")).alias("c")).distinct()


def set_counts(proposed: DataFrame, truth: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, np, nt, nh): sizes of both sets and of what they share."""
    a = proposed.select(*keys, item, F.lit(1).alias("p"), F.lit(0).alias("t"))
    b = truth.select(*keys, item, F.lit(0).alias("p"), F.lit(1).alias("t"))
    both = a.union(b).groupBy(*keys, item).agg(F.max("p").alias("p"), F.max("t").alias("t"))
    return both.groupBy(*keys).agg(F.sum("p").alias("np"), F.sum("t").alias("nt"), F.sum(F.col("p") * F.col("t")).alias("nh"))


def prf(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of set counts; each is 0 where its denominator is."""
    d = lambda c: F.col(c).cast("double")
    zero = F.lit(0.0)
    return (
        counts.withColumn("precision", F.when(F.col("np") > 0, d("nh") / d("np")).otherwise(zero))
        .withColumn("recall", F.when(F.col("nt") > 0, d("nh") / d("nt")).otherwise(zero))
        .withColumn("f1", F.when(F.col("np") + F.col("nt") > 0, 2 * d("nh") / (d("np") + d("nt"))).otherwise(zero))
    )


def hierarchical(proposed: DataFrame, truth: DataFrame, levels=LEVELS) -> DataFrame:
    """(level, enc, precision, recall, f1) of class sets at each prefix length."""
    return prf(set_counts(truncated(proposed, "cls", levels), truncated(truth, "cls", levels), ["level", "enc"], "c"))


def macro(metrics: DataFrame) -> DataFrame:
    """Mean over encounters at each level, with their number."""
    return metrics.groupBy("level").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")], F.count("*").alias("n_enc"))


def top_k_hits(ranked: DataFrame, added: DataFrame, k: int, levels=LEVELS) -> DataFrame:
    """(level, hit_rate, n_enc): share of encounters with an addition whose first k meet one."""
    a, b = truncated(ranked.where(F.col("rank") <= k), "cls", levels), truncated(added, "cls", levels)
    hit = a.join(b, ["level", "enc", "c"], "left_semi").select("level", "enc").distinct().withColumn("hit", F.lit(1.0))
    each = b.select("level", "enc").distinct().join(hit, ["level", "enc"], "left")
    return each.groupBy("level").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("hit_rate"), F.count("*").alias("n_enc"))


def average_precision(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """(enc, ap) over encounters with targets: mean of the precision at each hit's rank."""
    hits = ranked.join(targets.select("enc", "cls"), ["enc", "cls"]).select("enc", "rank")
    nth = F.row_number().over(Window.partitionBy("enc").orderBy("rank")).cast("double")
    gain = hits.withColumn("p", nth / F.col("rank").cast("double")).groupBy("enc").agg(F.sum("p").alias("p"))
    n = targets.groupBy("enc").agg(F.countDistinct("cls").cast("double").alias("n"))
    return n.join(gain, "enc", "left").select("enc", (F.coalesce("p", F.lit(0.0)) / F.col("n")).alias("ap"))


def at_k(ranked: DataFrame, targets: DataFrame, ks=(3, 5, 10)) -> DataFrame:
    """(k, recall, precision, n_enc); precision divides by k, encounters without targets are skipped."""
    n = targets.groupBy("enc").agg(F.countDistinct("cls").cast("double").alias("n"))
    hits = ranked.join(targets.select("enc", "cls"), ["enc", "cls"]).select("enc", "rank")
    grid = n.select("enc", "n", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    got = grid.join(hits, "enc", "left").groupBy("enc", "k", "n").agg(F.sum((F.coalesce("rank", F.lit(1 << 30)) <= F.col("k")).cast("double")).alias("h"))
    return got.groupBy("k").agg(F.round(F.avg(F.col("h") / F.col("n")), 6).alias("recall"), F.round(F.avg(F.col("h") / F.col("k").cast("double")), 6).alias("precision"), F.count("*").alias("n_enc"))


def sorted_index(df: DataFrame, keys: list[str], value: str, places: dict[str, tuple[float, int]]) -> DataFrame:
    """Order statistics without interpolation: name -> (quantile, cap): the element at
    min(int(q * n), n - 1) of the sorted values, q 0.5 giving the upper median.

    Equal values are counted first, so a key's window holds its distinct values, not its rows.
    """
    counts = df.select(*keys, value).groupBy(*keys, value).agg(F.count("*").alias("k"))
    w = Window.partitionBy(*keys)
    upto = F.sum("k").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumn("upto", upto).withColumn("n", F.sum("k").over(w))
    at = lambda q: F.least(F.floor(F.col("n") * q), F.col("n") - 1)
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("upto") > at(q), F.col(value))).alias(name) for name, (q, _) in places.items()])


def packed(per_enc: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, enc, n, total, data): the values in order of keys and enc, as doubles of some 10,000 rows; enc is a run's first.

    Range partitions and the batches within them do not overlap, so runs sorted by enc are a key's values in order: no task numbers all encounters.
    """
    rows = written(per_enc.select(*keys, "enc", F.col(value).cast("double").alias("value")), "values")
    schema = rows.select(*keys, "enc").schema.add("n", "long").add("total", "double").add("data", "binary")

    def run(batches):
        for batch in batches:
            ids = list(zip(*[batch.column(j).to_pylist() for j in range(len(keys))])) if keys else [()] * batch.num_rows
            starts = [i for i, k in enumerate(ids) if not i or k != ids[i - 1]]
            values = batch.column(len(keys) + 1).to_numpy(zero_copy_only=False)
            runs = [values[a:b] for a, b in zip(starts, [*starts[1:], len(ids)])]
            heads = [batch.column(j).take(pa.array(starts, pa.int64())) for j in range(len(keys) + 1)]
            yield pa.RecordBatch.from_arrays([*heads, pa.array([len(x) for x in runs], pa.int64()), pa.array([float(x.sum()) for x in runs], pa.float64()), pa.array([x.tobytes() for x in runs], pa.binary())], names=schema.names)

    return written(rows.repartitionByRange(*keys, "enc").sortWithinPartitions(*keys, "enc").mapInArrow(run, schema), "runs")


def hashes(seed: int, turn: int, start: int, stop: int) -> np.ndarray:
    """``hash32`` of 'seed:turn:i' for i from start to stop."""
    head, sha = f"{seed}:{turn}:".encode(), hashlib.sha256
    return np.frombuffer(b"".join([sha(b"%b%d" % (head, i)).digest()[:4] for i in range(start, stop)]), ">u4").astype(np.int64)


def bootstrap(per_enc: DataFrame, keys: list[str], value: str, rounds: int, seed: int = 20260916, confidence: float = 0.95) -> DataFrame:
    """Mean and empirical interval of resampled means; draws are hashes, so reruns agree.

    keys: e.g. level; each key's encounters are numbered apart, by enc. Draws never leave their task: a task makes some
    rounds of all keys from the packed values (8 bytes each), and a draw's hash, which is the same for every key, is made once.
    """
    runs = packed(per_enc, keys, value)
    each = -(-rounds // BLOCKS)
    dealt = runs.select(*keys, "enc", "data", F.explode(F.sequence(F.lit(0), F.lit((rounds - 1) // each))).alias("block")).repartition(BLOCKS, "block")
    schema = runs.select(*keys).schema.add("round", "integer").add("m", "double")

    def draw(table):
        first = table.column("block")[0].as_py() * each
        parts: dict[tuple, list] = {}
        for k, enc, data in sorted(zip(zip(*[table.column(c).to_pylist() for c in keys]) if keys else [()] * table.num_rows, table.column("enc").to_pylist(), table.column("data").to_pylist()), key=lambda x: x[1]):
            parts.setdefault(k, []).append(np.frombuffer(data))
        values = {k: np.concatenate(x) for k, x in parts.items()}
        most, out = max(map(len, values.values())), []
        for turn in range(first, min(first + each, rounds)):
            sums = dict.fromkeys(values, 0.0)
            for at in range(0, most, SLICE):
                h = hashes(seed, turn, at, min(at + SLICE, most))
                for k, x in values.items():
                    sums[k] += float(x[h[: max(0, len(x) - at)] % len(x)].sum())
            out += [(*k, turn, sums[k] / len(x)) for k, x in values.items()]
        cols = list(zip(*out))
        kinds = [table.schema.field(c).type for c in keys] + [pa.int32(), pa.float64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=schema.names)

    means = dealt.groupBy("block").applyInArrow(draw, schema)
    tail = (1 - confidence) / 2
    bounds = sorted_index(means, keys, "m", {"low": (tail, 0), "high": (1 - tail, 0)})
    mean = runs.groupBy(*keys).agg((F.sum("total") / F.sum("n").cast("double")).alias("mean"))
    return mean.join(bounds, keys).select(*keys, *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])
