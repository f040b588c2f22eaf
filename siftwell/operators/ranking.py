"""Rankers of candidate classes: each returns (enc, cls, score); ``ordered`` ranks them.

Tables: sides(enc, adm, cls) with adm true for classes before and false for those after,
folds(enc, fold), conditions(enc, cond), rules(rule columns of rules_data). Training counts of
a fold are all counts less the fold's own, so one aggregation serves all folds.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WEIGHTS = {"I": 1.0, "IIa": 0.6, "IIb": 0.3}


def before(sides: DataFrame) -> DataFrame:
    return sides.where("adm").select("enc", "cls")


def after(sides: DataFrame) -> DataFrame:
    return sides.where("not adm").select("enc", "cls")


def added(sides: DataFrame) -> DataFrame:
    return after(sides).join(before(sides), ["enc", "cls"], "left_anti")


def out_of_fold(rows: DataFrame, folds: DataFrame, keys: list[str]) -> DataFrame:
    """(fold, *keys, n): for each fold the rows of the other folds."""
    own = rows.join(folds, "enc").groupBy("fold", *keys).agg(F.count("*").alias("own"))
    total = own.groupBy(*keys).agg(F.sum("own").alias("total"))
    every = folds.select("fold").distinct()
    full = total.crossJoin(F.broadcast(every)).join(own, ["fold", *keys], "left")  # folds: a handful of rows
    return full.select("fold", *keys, (F.col("total") - F.coalesce("own", F.lit(0))).alias("n")).where("n > 0")


def candidates(sides: DataFrame, folds: DataFrame, least: int = 3) -> DataFrame:
    """Classes discharged at least ``least`` times outside the fold."""
    return out_of_fold(after(sides), folds, ["cls"]).where(F.col("n") >= least).select("fold", "cls")


def frequencies(sides: DataFrame, folds: DataFrame, cands: DataFrame) -> DataFrame:
    """(fold, cls, score): additions outside the fold, 0 for a candidate without any."""
    n = out_of_fold(added(sides), folds, ["cls"])
    return cands.join(n, ["fold", "cls"], "left").select("fold", "cls", F.coalesce(F.col("n"), F.lit(0)).cast("double").alias("score"))


def constant(cands: DataFrame) -> DataFrame:
    """Every candidate scores 0: the order is that of the codes."""
    return cands.select("fold", "cls", F.lit(0.0).alias("score"))


def placed(scores: DataFrame) -> DataFrame:
    """(fold, cls, score, place): one order for all encounters of a fold, by score (to nine places), then class."""
    w = Window.partitionBy("fold").orderBy(F.desc(F.round("score", 9)), "cls")
    return scores.select("fold", "cls", "score", F.row_number().over(w).alias("place"))


def first_k(order: DataFrame, folds: DataFrame, current: DataFrame, k: int, own: DataFrame | None = None) -> DataFrame:
    """The first k proposals of each encounter without its current classes: (enc, cls, score, rank).

    order: as from ``placed``; own: (enc, cls, score) of the candidates that score otherwise for an
    encounter than in its fold's order. With m current classes and a scores of its own, an encounter
    needs the first k + m + a places of its fold at most, so places meet by an equi-join on
    (fold, place) and the product of encounters and candidates is never made.
    """
    skip = current.select("enc", "cls")
    if own is not None:
        skip = skip.union(own.select("enc", "cls"))
    counts = skip.groupBy("enc").agg(F.count("*").alias("m"))
    need = folds.join(counts, "enc", "left").select("enc", "fold", F.explode(F.sequence(F.lit(1), (F.coalesce("m", F.lit(0)) + k).cast("int"))).alias("place"))
    left = need.join(order, ["fold", "place"]).select("enc", "cls", "score").join(skip, ["enc", "cls"], "left_anti")
    if own is not None:
        left = left.union(own.select("enc", "cls", "score").join(current, ["enc", "cls"], "left_anti"))
    return ordered(left).where(F.col("rank") <= k)


def ranks_of(targets: DataFrame, order: DataFrame, folds: DataFrame, current: DataFrame) -> DataFrame:
    """(enc, cls, rank) of targets among the candidates that are no current classes.

    A target's rank is its place in the fold's order less the current classes placed before it, so
    only targets and current classes are ranked, not the candidates.
    """
    both = targets.select("enc", "cls", F.lit(0).alias("now")).union(current.select("enc", "cls", F.lit(1)))
    both = both.groupBy("enc", "cls").agg(F.max("now").alias("now")).join(folds, "enc").join(order.select("fold", "cls", "place"), ["fold", "cls"])
    ahead = F.sum("now").over(Window.partitionBy("enc").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn("rank", (F.col("place") - ahead).cast("int")).where("now = 0").select("enc", "cls", "rank")


def first_k_by_hash(cands: DataFrame, folds: DataFrame, current: DataFrame, k: int, seed: str = "20260915") -> DataFrame:
    """The random control: an order per encounter that only a hash knows; its first k without current classes.

    Every candidate must be hashed for every encounter, but inside the encounter's row: its fold's
    classes are one array (the class vocabulary), and only k of them leave the row.
    """
    lists = cands.groupBy("fold").agg(F.array_sort(F.collect_list("cls")).alias("all"))
    now = current.groupBy("enc").agg(F.collect_set("cls").alias("now"))
    h = lambda c: F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col("enc").cast("string"), c), 256), 1, 8), 16, 10).cast("double")
    rows = folds.join(lists, "fold").join(now, "enc", "left")
    free = F.array_except("all", F.coalesce("now", F.array().cast("array<string>")))
    best = F.slice(F.array_sort(F.transform(free, lambda c: F.struct((-h(c)).alias("s"), c.alias("cls")))), 1, k)
    top = rows.select("enc", F.posexplode(best).alias("pos", "x"))
    return top.select("enc", "x.cls", (-F.col("x.s")).alias("score"), (F.col("pos") + 1).alias("rank"))


def matches(rules: DataFrame, facts: DataFrame, fact: str) -> DataFrame:
    """Rules whose trigger is a prefix of a fact, by equal prefixes instead of a theta join.

    rules: (rule_id, trigger); facts: (enc, fact). Returns distinct (enc, rule_id).
    """
    cut = facts.select("enc", F.explode(F.transform(F.sequence(F.lit(1), F.length(fact)), lambda n: F.col(fact).substr(F.lit(1), n))).alias("trigger"))
    return cut.join(rules.select("rule_id", "trigger"), "trigger").select("enc", "rule_id").distinct()


def prefix_rows(df: DataFrame, value: str, name: str) -> DataFrame:
    """A row per prefix of a code, so that prefix rules meet by an equi-join."""
    return df.withColumn(name, F.explode(F.transform(F.sequence(F.lit(1), F.length(value)), lambda n: F.col(value).substr(F.lit(1), n))))


def fired_rules(rules: DataFrame, conditions: DataFrame, sides: DataFrame) -> DataFrame:
    """(enc, rule_id, target, weight) of the indications that an encounter's facts trigger."""
    fired = matches(rules.where("kind = 'cond'"), conditions, "cond").union(matches(rules.where("kind = 'therapy'"), before(sides), "cls")).distinct()
    return fired.join(F.broadcast(rules.select("rule_id", "target", "weight").distinct()), "rule_id")  # a fixed rule table


def by_rules(cands: DataFrame, rules: DataFrame, conditions: DataFrame, sides: DataFrame) -> DataFrame:
    """(enc, cls, score) of the candidates that a fired indication targets; all others score 0.

    Highest weight of the fired indications plus 0.01 for each further one. rules: (rule_id, target,
    weight, kind 'cond' or 'therapy', trigger).
    """
    hits = fired_rules(rules, conditions, sides)
    scored = prefix_rows(cands, "cls", "target").join(hits, ["enc", "target"])
    return scored.groupBy("enc", "cls").agg((F.max("weight") + 0.01 * (F.count("*") - 1)).alias("score"))


def by_rules_of_fold(cands: DataFrame, folds: DataFrame, rules: DataFrame, conditions: DataFrame, sides: DataFrame) -> DataFrame:
    """As ``by_rules`` over the candidates (fold, cls) of each encounter's fold."""
    hits = fired_rules(rules, conditions, sides).join(folds, "enc")
    scored = hits.join(prefix_rows(cands.select("fold", "cls"), "cls", "target"), ["fold", "target"])
    return scored.groupBy("enc", "cls").agg((F.max("weight") + 0.01 * (F.count("*") - 1)).alias("score"))


def features(conditions: DataFrame, sides: DataFrame) -> DataFrame:
    """(enc, feat): D: and the condition's first three characters, T: and the admission class."""
    d = conditions.select("enc", F.concat(F.lit("D:"), F.substring("cond", 1, 3)).alias("feat"))
    return d.union(before(sides).select("enc", F.concat(F.lit("T:"), F.col("cls")))).distinct()


def pmi(conditions: DataFrame, sides: DataFrame, folds: DataFrame, joint: int = 3, support: int = 5) -> DataFrame:
    """(fold, feat, cls, pmi) for pairs with enough support outside the fold."""
    feats, adds = features(conditions, sides), added(sides)
    n = out_of_fold(folds.select("enc"), folds, [])
    both = out_of_fold(feats.join(adds, "enc"), folds, ["feat", "cls"]).where(F.col("n") >= joint)
    f = out_of_fold(feats, folds, ["feat"]).where(F.col("n") >= support).withColumnRenamed("n", "nf")
    c = out_of_fold(adds, folds, ["cls"]).withColumnRenamed("n", "nc")
    full = both.join(f, ["fold", "feat"]).join(c, ["fold", "cls"]).join(n.withColumnRenamed("n", "total"), "fold")
    value = F.log(F.col("n").cast("double") * F.col("total").cast("double") / (F.col("nf").cast("double") * F.col("nc").cast("double")))
    return full.select("fold", "feat", "cls", value.alias("pmi"))


def base_rates(sides: DataFrame, folds: DataFrame, cands: DataFrame) -> DataFrame:
    """(fold, cls, score): the log base rate of an addition outside the fold; half an addition for a candidate without any."""
    total = out_of_fold(folds.select("enc"), folds, []).withColumnRenamed("n", "total")
    n = cands.join(out_of_fold(added(sides), folds, ["cls"]), ["fold", "cls"], "left").join(total, "fold")
    return n.select("fold", "cls", F.log(F.coalesce(F.col("n").cast("double"), F.lit(0.5)) / F.col("total").cast("double")).alias("score"))


def hybrid_parts(base: DataFrame, rules: DataFrame, conditions: DataFrame, sides: DataFrame, folds: DataFrame) -> DataFrame:
    """(enc, cls, base, pmi, rules) of candidates with a feature or a fired rule; all others score their base rate.

    pmi: the best one, which may be negative, 0 without any.
    """
    best = features(conditions, sides).join(folds, "enc").join(pmi(conditions, sides, folds), ["fold", "feat"]).groupBy("enc", "cls").agg(F.max("pmi").alias("pmi"))
    symbolic = by_rules_of_fold(base, folds, rules, conditions, sides).withColumnRenamed("score", "rules")
    both = best.join(symbolic, ["enc", "cls"], "full").join(folds, "enc").join(base.withColumnRenamed("score", "base"), ["fold", "cls"])
    return both.select("enc", "cls", "base", F.coalesce("pmi", F.lit(0.0)).alias("pmi"), F.coalesce("rules", F.lit(0.0)).alias("rules"))


def by_hybrid(parts: DataFrame, rule_weight: float = 0.5) -> DataFrame:
    """Log base rate plus the best PMI plus weighted rules, of the candidates in ``hybrid_parts``."""
    return parts.select("enc", "cls", (F.col("base") + F.col("pmi") + rule_weight * F.col("rules")).alias("score"))


#: Rows of a fold's PMI table up to which it goes to every task: the square of the vocabulary, not the encounters.
TABLE = 500_000


def hybrid_first_k(base: DataFrame, rules: DataFrame, conditions: DataFrame, sides: DataFrame, folds: DataFrame, k: int, weights=(0.5,)) -> DataFrame:
    """(weight, enc, cls, score, rank): the first k of the hybrid for each rule weight, without current classes.

    Nearly every candidate has a PMI with some fact of an encounter, so pairs would be the product of both. Facts are
    one array of an encounter instead, and its candidates are scored inside its row, by tables of the class vocabulary. Where
    those are too large for a task (``TABLE``), pairs are joined as in ``hybrid_parts``.
    """
    spark, enc = base.sparkSession, folds.schema["enc"].dataType
    pairs = pmi(conditions, sides, folds)
    rows = pairs.limit(TABLE + 1).collect()
    scores = base.select("fold", "cls", "score").limit(TABLE + 1).collect()
    if max(len(rows), len(scores)) > TABLE:
        parts, out = hybrid_parts(base, rules, conditions, sides, folds), None
        order = placed(base)
        for w in weights:
            one = first_k(order, folds, before(sides), k, by_hybrid(parts, w)).select(F.lit(float(w)).alias("weight"), "enc", "cls", "score", "rank")
            out = one if out is None else out.union(one)
        return out
    score = spark.sparkContext.broadcast(_Hybrid([tuple(r) for r in scores], [tuple(r) for r in rows], [(r.rule_id, r.target, r.weight, r.kind, r.trigger) for r in rules.collect()], k, weights))
    facts = folds.select("enc", "fold", F.lit("").alias("fact"))
    facts = facts.union(before(sides).select("enc", F.lit(None), F.concat(F.lit("T:"), "cls"))).union(conditions.select("enc", F.lit(None), F.concat(F.lit("D:"), "cond")))
    each = facts.groupBy("enc").agg(F.max("fold").alias("fold"), F.collect_list("fact").alias("facts")).where("fold is not null")
    schema = T.StructType().add("weight", "double").add("enc", enc).add("cls", "string").add("score", "double").add("rank", "integer")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield score.value.first_k(batch.slice(at, 256), schema.names)

    return each.mapInArrow(run, schema)


class _Hybrid:
    """Tables by fold over the candidates in code order: log base rate, best PMI of each feature, rules' targets."""

    def __init__(self, base, pairs, rules, k, weights):
        self.k, self.weights, self.folds = k, weights, {}
        self.names = {x: i for i, x in enumerate(sorted({x for _, x, _, _ in pairs}), 1)}
        self.targets = sorted({x[:3] for x in rules})
        self.triggers = [(self.targets.index(x[:3]), "T:" if x[3] == "therapy" else "D:", x[4]) for x in rules if x[3] in ("therapy", "cond")]
        for fold in {f for f, _, _ in base}:
            mine = sorted((c.encode(), c, x) for f, c, x in base if f == fold)  # as Spark orders strings
            at = {c: i for i, (_, c, _) in enumerate(mine)}
            table = np.full((len(self.names) + 1, len(mine)), -np.inf)
            for f, feat, c, x in pairs:
                if f == fold and c in at:
                    table[self.names[feat], at[c]] = x
            below = np.array([[c.startswith(t) for _, c, _ in mine] for _, t, _ in self.targets], bool).reshape(len(self.targets), len(mine))
            self.folds[fold] = [c for _, c, _ in mine], at, np.array([x for _, _, x in mine]), table, below

    def first_k(self, batch, names):
        enc, fold, facts = batch.columns
        coded = facts.flatten().dictionary_encode()
        words, codes, starts = coded.dictionary.to_pylist(), coded.indices.to_numpy(), np.concatenate([[0], np.cumsum([len(x) for x in facts])[:-1]]).astype(np.int64)
        ends = np.append(starts[1:], len(codes))
        feature = np.array([self.names.get(x if x[:2] == "T:" else x[:5], 0) for x in words])
        fires = np.zeros((len(words), len(self.targets)), bool)
        for i, x in enumerate(words):
            for j, kind, trigger in self.triggers:
                fires[i, j] |= x[:2] == kind and x[2:].startswith(trigger)
        weight = np.array([w for _, _, w in self.targets])
        fired = np.logical_or.reduceat(fires[codes], starts, axis=0)
        memo, out = {}, []
        for row, (f, a, b) in enumerate(zip(fold.to_pylist(), starts, ends)):
            if f not in self.folds:
                continue
            classes, at, base, table, below = self.folds[f]
            best = table[feature[codes[a:b]]].max(axis=0)
            key = f, fired[row].tobytes()
            if key not in memo:
                hit = below[fired[row]]
                n, top = hit.sum(axis=0), (np.where(hit, weight[fired[row]][:, None], 0.0).max(axis=0) if len(hit) else 0.0)
                memo[key] = np.where(n > 0, top + 0.01 * (n - 1), 0.0)
            plain = base + np.where(np.isneginf(best), 0.0, best)
            now = [at[words[c][2:]] for c in codes[a:b] if words[c][:2] == "T:" and words[c][2:] in at]
            for w in self.weights:
                score = plain + w * memo[key]
                ranks = np.round(score, 9)
                ranks[now] = -np.inf
                first = np.argsort(-ranks, kind="stable")[: min(self.k, len(classes) - len(now))]
                out += [(w, row, classes[i], score[i], n) for n, i in enumerate(first, 1)]
        cols = list(zip(*out)) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.float64()), enc.take(pa.array(cols[1], pa.int64())), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.int32())], names=names)


def ordered(scores: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """(enc, cls, score, rank): descending score (to nine places, so that equal sums tie), then class; ``exclude`` (enc, cls) goes first."""
    if exclude is not None:
        scores = scores.join(exclude, ["enc", "cls"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("enc").orderBy(F.desc(F.round("score", 9)), "cls"))
    return scores.withColumn("rank", rank)


def replayed(answers: DataFrame, order: DataFrame, folds: DataFrame, k: int) -> DataFrame:
    """The first k of a stored answer list: (enc, answer array) -> (enc, cls, rank); classes are
    trimmed to the unit and upper-cased, those off the list dropped (``off_list`` counts them), repeats
    keep their first place, and what was not named follows in code order."""
    unit = order.agg(F.max(F.length("cls"))).first()[0] or 0  # one number
    lists = order.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("place", "cls"))).alias("all")).select("fold", F.col("all.cls").alias("all"))
    named = F.transform(F.coalesce("answer", F.array().cast("array<string>")), lambda c: F.upper(F.substring(F.trim(c), 1, unit)))
    rows = folds.join(answers.select("enc", "answer"), "enc", "left").join(F.broadcast(lists), "fold")  # a row per fold, of the class vocabulary
    first = rows.withColumn("named", F.array_intersect(named, "all"))
    top = first.select("enc", F.posexplode(F.slice(F.concat("named", F.array_except("all", "named")), 1, k)).alias("pos", "cls"))
    return top.select("enc", "cls", (F.col("pos") + 1).alias("rank"))


def named_classes(answers: DataFrame, order: DataFrame) -> DataFrame:
    """(enc, cls, pos): the classes an answer names, each at its first place."""
    unit = order.agg(F.max(F.length("cls"))).first()[0] or 0  # one number
    named = answers.select("enc", F.posexplode("answer").alias("pos", "cls")).select("enc", "pos", F.upper(F.substring(F.trim("cls"), 1, unit)).alias("cls"))
    return named.groupBy("enc", "cls").agg(F.min("pos").alias("pos"))


def off_list(answers: DataFrame, order: DataFrame, folds: DataFrame) -> DataFrame:
    """(enc, n): named classes that are no candidates."""
    named = named_classes(answers, order).join(folds, "enc")
    return named.join(order.select("fold", "cls"), ["fold", "cls"], "left_anti").groupBy("enc").agg(F.count("*").alias("n"))
