"""Comparing extractors over aligned mentions: groups, Venn counts, agreement, coverage, clean-up.

mentions: enc, field, agent, kind, start, end, code, state (long offsets).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import merge_groups

KEYS = ["enc", "field"]


def groups(mentions: DataFrame) -> DataFrame:
    """mentions with the group of overlapping spans they fall into (touching spans do not merge)."""
    return merge_groups(mentions.where("start is not null"), KEYS, "start", "end", ["agent", "code"])


def group_table(grouped: DataFrame) -> DataFrame:
    """One row per group: label of its agents ('AB'), ambiguity (an agent twice), bounds."""
    per = grouped.groupBy(*KEYS, "grp", "agent").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"))
    return per.groupBy(*KEYS, "grp").agg(F.array_join(F.array_sort(F.collect_set("agent")), "").alias("agents"), (F.max("n") > 1).alias("ambiguous"), F.sum("n").alias("n_mentions"), F.count("*").alias("n_agents"), F.min("start").alias("start"), F.max("end").alias("end"))


def venn(table: DataFrame) -> DataFrame:
    return table.groupBy("agents").agg(F.count("*").alias("n"))


def agreement(grouped: DataFrame, attribute: str) -> DataFrame:
    """(pair, n, agree): agents' values compared over unambiguous groups; two nulls agree."""
    plain = grouped.join(group_table(grouped).where("not ambiguous").select(*KEYS, "grp"), [*KEYS, "grp"], "left_semi")
    a = plain.select(*KEYS, "grp", F.col("agent").alias("a"), F.col(attribute).alias("x"))
    b = plain.select(*KEYS, "grp", F.col("agent").alias("b"), F.col(attribute).alias("y"))
    both = a.join(b, [*KEYS, "grp"]).where("a < b")
    return both.groupBy(F.concat("a", "b").alias("pair")).agg(F.count("*").alias("n"), F.count_if(F.col("x").eqNullSafe(F.col("y"))).alias("agree"))


def coverage(mentions: DataFrame) -> DataFrame:
    """Share of mentions with a code, by agent and kind."""
    return mentions.groupBy("agent", "kind").agg(F.count("*").alias("n"), F.count("code").alias("coded"), F.round(F.count("code").cast("double") / F.count("*").cast("double"), 6).alias("share"))


def exclusive(grouped: DataFrame, agent: str) -> DataFrame:
    only = group_table(grouped).where(F.col("agents") == agent).select(*KEYS, "grp")
    return grouped.join(only, [*KEYS, "grp"], "left_semi")


def deduplicated(mentions: DataFrame) -> DataFrame:
    """First of equal (agent, kind, field, span); ``dropped`` counts the others."""
    w = Window.partitionBy("enc", "agent", "kind", "field", "start", "end")
    ranked = mentions.withColumn("_n", F.row_number().over(w.orderBy(F.col("code").asc_nulls_last()))).withColumn("dropped", F.count("*").over(w) - 1)
    return ranked.where("_n = 1").drop("_n")


def reclassified(mentions: DataFrame, drug_codes: DataFrame) -> DataFrame:
    """Conditions whose code is a drug's become drugs (``moved`` tells)."""
    known = drug_codes.select(F.col("code")).distinct().withColumn("_drug", F.lit(True))
    j = mentions.join(known, "code", "left").withColumn("moved", (F.col("kind") == "condition") & F.coalesce("_drug", F.lit(False)))
    return j.withColumn("kind", F.when(F.col("moved"), "drug").otherwise(F.col("kind"))).drop("_drug")


def agents_of(mentions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, agents): the sorted letters of the agents behind each key."""
    return mentions.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("agent")), "").alias("agents"))


def filter_state(mentions: DataFrame) -> DataFrame:
    """(enc, kind, code, agents): affirmed conditions of the patient with the agents that give them,
    and as therapy every affirmed coded drug of any moment (agents '')."""
    m = mentions.where("code is not null and state = 'affirmed'")
    cond = agents_of(m.where("kind = 'condition' and subject = 'patient'"), ["enc", "code"])
    drug = m.where("kind = 'drug'").select("enc", F.lit("therapy").alias("kind"), "code", F.lit("").alias("agents")).distinct()
    return cond.select("enc", F.lit("condition").alias("kind"), "code", "agents").union(drug)
