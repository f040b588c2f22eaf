"""Provenance as typed tables: concepts with parents, assertions from groups, questions and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .alignment import KEYS, group_table

#: Code lengths of the hierarchy, coarsest first.
CODE_LEVELS = (1, 3, 4, 5, 7)


def concepts(codes: DataFrame, levels=CODE_LEVELS) -> DataFrame:
    """(code, level, parent): level by length; the parent is the longest shorter prefix that exists."""
    own = codes.select("code").distinct()
    cut = own.select("code", F.explode(F.array(*[F.lit(n) for n in levels])).alias("n")).where(F.col("n") < F.length("code"))
    up = cut.select("code", F.col("code").substr(F.lit(1), F.col("n")).alias("parent"))
    found = up.join(own.withColumnRenamed("code", "parent"), "parent", "left_semi").groupBy("code").agg(F.max(F.struct(F.length("parent"), "parent")).alias("p"))
    level = F.array_position(F.array(*[F.lit(n) for n in levels]), F.length("code")).cast("int")
    return own.join(found, "code", "left").select("code", level.alias("level"), F.col("p.parent").alias("parent"))


def dotted_parents(codes: DataFrame) -> DataFrame:
    """(code, parent): the part before the point, if it is a code itself."""
    own = codes.select("code").distinct()
    cat = own.select(F.col("code").alias("parent"))
    up = own.withColumn("parent", F.substring_index("code", ".", 1)).where("parent != code").join(cat, "parent", "left_semi")
    return own.join(up, "code", "left")


def closure(parents: DataFrame) -> DataFrame:
    """(code, ancestor) over any number of steps, for codes whose parents are prefixes: every shorter
    prefix of a code that is a code itself, found by one explosion and one semi-join."""
    own = parents.select("code").distinct()
    cut = own.where(F.length("code") > 1).select("code", F.explode(F.transform(F.sequence(F.lit(1), F.length("code") - 1), lambda n: F.col("code").substr(F.lit(1), n))).alias("ancestor"))
    return cut.join(own.withColumnRenamed("code", "ancestor"), "ancestor", "left_semi").select("code", "ancestor")


def assertions(grouped: DataFrame) -> DataFrame:
    """One row per group: id, kind ('mixed' where they differ), agents, ambiguity, codes and state."""
    per = grouped.groupBy(*KEYS, "grp").agg(
        F.when(F.min("kind") == F.max("kind"), F.min("kind")).otherwise("mixed").alias("kind"),
        F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"), F.min("state").alias("state"), F.min("subject").alias("subject"), F.max((F.col("code").isNull()).cast("int")).alias("unresolved"),
    )
    t = group_table(grouped).select(*KEYS, "grp", "agents", "n_agents", "ambiguous")
    return per.join(t, [*KEYS, "grp"]).withColumn("id", F.concat_ws("-", *KEYS, F.col("grp").cast("string")))


def retention(asserted: DataFrame) -> DataFrame:
    """(n_agents, kept): assertions that at least so many agents support."""
    n = asserted.groupBy("n_agents").agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("n_agents")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return n.select("n_agents", F.sum("n").over(w).alias("kept"))  # as many rows as agents


def top_groups(mentions: DataFrame, parents: DataFrame, n: int = 10) -> DataFrame:
    """The ancestors with most mentions; counts by code come first, the hierarchy after."""
    per = mentions.where("code is not null").groupBy("code").agg(F.count("*").alias("n"))
    return closure(parents).join(per, "code").groupBy("ancestor").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ancestor").limit(n)


def levels_used(mentions: DataFrame, table: DataFrame) -> DataFrame:
    used = mentions.where("code is not null").select("code").distinct().withColumn("u", F.lit(1))
    return table.join(used, "code", "left").groupBy("level").agg(F.count("*").alias("total"), F.count("u").alias("used"))


def support(grouped: DataFrame, asserted: DataFrame, enc, code: str) -> DataFrame:
    """Mentions behind a code in an encounter, ordered by start and agent."""
    m = grouped.where((F.col("enc") == enc) & (F.col("code") == code))
    return m.join(asserted.select(*KEYS, "grp", F.col("id").alias("assertion"), "agents"), [*KEYS, "grp"]).select("assertion", "agents", "agent", "start", "end", "state").orderBy("start", "agent")


def traces(proposals: DataFrame, fired: DataFrame, rules: DataFrame, grouped: DataFrame) -> DataFrame:
    """proposals(enc, cls) x indications x supporting mentions: one row per proposal and rule.

    fired: (enc, rule_id, code) with the code that triggered; n_support and agents from mentions.
    """
    p = proposals.select("enc", "cls", F.explode(F.transform(F.sequence(F.lit(1), F.length("cls")), lambda n: F.col("cls").substr(F.lit(1), n))).alias("target"))
    hit = p.join(F.broadcast(rules.select("rule_id", "target").distinct()), "target").join(fired, ["enc", "rule_id"])
    m = grouped.where("code is not null").groupBy("enc", "code").agg(F.count("*").alias("n_support"), F.array_join(F.array_sort(F.collect_set("agent")), "").alias("agents"))
    return hit.join(m, ["enc", "code"], "left").select("enc", "cls", "rule_id", "code", F.coalesce("n_support", F.lit(0)).alias("n_support"), F.coalesce("agents", F.lit("")).alias("agents"))


def to_triples(asserted: DataFrame) -> DataFrame:
    """(s, p, o) rows of assertions, for exchange; mention text never enters."""
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(c).cast("string").alias("o")) for p, c in (("kind", "kind"), ("agents", "n_agents"), ("state", "state"), ("subject", "subject"), ("codes", "codes"))])).alias("x")
    return asserted.select(F.col("id").alias("s"), each).select("s", "x.p", "x.o").where("o is not null and o != ''")
