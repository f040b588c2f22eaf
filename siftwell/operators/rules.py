"""Safety rules: reasons for each prescription, and verdicts as their greatest severity.

Tables: drugs(enc, cls) to judge, therapy(enc, cls), allergies(enc, cls), conditions(enc, cond),
agents(enc, cond, n_agents, only_a) where known, contra(rule_id, target, trigger, verdict,
revoked, missing). Codes are hierarchical: a shorter code stands for all below it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALLOWED, VERIFY, FORBIDDEN = "allowed", "to_verify", "forbidden"
GROUP = 5


def severity(verdict):
    return F.when(verdict == FORBIDDEN, 2).when(verdict == VERIFY, 1).otherwise(0)


def name_of(severity):
    return F.element_at(F.array(F.lit(ALLOWED), F.lit(VERIFY), F.lit(FORBIDDEN)), (severity + 1).cast("int"))


def prefixes(code, shortest: int = 1):
    """All prefixes of a code of at least ``shortest`` characters, as an array."""
    return F.when(F.length(code) >= shortest, F.transform(F.sequence(F.lit(shortest), F.length(code)), lambda n: F.col(code).substr(F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def allergy_reasons(drugs: DataFrame, allergies: DataFrame, group: int = GROUP) -> DataFrame:
    """Same substance: forbidden. Same group, another substance: to verify, unless the first holds."""
    exact = drugs.join(allergies.select("enc", "cls").distinct(), ["enc", "cls"], "left_semi").select("enc", "cls", F.lit("allergy_exact").alias("reason"), F.lit(FORBIDDEN).alias("verdict"))
    grouped = allergies.select("enc", F.substring("cls", 1, group).alias("g")).distinct()
    near = drugs.withColumn("g", F.substring("cls", 1, group)).join(grouped, ["enc", "g"], "left_semi").join(exact.select("enc", "cls"), ["enc", "cls"], "left_anti")
    return exact.union(near.select("enc", "cls", F.lit("allergy_group"), F.lit(VERIFY)))


def duplicate_reasons(drugs: DataFrame, therapy: DataFrame, group: int = GROUP, itself: bool = True) -> DataFrame:
    """Therapy of the same substance, else of the same group: to verify.

    itself: the judged drug stands in the therapy on its own account, so it is no duplicate of itself.
    """
    t = therapy.select("enc", "cls").distinct()
    same = drugs.select("enc", "cls").join(t, ["enc", "cls"], "left_semi").distinct()
    g = F.when(F.length("cls") >= group, F.substring("cls", 1, group))
    others = t.withColumn("g", g).withColumnRenamed("cls", "other")
    d = drugs.withColumn("g", F.substring("cls", 1, group)).join(others, ["enc", "g"]).where("other != cls").select("enc", "cls").distinct()
    if not itself:
        d = d.join(same, ["enc", "cls"], "left_anti")
    near = d.select("enc", "cls", F.lit("duplicate_group").alias("reason"), F.lit(VERIFY).alias("verdict"))
    return near if itself else near.union(same.select("enc", "cls", F.lit("duplicate_substance"), F.lit(VERIFY)))


def contra_reasons(drugs: DataFrame, conditions: DataFrame, contra: DataFrame, agents: DataFrame | None = None) -> DataFrame:
    """Contraindications by condition; a revoking fact silences its rule, a missing fact or
    evidence from the dictionary alone turns a prohibition into something to verify.

    Prefixes are exploded on both sides, so every join is an equi-join; rules are few.
    """
    facts = conditions.select("enc", "cond", F.explode(prefixes("cond")).alias("trigger"))
    if agents is not None:
        facts = facts.join(agents.select("enc", "cond", "only_a"), ["enc", "cond"], "left")
    else:
        facts = facts.withColumn("only_a", F.lit(False))
    fired = facts.join(F.broadcast(contra), "trigger").groupBy("enc", "rule_id", "target", "verdict", "revoked", "missing").agg(F.min(F.coalesce("only_a", F.lit(False))).alias("only_a"), F.max(F.coalesce("only_a", F.lit(False))).alias("any_a"))
    of_rules = lambda df, c: df.join(F.broadcast(contra.select(c).distinct()), c, "left_semi")  # noqa: E731 - other prefixes meet no rule
    revoking = of_rules(conditions.select("enc", F.explode(prefixes("cond")).alias("revoked")), "revoked").distinct()
    live = fired.join(revoking, ["enc", "revoked"], "left_anti")
    targets = of_rules(drugs.select("enc", "cls", F.explode(prefixes("cls")).alias("target")), "target").select("enc", "cls", "target")
    hits = targets.join(live, ["enc", "target"])
    weak = (F.col("missing").isNotNull() | F.col("only_a")) & (F.col("verdict") == FORBIDDEN)
    named = hits.select("enc", "cls", F.concat(F.lit("contra_"), F.col("rule_id").cast("string")).alias("reason"), F.when(weak, VERIFY).otherwise(F.col("verdict")).alias("verdict"))
    if agents is None:
        return named
    # a prohibition that rests on the dictionary alone says so in a row of its own
    return named.union(hits.where(F.col("any_a") & (F.col("verdict") == FORBIDDEN)).select("enc", "cls", F.lit("weak_provenance"), F.lit(VERIFY)).distinct())


def all_reasons(drugs, allergies, therapy, conditions, contra, agents=None, group: int = GROUP, itself: bool = True) -> DataFrame:
    return allergy_reasons(drugs, allergies, group).union(duplicate_reasons(drugs, therapy, group, itself)).union(contra_reasons(drugs, conditions, contra, agents))


def candidate_reasons(classes: DataFrame, allergies: DataFrame, therapy: DataFrame, conditions: DataFrame, contra: DataFrame, agents: DataFrame | None = None, group: int = GROUP) -> DataFrame:
    """``all_reasons`` over every encounter's candidates (classes(cls), the same for all), without their product.

    Only candidates that share a group with an allergy or a therapy, or stand below the target of a
    contraindication whose trigger holds, can have a reason; those pairs come from equi-joins.
    """
    named = classes.select("cls").distinct().withColumn("g", F.substring("cls", 1, group))
    near = allergies.select("enc", "cls").union(therapy.select("enc", "cls")).select("enc", F.substring("cls", 1, group).alias("g")).distinct().join(named, "g").select("enc", "cls")
    fired = conditions.select("enc", F.explode(prefixes("cond")).alias("trigger")).join(F.broadcast(contra.select("trigger", "target")), "trigger").select("enc", "target").distinct()
    below = named.select("cls", F.explode(prefixes("cls")).alias("target")).join(fired, "target").select("enc", "cls")
    return all_reasons(near.union(below).distinct(), allergies, therapy, conditions, contra, agents, group, itself=False)


def verdicts(drugs: DataFrame, reasons: DataFrame) -> DataFrame:
    """(enc, cls, verdict, reasons): the greatest severity, all reasons sorted."""
    found = reasons.groupBy("enc", "cls").agg(F.max(severity(F.col("verdict"))).alias("s"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    full = drugs.join(found, ["enc", "cls"], "left")
    return full.select("enc", "cls", name_of(F.coalesce("s", F.lit(0))).alias("verdict"), F.coalesce("reasons", F.lit("")).alias("reasons"))


def admissible(grid: DataFrame, judged: DataFrame) -> DataFrame:
    """Candidates that are not forbidden."""
    return grid.join(judged.where(F.col("verdict") == FORBIDDEN).select("enc", "cls"), ["enc", "cls"], "left_anti")


def class_warnings(ranked: DataFrame, allergies: DataFrame) -> DataFrame:
    """A note on proposals whose class holds a substance the patient is allergic to; order unchanged."""
    hit = allergies.select("enc", F.explode(prefixes("cls")).alias("cls")).distinct().withColumn("note", F.lit("allergy within the class"))
    return ranked.join(hit, ["enc", "cls"], "left")
