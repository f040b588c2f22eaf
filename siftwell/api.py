"""The service surface as functions of DataFrames: propose, support, verify, search, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rules_data
from .functions import text as tx
from .operators import alignment, assembly, graph, intervals, parsing, ranking, resolve, rules, scopes, search
from .store import written


def mentions_of(sections: DataFrame, conditions: DataFrame, drugs: DataFrame, agent: str = "A") -> DataFrame:
    """Records (enc_oid, tipo, testo) -> mentions (enc, field, agent, kind, start, end, code, state, subject, moment).

    conditions(form, code) and drugs(form, code) are dictionaries; they go to the executors as a
    lookup by first token, so they must be terminologies, not data.
    """
    from .sources.records import TYPES, section

    history = section(sections, TYPES[0]).withColumnRenamed("enc_oid", "enc").withColumnRenamed("testo", "text")
    forms = {}
    for kind, table in (("condition", conditions), ("drug", drugs)):
        for r in table.groupBy("form").agg(F.array_sort(F.collect_set("code")).alias("codes")).collect():  # a terminology
            forms.setdefault(r.form, f"{kind}|{r.codes[0] if len(r.codes) == 1 else ''}")
    found = scopes.dictionary_table(history, "enc", "text", forms)
    kept = intervals.longest_wins(found, ["enc"]).withColumn("id", F.xxhash64("enc", "start", "end"))
    judged = scopes.assessed(kept, scopes.scope_table(history, "enc", "text"), scopes.family_table(history, "enc", "text"), "enc")
    part = F.split("label", r"\|")
    prose = judged.select("enc", F.lit("history").alias("field"), F.lit(agent).alias("agent"), part[0].alias("kind"), "start", "end", F.nullif(part[1], F.lit("")).alias("code"), "state", "subject", F.lit("history").alias("moment"))
    parsed = []
    for kind, moment, parse, name in ((TYPES[1], "admission", parsing.admission_items, "name"), (TYPES[2], "discharge", parsing.discharge_items, "principle")):
        texts = section(sections, kind).select(F.col("enc_oid").alias("enc"), F.col("testo").alias("text"))
        items = assembly.placed_items(parse(texts).where(f"{name} is not null"), texts, "enc", name)  # repeated names share the first place
        codes = resolve.last_wins(drugs.withColumn("_p", F.col("code")), "form", "code", "_p")
        hit = items.withColumn("form", F.lower(name)).join(codes, "form", "left")
        parsed.append(hit.select("enc", F.lit(moment).alias("field"), F.lit("P").alias("agent"), F.lit("drug").alias("kind"), "start", "end", "code", F.lit("affirmed").alias("state"), F.lit("patient").alias("subject"), F.lit(moment).alias("moment")))
    return prose.unionByName(parsed[0]).unionByName(parsed[1])


def allergies_of(sections: DataFrame, drugs: DataFrame) -> DataFrame:
    """(enc, kind, allergen, code) of the history sections; only active principles are coded."""
    from .sources.records import TYPES, section

    texts = section(sections, TYPES[0]).select(F.col("enc_oid").alias("enc"), F.col("testo").alias("text"))
    return parsing.allergy_values(texts, drugs.groupBy("form").agg(F.min("code").alias("code")))


def facts(mentions: DataFrame) -> DataFrame:
    """Only what is affirmed of the patient and coded acts."""
    return mentions.where("state = 'affirmed' and subject = 'patient' and code is not null")


def propose(spark: SparkSession, mentions: DataFrame, allergies: DataFrame, candidates: DataFrame, n: int = 8, unit: int = 5) -> DataFrame:
    """Ranked classes per encounter with verdict, reasons, number of fired rules and a note; n from 1 to 15."""
    n = max(1, min(15, n))
    f = facts(mentions)
    cond = f.where("kind = 'condition'").select("enc", F.col("code").alias("cond")).distinct()
    now = f.where("kind = 'drug' and moment = 'admission'").select("enc", F.substring("code", 1, unit).alias("cls")).distinct()
    sides = now.withColumn("adm", F.lit(True)).select("enc", "adm", "cls")
    cases = mentions.select("enc").distinct().withColumn("fold", F.lit(0))  # one order of candidates for all
    cands = candidates.select(F.lit(0).alias("fold"), "cls").distinct()
    own = ranking.by_rules_of_fold(cands, cases, rules_data.indications(spark), cond, sides)
    # what no rule fires on stands in code order; a forbidden candidate makes room for the next one
    reasons = rules.candidate_reasons(cands.select("cls"), allergies, now, cond, rules_data.contraindications(spark), group=unit)
    barred = reasons.where(F.col("verdict") == rules.FORBIDDEN).select("enc", "cls").distinct()
    ranked = ranking.first_k(ranking.placed(ranking.constant(cands)), cases, now.union(barred).distinct(), n, own)
    judged = rules.verdicts(ranked.select("enc", "cls"), reasons.join(ranked.select("enc", "cls"), ["enc", "cls"], "left_semi"))
    return rules.class_warnings(ranked.join(judged, ["enc", "cls"]), allergies)


CITED, MEASURED = "cited indication", "measured co-occurrence"


def text_to_proposals(spark: SparkSession, sections: DataFrame, conditions: DataFrame, drugs: DataFrame, candidates: DataFrame, n: int = 6, unit: int = 5) -> DataFrame:
    """The whole chain, from records (enc_oid, tipo, testo) to ranked proposals with their grounds.

    Columns of ``propose`` (enc, cls, score, rank, verdict, reasons, note), and strength of the best cited
    indication, the fact that no text gives, grounding (a proposal without an indication rests on measured
    co-occurrence only and says so), and notes on what the record lacks.
    """
    m = written(mentions_of(sections, conditions, drugs), "mentions")  # read by every step that follows
    a = written(allergies_of(sections, drugs), "allergies")
    proposals = propose(spark, m, a.where("code is not null").select("enc", F.col("code").alias("cls")).distinct(), candidates, n, unit)
    f = facts(m)
    cond = f.where("kind = 'condition'").select("enc", F.col("code").alias("cond")).distinct()
    now = f.where("kind = 'drug' and moment = 'admission'").select("enc", F.lit(True).alias("adm"), F.substring("code", 1, unit).alias("cls")).distinct()
    fired = ranking.fired_rules(rules_data.indications(spark), cond, now).join(F.broadcast(rules_data.indication_facts(spark)), "rule_id")
    best = ranking.prefix_rows(proposals.select("enc", "cls"), "cls", "target").join(fired, ["enc", "target"])
    best = best.groupBy("enc", "cls").agg(F.min(F.struct((-F.col("weight")).alias("w"), "rule_id", "strength", "missing")).alias("b")).select("enc", "cls", "b.strength", "b.missing")
    out = proposals.join(best, ["enc", "cls"], "left")
    grounding = F.when(F.col("strength").isNotNull(), CITED).otherwise(MEASURED)
    return out.withColumn("grounding", grounding).join(missing_facts(sections, m, a), "enc", "left")


def missing_facts(sections: DataFrame, mentions: DataFrame, allergies: DataFrame) -> DataFrame:
    """(enc, lacking): what a record lacks, sorted and joined by ';'."""
    from .sources.records import TYPES

    encs = sections.select(F.col("enc_oid").alias("enc")).distinct()
    coded = mentions.where("kind = 'condition' and code is not null and state = 'affirmed' and subject = 'patient'").select("enc").distinct()
    no_condition = encs.join(coded, "enc", "left_anti").select("enc", F.lit("no coded condition").alias("x"))
    uncoded = allergies.where(F.col("kind").startswith("principi") & F.col("code").isNull()).select("enc", F.concat(F.lit("allergy without a code: "), "allergen").alias("x"))
    listed = sections.where((F.col("tipo") == TYPES[1]) & (F.trim("testo") != "")).select(F.col("enc_oid").alias("enc")).distinct()
    parsed = mentions.where("moment = 'admission'").select("enc").distinct()
    unread = listed.join(parsed, "enc", "left_anti").select("enc", F.lit("no drug read from the therapy").alias("x"))
    every = no_condition.union(uncoded).union(unread)
    return every.groupBy("enc").agg(F.array_join(F.array_sort(F.collect_set("x")), ";").alias("lacking"))


def verify(spark: SparkSession, prescriptions: DataFrame, registry: DataFrame, conditions: DataFrame, therapy: DataFrame, allergies: DataFrame) -> DataFrame:
    """Verdict of each (enc, cls); a malformed or unknown code is rejected, never allowed."""
    ok = F.coalesce(F.col("cls").rlike(tx.ATC_CODE), F.lit(False))
    known = registry.select(F.explode(rules.prefixes("code")).alias("cls")).distinct().withColumn("_known", F.lit(True))
    p = prescriptions.join(known, "cls", "left").withColumn("_ok", ok & F.coalesce("_known", F.lit(False)))
    good = p.where("_ok").select("enc", "cls")
    judged = rules.verdicts(good, rules.all_reasons(good, allergies, therapy, conditions, rules_data.contraindications(spark)))
    return judged.unionByName(p.where("not _ok").select("enc", "cls", F.lit("rejected").alias("verdict"), F.lit("unknown_code").alias("reasons")))


def support(mentions: DataFrame, enc: int, code: str) -> DataFrame:
    g = alignment.groups(mentions)
    return graph.support(g, graph.assertions(g), enc, code)


def find_code(table: DataFrame, query: str, limit: int = 20) -> DataFrame:
    return search.search(table, query, limit)


def statistics(mentions: DataFrame) -> DataFrame:
    """One row per kind: mentions, encounters, coded, and states."""
    states = [F.count_if(F.col("state") == s).alias(s) for s in ("affirmed", "negated", "uncertain")]
    return mentions.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("enc").alias("n_enc"), F.count("code").alias("coded"), *states)
