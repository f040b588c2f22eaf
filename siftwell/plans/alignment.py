"""Queries of alignment, provenance and rules, over events as mentions of three agents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as al
from ..operators import graph as gr
from ..operators import intervals as iv
from ..operators import ranking as rk
from ..operators import rules as ru
from ..store import written
from . import views as v

QUERIES, ORACLES = {}, {}


def register(name, oracle=None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def mentions(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    start = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    return v.table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("enc"), F.lit("F").alias("field"), F.substring(F.lit("ABC"), (F.col("event_id") % 3 + 1).cast("int"), F.lit(1)).alias("agent"),
        F.when(F.col("event_id") % 2 == 0, "condition").otherwise("drug").alias("kind"), start.alias("start"), (start + F.floor(F.col("value") * 600000) + 1).alias("end"),
        F.when(k >= 10, F.concat(F.substring(F.lit("ABCDEFGHIJ"), (k / 10).cast("int") + 1, F.lit(1)), F.lpad(k.cast("string"), 2, "0"))).alias("code"),
        F.when(k % 3 == 0, "affirmed").when(k % 3 == 1, "negated").otherwise("uncertain").alias("state"), F.when(k % 7 == 0, "family").otherwise("patient").alias("subject"),
    )


M = """e as (select *, cast(json_extract(props, '$.k') as int) k, epoch_us(ts) // 1000 s from events),
men as (select event_id id, user_id enc, 'F' field, substr('ABC', (event_id % 3 + 1)::int, 1) agent, case when event_id % 2 = 0 then 'condition' else 'drug' end kind, s "start", s + floor(value * 600000)::bigint + 1 "end",
  case when k >= 10 then substr('ABCDEFGHIJ', k // 10 + 1, 1) || lpad(k::varchar, 2, '0') end code, case k % 3 when 0 then 'affirmed' when 1 then 'negated' else 'uncertain' end state, case when k % 7 = 0 then 'family' else 'patient' end subject from e)"""
G = M + """, o as (select *, max("end") over (partition by enc, field order by "start", "end", agent, code nulls first rows between unbounded preceding and 1 preceding) reach from men),
g as (select *, sum(case when reach is null or "start" >= reach then 1 else 0 end) over (partition by enc, field order by "start", "end", agent, code nulls first rows unbounded preceding) grp from o),
gt as (select enc, field, grp, string_agg(distinct agent, '' order by agent) agents, count(*) > count(distinct agent) ambiguous, count(*) n, count(distinct agent) n_agents, min("start") "start", max("end") "end" from g group by 1, 2, 3)"""


@register("interval_groups", f"with {G} select enc, grp::bigint as grp, agents, ambiguous, n::bigint as n_mentions, \"start\", \"end\" from gt")
def interval_groups(spark, sf):
    return al.group_table(al.groups(mentions(spark, sf))).select("enc", "grp", "agents", "ambiguous", "n_mentions", "start", "end")


@register("touching_merge", """with t as (select user_id enc, event_id, epoch_us(ts) // 3600000000 s, epoch_us(ts) // 3600000000 + 24 f from events),
o as (select *, max(f) over (partition by enc order by s, f, event_id rows between unbounded preceding and 1 preceding) reach from t),
g as (select *, sum(case when reach is null or s > reach then 1 else 0 end) over (partition by enc order by s, f, event_id rows unbounded preceding) grp from o)
select enc, grp::bigint as grp, min(s) as "start", max(f) as "end", count(*) as n from g group by 1, 2""")
def touching(spark, sf):
    s = F.expr("unix_micros(cast(ts as timestamp)) div 3600000000")
    t = v.table(spark, sf, "events").select(F.col("user_id").alias("enc"), "event_id", s.alias("start"), (s + 24).alias("end"))
    return iv.merged(t, ["enc"], "start", "end", ["event_id"], touching=True)


@register("venn_counts", f"with {G} select agents, count(*) as n from gt group by 1")
def venn(spark, sf):
    return al.venn(al.group_table(al.groups(mentions(spark, sf))))


@register("agreement_pairs", f"with {G}, p as (select g.* from g join gt using (enc, field, grp) where not ambiguous) select a.agent || b.agent as pair, count(*) as n, count(*) filter (a.code is not distinct from b.code) as agree from p a join p b on a.enc = b.enc and a.field = b.field and a.grp = b.grp and a.agent < b.agent group by 1")
def agreement(spark, sf):
    return al.agreement(al.groups(mentions(spark, sf)), "code")


@register("exclusive_mentions", f"with {G} select kind, count(*) as n from g join gt using (enc, field, grp) where agents = 'B' group by 1")
def exclusive(spark, sf):
    return al.exclusive(al.groups(mentions(spark, sf)), "B").groupBy("kind").agg(F.count("*").alias("n"))


@register("code_coverage", f"with {M} select agent, kind, count(*) as n, count(code) as coded, round(count(code)::double / count(*), 6) as share from men group by 1, 2")
def coverage(spark, sf):
    return al.coverage(mentions(spark, sf))


@register("comparison_summary", f"with {G} select kind, count(*) as n, count(*) filter (n_agents >= 2) as supported, count(*) filter (agents <> 'B') as without_b, round(count(*) filter (agents in ('AB', 'BC', 'ABC'))::double / count(*) filter (agents <> 'B'), 6) as parser_recall from (select distinct on (enc, field, grp) g.kind, gt.* from g join gt using (enc, field, grp) order by enc, field, grp, kind) group by 1")
def comparison(spark, sf):
    """Groups by kind of their first mention, agents' support, and what B's agreement says about recall."""
    g = al.groups(mentions(spark, sf))
    first = g.groupBy(*al.KEYS, "grp").agg(F.min("kind").alias("kind"))
    t = al.group_table(g).join(first, [*al.KEYS, "grp"])
    both, rest = F.col("agents").isin("AB", "BC", "ABC"), F.col("agents") != "B"
    return t.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("n_agents") >= 2).alias("supported"), F.count_if(rest).alias("without_b"), F.round(F.count_if(both).cast("double") / F.count_if(rest).cast("double"), 6).alias("parser_recall"))


@register("dedupe_reclassify", f"""with {M}, c as (select *, epoch_us(e.ts) // 7200000000 slot from men join e on e.event_id = men.id), d as (select enc, agent, kind, slot, count(*) n, min(code) code from (select c.enc, agent, kind, slot, code from c) group by 1, 2, 3, 4)
select agent, case when kind = 'condition' and code >= 'F' then 'drug' else kind end as kind, count(*) as n, cast(sum(n - 1) as bigint) as dropped, count(*) filter (kind = 'condition' and code >= 'F') as moved from (select * from d) group by 1, 2""")
def dedupe(spark, sf):
    m = mentions(spark, sf)
    slot = F.floor(F.col("start") / 7200000)
    d = al.deduplicated(m.withColumn("start", slot).withColumn("end", slot + 1))
    # of equal spans the least code stays; nulls come last
    drugs = m.where("code >= 'F'").select("code").distinct()
    r = al.reclassified(d, drugs)
    return r.groupBy("agent", "kind").agg(F.count("*").alias("n"), F.sum("dropped").alias("dropped"), F.count_if("moved").alias("moved"))


@register("overlap_join_latest", f"""with {M}, a as (select * from men where agent = 'A'), b as (select * from men where agent = 'B'),
j as (select a.id, a.enc, b.id s_id, row_number() over (partition by a.id order by b."start" desc, b."end" desc, b.id desc) rn from a join b on a.enc = b.enc and b."start" < a."end" and a."start" < b."end") select enc, id, s_id from j where rn = 1""")
def overlap_latest(spark, sf):
    m = mentions(spark, sf)
    b = m.where("agent = 'B'").select("enc", F.col("start").alias("s_start"), F.col("end").alias("s_end"), F.col("id").alias("s_id"))
    return iv.overlap_latest(m.where("agent = 'A'").select("enc", "id", "start", "end"), b, ["enc"], 24 * 3600000).select("enc", "id", "s_id")


@register("containment_join", f"""with {M}, a as (select * from men where agent = 'A'), b as (select * from men where agent = 'B'),
j as (select a.id, a.enc, b.id s_id, row_number() over (partition by a.id order by b."start", b.id) rn from a join b on a.enc = b.enc and a."start" >= b."start" and a."end" <= b."end") select enc, id, s_id from j where rn = 1""")
def containment(spark, sf):
    m = mentions(spark, sf)
    b = m.where("agent = 'B'").select("enc", F.col("start").alias("s_start"), F.col("end").alias("s_end"), F.col("id").alias("s_id"))
    return iv.contained_first(m.where("agent = 'A'").select("enc", "id", "start", "end"), b, ["enc"], 24 * 3600000).select("enc", "id", "s_id")


APART = ["enc", "field", "grp"]


def apart(m):
    """Mentions with ``grp``: mentions of one encounter and field in different groups cannot overlap."""
    return iv.merge_groups(m, ["enc", "field"], "start", "end", ["id"])


@register("longest_wins", f"""with {M}, w as (select enc, field, list([{{'s': "start", 'e': "end", 'l': agent || id}}] order by "start" - "end", "start", agent || id, "end") x from men group by 1, 2),
k as (select enc, unnest(list_reduce(x, lambda acc, y: case when len(list_filter(acc, lambda z: z.s < y[1].e and y[1].s < z.e)) > 0 then acc else list_concat(acc, y) end)) u from w)
select enc, u.s // 86400000 as day, u.s as "start", u.e as "end", u.l as label from k""")
def longest(spark, sf):
    m = apart(mentions(spark, sf).withColumn("label", F.concat("agent", F.col("id").cast("string"))))
    # the day of the start is shown only; spans run over midnight
    return iv.longest_wins(m, APART).select("enc", F.floor(F.col("start") / 86400000).alias("day"), "start", "end", "label")


@register("gold_overlap_prf", f"""with {M}, g as (select enc, field, list([{{'gs': "start", 'ge': "end", 'fs': null::bigint, 'fe': null::bigint}}] order by "start", "end") x from men where agent = 'A' group by 1, 2),
f as (select enc, field, list({{'s': "start", 'e': "end"}} order by "start", "end") y from men where agent = 'B' group by 1, 2),
m as (select list_reduce(list_concat([[{{'gs': null::bigint, 'ge': null::bigint, 'fs': null::bigint, 'fe': null::bigint}}]], x), lambda acc, z: list_concat(acc, list_transform(
  [list_filter(coalesce(y, []), lambda q: q.s < z[1].ge and z[1].gs < q.e and len(list_filter(acc, lambda u: u.fs = q.s and u.fe = q.e)) = 0)[1]], lambda q: {{'gs': z[1].gs, 'ge': z[1].ge, 'fs': q.s, 'fe': q.e}}))) r from g left join f using (enc, field)),
n as (select (select count(*) from men where agent = 'B') np, (select count(*) from men where agent = 'A') nt, (select count(*) from (select unnest(r) u from m) where u.fs is not null) nh)
select np, nt, nh, round(nh::double / np, 6) as precision, round(nh::double / nt, 6) as recall, round(2 * nh::double / (np + nt), 6) as f1 from n""")
def gold_prf(spark, sf):
    """Agent A as the gold standard for B: one-to-one greedy matches, then P, R and F1."""
    m = apart(mentions(spark, sf).where("agent in ('A', 'B')"))
    g, f = (m.where(F.col("agent") == x).select(*APART, "start", "end") for x in "AB")
    hits = iv.greedy_matches(g, f, APART).agg(F.count("found_start").alias("nh"), F.count("*").alias("nt"))
    from ..operators.evaluation import prf

    return prf(hits.crossJoin(f.agg(F.count("*").alias("np")))).select("np", "nt", "nh", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])  # one row each


A = G + """, asr as (select g.enc, g.field, g.grp, case when min(kind) = max(kind) then min(kind) else 'mixed' end kind, coalesce(string_agg(distinct code, ',' order by code), '') codes, min(state) state, min(subject) subject, max((code is null)::int) unresolved, any_value(agents) agents, any_value(n_agents) n_agents, any_value(ambiguous) ambiguous from g join gt using (enc, field, grp) group by 1, 2, 3)"""


def asserted(spark, sf):
    return gr.assertions(al.groups(mentions(spark, sf)))


@register("assertions", f"with {A} select enc, grp::bigint as grp, kind, codes, state, subject, unresolved::int as unresolved, agents, n_agents, ambiguous from asr")
def assertions(spark, sf):
    return asserted(spark, sf).select("enc", "grp", "kind", "codes", "state", "subject", "unresolved", "agents", "n_agents", "ambiguous")


@register("consensus_histogram", f"with {A} select n_agents, count(*) as n from asr group by 1")
def consensus(spark, sf):
    return asserted(spark, sf).groupBy("n_agents").agg(F.count("*").alias("n"))


@register("solo_by_agent", f"with {A} select agents, count(*) as n, count(distinct enc) as n_enc from asr where n_agents = 1 group by 1")
def solo(spark, sf):
    return asserted(spark, sf).where("n_agents = 1").groupBy("agents").agg(F.count("*").alias("n"), F.countDistinct("enc").alias("n_enc"))


@register("only_agent_a", f"with {M} select count(*) as n from (select enc, code from men where code is not null group by 1, 2 having bool_and(agent = 'A'))")
def only_a(spark, sf):
    """Codes of an encounter that no agent but A gives."""
    return agents_per_code(spark, sf).where("only_a").agg(F.count("*").alias("n"))


def agents_per_code(spark, sf):
    m = mentions(spark, sf).where("code is not null")
    return al.agents_of(m, ["enc", "code"]).select("enc", "code", F.length("agents").alias("n_agents"), (F.col("agents") == "A").alias("only_a"))


@register("state_subject_matrix", f"with {A} select state, subject, count(*) as n from asr group by 1, 2")
def matrix(spark, sf):
    return asserted(spark, sf).groupBy("state", "subject").agg(F.count("*").alias("n"))


@register("unresolved_by_type", f"with {A} select kind, count(*) as n, cast(sum(unresolved) as bigint) as unresolved from asr group by 1")
def unresolved(spark, sf):
    return asserted(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.sum("unresolved").alias("unresolved"))


@register("retention_curve", f"with {A}, n as (select n_agents, count(*) n from asr group by 1) select n_agents, cast(sum(n) over (order by n_agents desc rows unbounded preceding) as bigint) as kept from n")
def retention(spark, sf):
    return gr.retention(asserted(spark, sf))


def hierarchy(spark, sf):
    c = mentions(spark, sf).where("code is not null").select("code").distinct()
    return c.union(c.select(F.substring("code", 1, 1))).distinct()


@register("top_groups_by_parent", f"with {M} select substr(code, 1, 1) as ancestor, count(*) as n from men where code is not null group by 1 order by n desc, ancestor limit 10")
def top_groups(spark, sf):
    return gr.top_groups(mentions(spark, sf), gr.concepts(hierarchy(spark, sf)))


@register("levels_used", f"with {M}, c as (select distinct code from men where code is not null), h as (select code from c union select substr(code,1,1) from c) select case length(h.code) when 1 then 1 else 2 end as level, count(*) as total, count(c.code) as used from h left join c on c.code = h.code group by 1")
def levels(spark, sf):
    return gr.levels_used(mentions(spark, sf), gr.concepts(hierarchy(spark, sf)))


PARTS = f"with {v.base_sql(3)}, h as (select distinct substr(code, 1, n) code from code, (values (1), (3), (4), (7)) l(n))"


def part_codes(spark, sf):
    return v.codes(spark, sf).select(F.explode(F.array(*[F.substring("code", 1, n) for n in (1, 3, 4, 7)])).alias("code"))


@register("code_parents", PARTS + " select code, case length(code) when 1 then 1 when 3 then 2 when 4 then 3 when 5 then 4 else 5 end as level, case length(code) when 3 then substr(code,1,1) when 4 then substr(code,1,3) when 7 then substr(code,1,4) end as parent from h")
def code_parents(spark, sf):
    return gr.concepts(part_codes(spark, sf))


@register("hierarchy_closure", PARTS + " select a.code, b.code as ancestor from h a join h b on length(b.code) < length(a.code) and starts_with(a.code, b.code)")
def closure(spark, sf):
    return gr.closure(gr.concepts(part_codes(spark, sf)))


@register("dotted_parents", "with c as (select distinct 'I'||lpad((p_size % 30)::varchar, 2, '0') || case when p_partkey % 3 = 0 then '' else '.' || (p_partkey % 7)::varchar end code from part) select code, (select p.code from c p where p.code = split_part(c.code, '.', 1) and p.code <> c.code) as parent from c")
def dotted(spark, sf):
    c = v.table(spark, sf, "part").select(F.concat(F.lit("I"), F.lpad((F.col("p_size") % 30).cast("string"), 2, "0"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("."), (F.col("p_partkey") % 7).cast("string")))).alias("code"))
    return gr.dotted_parents(c).select("code", "parent")


@register("concept_support", f"with {A} select g.enc || '-F-' || g.grp::bigint::varchar as assertion, asr.agents, agent, \"start\", \"end\", g.state from g join asr using (enc, field, grp) where enc = 7 and code = 'D35'")
def concept_support(spark, sf):
    g = al.groups(mentions(spark, sf))
    return gr.support(g, gr.assertions(g), 7, "D35")


@register("trace_chain", f"""with {M}, cc as (select distinct enc, code from men where code is not null and state = 'affirmed' and subject = 'patient'),
r(rule_id, target, tr) as (values (1, 'E', 'A'), (2, 'P1', 'B1'), (3, 'S', 'C'), (4, 'L2', 'F')), p(cls) as (values ('E01'), ('P12'), ('S33'), ('L21')),
f as (select enc, rule_id, target, code from cc join r on starts_with(code, tr)), m as (select enc, code, count(*) n, string_agg(distinct agent, '' order by agent) agents from men group by 1, 2)
select f.enc, cls, rule_id, f.code, n as n_support, agents from f join p on starts_with(cls, target) join m using (enc, code)""")
def trace_chain(spark, sf):
    m = mentions(spark, sf)
    rules = spark.createDataFrame([(1, "E", "A"), (2, "P1", "B1"), (3, "S", "C"), (4, "L2", "F")], "rule_id int, target string, trigger string")
    facts = m.where("code is not null and state = 'affirmed' and subject = 'patient'").select("enc", "code").distinct()
    fired = facts.withColumn("trigger", F.explode(ru.prefixes("code"))).join(F.broadcast(rules), "trigger").select("enc", "rule_id", "code")
    props = facts.select("enc").distinct().withColumn("cls", F.explode(F.array(*[F.lit(x) for x in ("E01", "P12", "S33", "L21")])))
    return gr.traces(props, fired, rules, al.groups(m))


@register("triples_by_predicate", f"with {A} select p, count(*) as n from (select unnest(['kind', 'agents', 'state', 'subject', 'codes']) p, unnest([kind, n_agents::varchar, state, subject, codes]) o from asr) where o is not null and o <> '' group by 1")
def triples(spark, sf):
    return gr.to_triples(asserted(spark, sf)).groupBy("p").agg(F.count("*").alias("n"))


# --- safety rules over the analogue views; allergies are error events whose key names a class ---
R = v.base_sql(3) + """, pool as (select cls, row_number() over (order by cls) - 1 i, count(*) over () n from (select distinct cls from sides)),
al as (select distinct user_id enc, cls from events join pool on pool.i = cast(json_extract(props, '$.k') as int) * 3 % pool.n where event_type = 'error'),
drugs as (select distinct enc, cls from aft),
re as (select enc, cls, 'allergy_exact' reason, 'forbidden' verdict from drugs where (enc, cls) in (select (enc, cls) from al)
 union select enc, cls, 'allergy_group', 'to_verify' from drugs d where (enc, cls) not in (select (enc, cls) from al) and exists (select 1 from al where al.enc = d.enc and substr(al.cls,1,1) = substr(d.cls,1,1))
 union select enc, cls, 'duplicate_group', 'to_verify' from drugs d where exists (select 1 from bef where bef.enc = d.enc and substr(bef.cls,1,1) = substr(d.cls,1,1) and bef.cls <> d.cls)
 union select d.enc, d.cls, 'contra_' || rule_id, case when missing is not null and verdict = 'forbidden' then 'to_verify' else verdict end from drugs d join contra on starts_with(d.cls, target)
   where exists (select 1 from cond where cond.enc = d.enc and starts_with(cond, tr)) and not exists (select 1 from cond where cond.enc = d.enc and revoked is not null and starts_with(cond, revoked))),
ver as (select d.enc, d.cls, coalesce(max(case verdict when 'forbidden' then 2 when 'to_verify' then 1 end), 0) s, coalesce(string_agg(distinct reason, ',' order by reason), '') reasons from drugs d left join re on re.enc = d.enc and re.cls = d.cls group by 1, 2)"""


def allergies(spark, sf, s):
    from pyspark.sql import Window

    pool = s.select("cls").distinct()  # the code vocabulary
    pool = pool.withColumn("i", F.row_number().over(Window.orderBy("cls")) - 1)
    n = pool.count()
    k = F.get_json_object("props", "$.k").cast("int")
    e = v.table(spark, sf, "events").where("event_type = 'error'").select(F.col("user_id").alias("enc"), (k * 3 % n).alias("i"))
    return e.join(pool, "i").select("enc", "cls").distinct()


def safety(spark, sf):
    s = written(v.sides(spark, sf), "sides")
    drugs, a = rk.after(s).distinct(), allergies(spark, sf, s)
    return s, drugs, a, ru.all_reasons(drugs, a, rk.before(s), v.conditions(spark, sf), v.contra(spark), group=1)


@register("verdict_counts", f"with {R} select case s when 2 then 'forbidden' when 1 then 'to_verify' else 'allowed' end as verdict, count(*) as n from ver group by 1")
def verdict_counts(spark, sf):
    _, d, _, r = safety(spark, sf)
    return ru.verdicts(d, r).groupBy("verdict").agg(F.count("*").alias("n"))


@register("verdict_reasons", f"with {R} select enc, cls, case s when 2 then 'forbidden' when 1 then 'to_verify' else 'allowed' end as verdict, reasons from ver")
def verdict_reasons(spark, sf):
    _, d, _, r = safety(spark, sf)
    return ru.verdicts(d, r)


@register("rule_hits", f"with {R} select reason, verdict, count(*) as n from re group by 1, 2")
def rule_hits(spark, sf):
    _, _, _, r = safety(spark, sf)
    return r.groupBy("reason", "verdict").agg(F.count("*").alias("n"))


@register("allergy_group_check", f"with {R} select reason, count(*) as n, count(distinct enc) as n_enc from re where starts_with(reason, 'allergy') group by 1")
def allergy_check(spark, sf):
    _, d, a, _ = safety(spark, sf)
    return ru.allergy_reasons(d, a, 1).groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("enc").alias("n_enc"))


@register("contra_with_revocation", f"with {R} select enc, cls, reason, verdict from re where starts_with(reason, 'contra')")
def contra_check(spark, sf):
    _, d, _, _ = safety(spark, sf)
    return ru.contra_reasons(d, v.conditions(spark, sf), v.contra(spark))


@register("duplicate_class", f"with {R} select count(*) as n, count(distinct enc) as n_enc from re where reason = 'duplicate_group'")
def duplicate_check(spark, sf):
    s, d, _, _ = safety(spark, sf)
    return ru.duplicate_reasons(d, rk.before(s), 1).agg(F.count("*").alias("n"), F.countDistinct("enc").alias("n_enc"))


@register("candidate_filter", f"with {R}, ok as (select * from grid where not exists (select 1 from al where al.enc = grid.enc and al.cls = grid.cls)) select fold::int as fold, count(*) as n from ok group by 1")
def candidate_filter(spark, sf):
    """Candidates that an exact allergy does not forbid: all of a fold's encounters have the same ones, so only those struck out are pairs."""
    s, f, cands = v.base(spark, sf)
    near = allergies(spark, sf, s).join(f, "enc").join(cands, ["fold", "cls"]).select("enc", "fold", "cls")
    judged = ru.verdicts(near.select("enc", "cls"), ru.allergy_reasons(near.select("enc", "cls"), near.select("enc", "cls"), 3))
    struck = judged.where(F.col("verdict") == ru.FORBIDDEN).join(f, "enc").groupBy("fold").agg(F.count("*").alias("struck"))
    each = f.groupBy("fold").agg(F.count("*").alias("encs")).join(cands.groupBy("fold").agg(F.count("*").alias("m")), "fold").join(struck, "fold", "left")
    return each.select("fold", (F.col("encs") * F.col("m") - F.coalesce("struck", F.lit(0))).alias("n"))


@register("class_warning", f"with {R}, {v.scores_sql('frequency')}, {v.ranked_sql()}, sub as (select distinct user_id enc, cls || '01' cls from events join pool on pool.i = cast(json_extract(props, '$.k') as int) * 3 % pool.n where event_type = 'error') select r.enc, r.cls, rnk::int as rank, case when exists (select 1 from sub where sub.enc = r.enc and starts_with(sub.cls, r.cls)) then 'allergy within the class' end as note from ranked r where rnk <= 5")
def class_warning(spark, sf):
    from . import ranking as rp

    s, _, r = rp.ranked("frequency", spark, sf, k=5)
    sub = allergies(spark, sf, s).withColumn("cls", F.concat("cls", F.lit("01")))
    return ru.class_warnings(r, sub).select("enc", "cls", "rank", "note")


@register("a_only_downgrade", f"""with {M}, ag as (select enc, code cond, bool_and(agent = 'A') only_a from men where code is not null group by 1, 2),
c(rule_id, target, tr) as (values (1, 'E', 'A'), (2, 'P', 'D3'), (3, 'S', 'G')), d(cls) as (values ('E01'), ('P12'), ('S33')),
f as (select enc, rule_id, target, bool_and(only_a) w, bool_or(only_a) x from ag join c on starts_with(cond, tr) group by 1, 2, 3)
select cls, 'contra_' || rule_id as reason, case when w then 'to_verify' else 'forbidden' end as verdict, count(*) as n from f join d on starts_with(cls, target) group by 1, 2, 3
union all select cls, 'weak_provenance', 'to_verify', count(*) from f join d on starts_with(cls, target) where x group by 1""")
def a_only(spark, sf):
    ag = agents_per_code(spark, sf).withColumnRenamed("code", "cond")
    contra = spark.createDataFrame([(1, "E", "A", "forbidden", None, None), (2, "P", "D3", "forbidden", None, None), (3, "S", "G", "forbidden", None, None)], "rule_id int, target string, trigger string, verdict string, revoked string, missing string")
    d = ag.select("enc").distinct().withColumn("cls", F.explode(F.array(*[F.lit(x) for x in ("E01", "P12", "S33")])))
    return ru.contra_reasons(d, ag.select("enc", "cond"), contra, ag).groupBy("cls", "reason", "verdict").agg(F.count("*").alias("n"))


@register("duplicate_substance", f"""with {R}, al1 as (select enc, cls from bef), d1 as (select enc, cls from aft),
s as (select d1.* from d1 join bef on bef.enc = d1.enc and bef.cls = d1.cls),
g as (select d1.* from d1 where not exists (select 1 from s where s.enc = d1.enc and s.cls = d1.cls) and exists (select 1 from bef where bef.enc = d1.enc and substr(bef.cls,1,1) = substr(d1.cls,1,1)))
select 'duplicate_substance' as reason, count(*) as n, count(distinct enc) as n_enc from s union all select 'duplicate_group', count(*), count(distinct enc) from g""")
def duplicate_substance(spark, sf):
    """A candidate that is taken already duplicates its substance; else its group may be."""
    s = v.sides(spark, sf)
    return ru.duplicate_reasons(rk.after(s), rk.before(s), 1, itself=False).groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("enc").alias("n_enc"))


@register("filter_state", f"""with {M}, c as (select enc, code, string_agg(distinct agent, '' order by agent) agents from men where kind = 'condition' and code is not null and state = 'affirmed' and subject = 'patient' group by 1, 2)
select enc, 'condition' as kind, code, agents from c union all select distinct enc, 'therapy', code, '' from men where kind = 'drug' and code is not null and state = 'affirmed'""")
def filter_state(spark, sf):
    """What the filter sees of a patient: conditions with their agents, and every affirmed coded drug."""
    return al.filter_state(mentions(spark, sf))
