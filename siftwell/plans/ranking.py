"""Queries of ranking and its evaluation, over the analogue views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import ranking as rk
from ..store import small
from . import views as v

QUERIES, ORACLES = {}, {}
K, ROUNDS = 5, 1000


def register(name, oracle=None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def order_of(kind, s, f, cands):
    """The order that a ranker gives all encounters of a fold, before anything of their own; folds times the class vocabulary."""
    if kind == "frequency":
        return small(rk.placed(rk.frequencies(s, f, cands)))
    return small(rk.placed(rk.base_rates(s, f, cands) if kind == "hybrid" else rk.constant(cands)))


def conditions_of(spark, sf, f):
    return v.conditions(spark, sf).join(f.select("enc"), "enc", "left_semi")


def ranked(kind, spark, sf, unit=3, k=K):
    """(sides, folds, the first k of each encounter's order without its current classes)."""
    s, f, cands = v.base(spark, sf, unit)
    now = rk.before(s)
    if kind == "random_hash":
        return s, f, rk.first_k_by_hash(cands, f, now, k)
    order, own = order_of(kind, s, f, cands), None
    if kind == "symbolic":
        own = rk.by_rules_of_fold(order, f, v.rules(spark), conditions_of(spark, sf, f), s)
    if kind == "hybrid":
        return s, f, rk.hybrid_first_k(order, v.rules(spark), conditions_of(spark, sf, f), s, f, k).drop("weight")
    return s, f, rk.first_k(order, f, now, k, own)


def proposal(s, r, k=K):
    return rk.before(s).union(r.where(F.col("rank") <= k).select("enc", "cls"))


HIER = """, lev(n) as (values {levels}), prop as (select enc, cls from bef union all select enc, cls from ranked where rnk <= 5),
p as (select distinct n, enc, substr(cls,1,n) c from prop, lev), t as (select distinct n, enc, substr(cls,1,n) c from aft, lev),
m as (select coalesce(p.n, t.n) n, coalesce(p.enc, t.enc) enc, count(p.c) np, count(t.c) nt, count(case when p.c is not null and t.c is not null then 1 end) nh from p full join t on p.n = t.n and p.enc = t.enc and p.c = t.c group by 1, 2),
per as (select n level, enc, case when np > 0 then nh::double / np else 0 end p, case when nt > 0 then nh::double / nt else 0 end r, case when np + nt > 0 then 2 * nh::double / (np + nt) else 0 end f from m)"""


def hier(kind, unit):
    levels = [n for n in ev.LEVELS if n <= unit]

    def query(spark, sf):
        s, _, r = ranked(kind, spark, sf, unit, K)
        return ev.macro(ev.hierarchical(proposal(s, r), rk.after(s), levels))

    sql = f"with {v.base_sql(unit)}, {v.scores_sql(kind)}, {v.ranked_sql()}" + HIER.format(levels=", ".join(f"({n})" for n in levels)) + " select level::int as level, round(avg(p), 6) as precision, round(avg(r), 6) as recall, round(avg(f), 6) as f1, count(*) as n_enc from per group by 1"
    return query, sql


for _kind in ("frequency", "continuity", "random_hash", "symbolic", "hybrid"):
    _q, _s = hier(_kind, 5 if _kind == "frequency" else 3)
    QUERIES[f"hier_f1_{_kind}"], ORACLES[f"hier_f1_{_kind}"] = _q, _s

_RANKED = f"with {v.base_sql(3)}, {v.scores_sql('frequency')}, {v.ranked_sql()}"


@register("topk_hit_by_level", _RANKED + """, lev(n) as (values (1), (3)), h as (select n, enc, max(cast(exists (select 1 from ranked r where r.enc = a.enc and r.rnk <= 5 and substr(r.cls,1,n) = substr(a.cls,1,n)) as int)) hit from adds a, lev group by 1, 2)
select n::int as level, round(avg(hit::double), 6) as hit_rate, count(*) as n_enc from h group by 1""")
def topk(spark, sf):
    s, _, r = ranked("frequency", spark, sf, k=5)
    return ev.top_k_hits(r, rk.added(s), K, (1, 3))


@register("recall_precision_at_k", _RANKED + """, ks(k) as (values (3), (5), (10)), n as (select enc, count(*) n from adds group by 1),
g as (select enc, n, k, (select count(*) from ranked r join adds a on a.enc = r.enc and a.cls = r.cls where r.enc = n.enc and r.rnk <= k) h from n, ks)
select k::int as k, round(avg(h::double / n), 6) as recall, round(avg(h::double / k), 6) as precision, count(*) as n_enc from g group by 1""")
def at_k(spark, sf):
    s, _, r = ranked("frequency", spark, sf, k=10)
    return ev.at_k(r, rk.added(s))


@register("map_additions", _RANKED + """, h as (select r.enc, row_number() over (partition by r.enc order by rnk)::double / rnk p from ranked r join adds a on a.enc = r.enc and a.cls = r.cls),
n as (select enc, count(*) n from adds group by 1), ap as (select n.enc, coalesce(sum(p), 0) / any_value(n.n) ap from n left join h on h.enc = n.enc group by 1)
select round(avg(ap), 6) as map, count(*) as n_enc from ap""")
def map_additions(spark, sf):
    s, f, cands = v.base(spark, sf)
    order, t = order_of("frequency", s, f, cands), rk.added(s)
    return ev.average_precision(rk.ranks_of(t, order, f, rk.before(s)), t).agg(F.round(F.avg("ap"), 6).alias("map"), F.count("*").alias("n_enc"))


@register("two_task_map", _RANKED + """, tasks as (select 'added' task, enc, cls from adds union all select 'kept', enc, cls from aft where (enc, cls) in (select (enc, cls) from bef)),
full_rank as (select *, row_number() over (partition by enc order by round(score, 9) desc, cls) rnk from scores), ok as (select task, t.enc, t.cls from tasks t join grid g on g.enc = t.enc and g.cls = t.cls),
h as (select task, r.enc, row_number() over (partition by task, r.enc order by rnk)::double / rnk p from full_rank r join ok a on a.enc = r.enc and a.cls = r.cls),
n as (select task, enc, count(*) n from ok group by 1, 2), ap as (select n.task, n.enc, coalesce(sum(p), 0) / any_value(n.n) ap from n left join h on h.enc = n.enc and h.task = n.task group by 1, 2)
select task, round(avg(ap), 6) as map, count(*) as n_enc from ap group by 1""")
def two_tasks(spark, sf):
    s, f, cands = v.base(spark, sf)
    order = order_of("frequency", s, f, cands)
    out = None
    for task, rows in (("added", rk.added(s)), ("kept", rk.after(s).join(rk.before(s), ["enc", "cls"], "left_semi"))):
        # targets among the candidates; nothing is left out, so a target's rank is its place in the fold's order
        ok = rows.join(f, "enc").join(order, ["fold", "cls"]).select("enc", "cls", F.col("place").alias("rank"))
        one = ev.average_precision(ok, ok).agg(F.round(F.avg("ap"), 6).alias("map"), F.count("*").alias("n_enc")).select(F.lit(task).alias("task"), "map", "n_enc")
        out = one if out is None else out.union(one)
    return out


@register("candidate_ceiling", f"with {v.base_sql(3)} select count(*) as n_added, count(g.cls) as n_reachable, round(count(g.cls)::double / count(*), 6) as ceiling from adds a left join grid g on g.enc = a.enc and g.cls = a.cls")
def ceiling(spark, sf):
    s, f, cands = v.base(spark, sf)
    got = rk.added(s).join(f, "enc").join(cands.withColumn("in", F.lit(1)), ["fold", "cls"], "left")
    return got.agg(F.count("*").alias("n_added"), F.count("in").alias("n_reachable"), F.round(F.count("in").cast("double") / F.count("*").cast("double"), 6).alias("ceiling"))


@register("kept_added_stopped", f"with {v.base_sql(3)}, a as (select enc, list(cls) filter (adm) b, list(cls) filter (not adm) d from sides group by 1) select cast(sum(len(list_intersect(coalesce(b, []), d))) as bigint) as kept, cast(sum(len(d) - len(list_intersect(coalesce(b, []), d))) as bigint) as added, cast(sum(len(coalesce(b, [])) - len(list_intersect(coalesce(b, []), d))) as bigint) as stopped, count(*) as n_enc from a")
def kept_added_stopped(spark, sf):
    a = v.sides(spark, sf).groupBy("enc").agg(F.collect_set(F.when(F.col("adm"), F.col("cls"))).alias("b"), F.collect_set(F.when(~F.col("adm"), F.col("cls"))).alias("d"))
    n = lambda x: F.sum(F.size(x)).cast("long")
    return a.agg(n(F.array_intersect("b", "d")).alias("kept"), n(F.array_except("d", "b")).alias("added"), n(F.array_except("b", "d")).alias("stopped"), F.count("*").alias("n_enc"))


@register("domain_share", f"with {v.base_sql(3)} select count(*) as n_added, count(*) filter (starts_with(cls, 'E') or starts_with(cls, 'P1')) as n_domain, round(count(*) filter (starts_with(cls, 'E') or starts_with(cls, 'P1'))::double / count(*), 6) as share from adds")
def domain_share(spark, sf):
    d = F.col("cls").startswith("E") | F.col("cls").startswith("P1")
    return rk.added(v.sides(spark, sf)).agg(F.count("*").alias("n_added"), F.count_if(d).alias("n_domain"), F.round(F.avg(d.cast("double")), 6).alias("share"))


@register("pmi_features", f"with {v.base_sql(3)}, {v.scores_sql('hybrid')} select fold::int as fold, feat, cls, round(pmi, 6) as pmi from pm")
def pmi(spark, sf):
    s, f, _ = v.base(spark, sf)
    return rk.pmi(conditions_of(spark, sf, f), s, f).select("fold", "feat", "cls", F.round("pmi", 6).alias("pmi"))


@register("hybrid_score_top5", f"with {v.base_sql(3)}, {v.scores_sql('hybrid')}, {v.ranked_sql()} select enc, cls, round(score, 6) as score, rnk::int as rank from ranked where rnk <= 5")
def hybrid_top(spark, sf):
    _, _, r = ranked("hybrid", spark, sf)
    return r.where("rank <= 5").select("enc", "cls", F.round("score", 6).alias("score"), "rank")


@register("replayed_answers", f"""with {v.base_sql(3)}, ans as (select enc, cls, row_number() over (partition by enc order by cls desc) pos from aft union all select enc, 'zzz', 0 from folds),
f as (select enc, upper(cls) cls, min(pos) pos from ans group by 1, 2), r as (select g.enc, g.cls, f.pos, row_number() over (partition by g.enc order by f.pos asc nulls last, g.cls) rnk from grid g left join f using (enc, cls))
select enc, cls, rnk::int as rank from r where rnk <= 3""")
def replay(spark, sf):
    s, f, cands = v.base(spark, sf)
    answer = F.concat(F.array(F.lit("zzz")), F.reverse(F.array_sort(F.collect_list(F.concat(F.lower("cls"), F.lit("9"))))))
    answers = rk.after(s).groupBy("enc").agg(answer.alias("answer"))
    return rk.replayed(answers, order_of("constant", s, f, cands), f, 3)


@register("fold_sizes", "select cast(('0x'||substr(sha256('20260915:'||cast(c_custkey as varchar)),1,8)) as bigint) % 5 as fold, count(*) as n from customer group by 1")
def fold_sizes(spark, sf):
    return v.table(spark, sf, "customer").groupBy(ev.hash_fold(F.col("c_custkey")).cast("long").alias("fold")).agg(F.count("*").alias("n"))


@register("stratified_fold_balance", f"with {v.base_sql(3)}, st as (select enc, case min(case when starts_with(cond,'MBU') then 0 when starts_with(cond,'MAU') then 1 when starts_with(cond,'N0') then 2 else 3 end) when 0 then 'MBU' when 1 then 'MAU' when 2 then 'N0' else 'other' end stratum from cond group by 1), f as (select *, (row_number() over (partition by stratum order by sha256('20260915:'||cast(enc as varchar)), enc) - 1) % 5 fold from st) select stratum, fold::int as fold, count(*) as n from f group by 1, 2")
def stratified(spark, sf):
    st = ev.first_stratum(v.conditions(spark, sf), "enc", "cond", ("MBU", "MAU", "N0"))
    return ev.stratified_folds(st, "enc", "stratum").groupBy("stratum", "fold").agg(F.count("*").alias("n"))


@register("hash_split", "select cast(('0x'||substr(sha256('20260915:'||cast(c_custkey as varchar)),1,8)) as bigint)::double / 4294967295 < 0.7 as train, count(*) as n from customer group by 1")
def hash_split(spark, sf):
    return v.table(spark, sf, "customer").groupBy(ev.hash_split(F.col("c_custkey"), 0.7).alias("train")).agg(F.count("*").alias("n"))


_BOOT = """, r as (select *, row_number() over (partition by level order by enc) - 1 i, count(*) over (partition by level) n from {src}),
d as (select level, k.round, cast(('0x'||substr(sha256('20260916:'||cast(k.round as varchar)||':'||cast(i as varchar)),1,8)) as bigint) % n i from r, (select unnest(range(1000)) round) k),
bm as (select d.level, d.round, avg(r.val) m from d join r on r.level = d.level and r.i = d.i group by 1, 2),
s as (select *, row_number() over (partition by level order by m) - 1 j, count(*) over (partition by level) n from bm)
select s.level::int as level, any_value(mean) as mean, round(max(m) filter (j = least(floor(n * 0.025), n - 1)), 6) as low, round(max(m) filter (j = least(floor(n * 0.975), n - 1)), 6) as high from s join (select level, round(avg(val), 6) mean from {src} group by 1) x on x.level = s.level group by s.level"""


@register("bootstrap_ci_hash", _RANKED + HIER.format(levels="(1), (3)") + ", src as (select level, enc, f val from per)" + _BOOT.format(src="src"))
def bootstrap(spark, sf):
    s, _, r = ranked("frequency", spark, sf, k=5)
    return ev.bootstrap(ev.hierarchical(proposal(s, r), rk.after(s), (1, 3)), ["level"], "f1", ROUNDS)


@register("paired_diff_ci", f"with {v.base_sql(3)}, {v.scores_sql('frequency')}, {v.ranked_sql()}" + HIER.format(levels="(1), (3)") + """, p2 as (select distinct n, enc, substr(cls,1,n) c from bef, lev),
m2 as (select coalesce(p.n, t.n) n, coalesce(p.enc, t.enc) enc, count(p.c) np, count(t.c) nt, count(case when p.c is not null and t.c is not null then 1 end) nh from p2 p full join t on p.n = t.n and p.enc = t.enc and p.c = t.c group by 1, 2),
src as (select level, per.enc, f - 2 * nh::double / (np + nt) val from per join m2 on m2.n = per.level and m2.enc = per.enc)""" + _BOOT.format(src="src"))
def paired(spark, sf):
    """Frequency's proposal against continuing the classes before, encounter by encounter."""
    s, _, r = ranked("frequency", spark, sf, k=5)
    a = ev.hierarchical(proposal(s, r), rk.after(s), (1, 3)).select("level", "enc", "f1")
    b = ev.hierarchical(rk.before(s), rk.after(s), (1, 3)).select("level", "enc", F.col("f1").alias("other"))
    return ev.bootstrap(a.join(b, ["level", "enc"]).withColumn("diff", F.col("f1") - F.col("other")), ["level"], "diff", ROUNDS)


@register("explainability", f"with {v.base_sql(3)}, {v.scores_sql('frequency')}, {v.ranked_sql()}, fired as (select distinct enc, rule_id from rules r join cond on kind = 'cond' and starts_with(cond, tr) union select distinct enc, rule_id from rules r join bef on kind = 'therapy' and starts_with(cls, tr)), x as (select r.enc, r.cls, exists (select 1 from fired join rules using (rule_id) where fired.enc = r.enc and starts_with(r.cls, target)) e, exists (select 1 from aft where aft.enc = r.enc and aft.cls = r.cls) h from ranked r where rnk <= 5) select count(*) as n, count(*) filter (e) as explained, round(avg(e::int), 6) as share, round(avg(h::int) filter (e), 6) as hits_explained, round(avg(h::int) filter (not e), 6) as hits_other from x")
def explainability(spark, sf):
    s, f, r = ranked("frequency", spark, sf, k=5)
    top = r.select("enc", "cls")
    scored = rk.by_rules(top, v.rules(spark), conditions_of(spark, sf, f), s)
    e = top.join(scored, ["enc", "cls"], "left").withColumn("e", F.coalesce(F.col("score") > 0, F.lit(False)))
    h = e.join(rk.after(s).withColumn("h", F.lit(1.0)), ["enc", "cls"], "left").withColumn("h", F.coalesce("h", F.lit(0.0)))
    return h.agg(F.count("*").alias("n"), F.count_if("e").alias("explained"), F.round(F.avg(F.col("e").cast("double")), 6).alias("share"), F.round(F.avg(F.when(F.col("e"), F.col("h"))), 6).alias("hits_explained"), F.round(F.avg(F.when(~F.col("e"), F.col("h"))), 6).alias("hits_other"))


@register("micro_recall_coarse", _RANKED + ", a as (select distinct enc, substr(cls,1,1) c from adds) select count(*) as n, round(avg(cast(exists (select 1 from ranked r where r.enc = a.enc and rnk <= 5 and substr(r.cls,1,1) = a.c) as int)), 6) as recall from a")
def micro_recall(spark, sf):
    s, _, r = ranked("frequency", spark, sf, k=5)
    a, b = ev.truncated(rk.added(s), "cls", (1,)), ev.truncated(r.where("rank <= 5"), "cls", (1,)).withColumn("h", F.lit(1.0))
    return a.join(b, ["level", "enc", "c"], "left").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("h", F.lit(0.0))), 6).alias("recall"))


@register("weight_sweep", f"with {v.base_sql(3)}, {v.scores_sql('hybrid')}, wts(w) as (values (cast(0 as double)), (0.25::double), (0.5::double), (1::double)), rs as (select w, s.enc, s.cls, row_number() over (partition by w, s.enc order by round(s.score + (w - 0.5) * sym.score, 9) desc, s.cls) rnk from scores s join sym on sym.enc = s.enc and sym.cls = s.cls, wts where (s.enc, s.cls) not in (select (enc, cls) from bef)), t as (select enc, count(*) n from adds group by 1) select w as weight, round(avg((select count(*) from rs join adds a on a.enc = rs.enc and a.cls = rs.cls where rs.w = wts.w and rs.enc = t.enc and rnk <= 5)::double / n), 6) as recall from t, wts group by 1")
def weight_sweep(spark, sf):
    """Recall at 5 of the hybrid for several rule weights; an encounter's row is scored once for all of them."""
    weights = (0.0, 0.25, 0.5, 1.0)
    s, f, cands = v.base(spark, sf)
    order, t = order_of("hybrid", s, f, cands), rk.added(s)
    top = rk.hybrid_first_k(order, v.rules(spark), conditions_of(spark, sf, f), s, f, K, weights)
    hits = top.join(t, ["enc", "cls"], "left_semi").groupBy("weight", "enc").agg(F.count("*").cast("double").alias("h"))
    n = t.groupBy("enc").agg(F.count("*").cast("double").alias("n")).withColumn("weight", F.explode(F.array(*[F.lit(w) for w in weights])))
    return n.join(hits, ["weight", "enc"], "left").groupBy("weight").agg(F.round(F.avg(F.coalesce("h", F.lit(0.0)) / F.col("n")), 6).alias("recall"))


@register("meeting_level", _RANKED + ", x as (select r.enc, r.cls, max(case when r.cls = a.cls then 2 when substr(r.cls,1,1) = substr(a.cls,1,1) then 1 else 0 end) l from ranked r join adds a using (enc) where rnk <= 5 group by 1, 2) select l::int as level, count(*) as n from x group by 1".replace("r join adds a using (enc)", "r join adds a on a.enc = r.enc"))
def meeting_level(spark, sf):
    """How deep a proposal meets an addition: levels shared with the nearest one."""
    s, _, r = ranked("frequency", spark, sf, k=5)
    levels = (1, 3)
    a = rk.added(s)
    top = r.where("rank <= 5").select("enc", "cls").join(a.select("enc").distinct(), "enc", "left_semi")
    out = top.withColumn("level", F.lit(0))
    for i, n in enumerate(levels, 1):
        hit = a.select("enc", F.substring("cls", 1, n).alias("c")).distinct().withColumn("hit", F.lit(i))
        out = out.withColumn("c", F.substring("cls", 1, n)).join(hit, ["enc", "c"], "left").select("enc", "cls", F.greatest("level", F.coalesce("hit", F.lit(0))).alias("level"))
    return out.groupBy("level").agg(F.count("*").alias("n"))
