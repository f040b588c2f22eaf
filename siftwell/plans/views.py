"""Analogue views over the driver's tables, and the same as SQL text for the oracles.

enc is a customer, a class is a prefix of a part's seven-character code, the classes ordered
before the cut-off date are those before, the later ones those after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import ranking as rk
from ..store import written

CUT = "1998-07-01"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def codes(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    code = F.concat(
        F.substring("p_type", 1, 1), F.lpad(F.regexp_extract("p_brand", "[0-9]+", 0), 2, "0"), F.upper(F.substring("p_name", 1, 1)),
        F.upper(F.substring(F.element_at(F.split("p_name", " "), 2), 1, 1)), F.lpad(F.col("p_size").cast("string"), 2, "0"),
    )
    return p.select("p_partkey", "p_name", "p_brand", "p_type", code.alias("code"))


def sides(spark, sf, unit: int = 3) -> DataFrame:
    """Distinct (enc, adm, cls) of customers with at least one later class."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("enc"), (F.col("o_orderdate") < F.lit(CUT).cast("timestamp")).alias("adm"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    c = codes(spark, sf).select("p_partkey", F.substring("code", 1, unit).alias("cls"))
    rx = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("l_partkey") == F.col("p_partkey")).select("enc", "adm", "cls").distinct()
    return rx.join(rx.where("not adm").select("enc").distinct(), "enc", "left_semi")


def conditions(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    m = c.select(F.col("c_custkey").alias("enc"), F.concat(F.lit("M"), F.substring("c_mktsegment", 1, 2)).alias("cond"))
    n = c.select(F.col("c_custkey").alias("enc"), F.concat(F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")).alias("cond"))
    return m.union(n)


def folds(s: DataFrame) -> DataFrame:
    return s.select("enc").distinct().withColumn("fold", ev.hash_fold(F.col("enc")))


# Indications over the analogue codes (id, target class prefix, weight, kind, trigger prefix).
RULES = [
    (1, "E", 1.0, "cond", "MBU"), (2, "P1", 0.6, "cond", "MAU"), (3, "S", 0.3, "cond", "N0"), (4, "L2", 1.0, "cond", "N1"), (5, "M0", 0.6, "cond", "MMA"),
    (6, "P11", 1.0, "cond", "MFU"), (7, "S2", 0.6, "therapy", "E1"), (8, "E0", 0.3, "therapy", "P"), (1, "E", 1.0, "cond", "MHO"),
]
# Contraindications (id, target, trigger, verdict, revoked by prefix or none, missing fact or none).
CONTRA = [
    (1, "E", "MBU", "forbidden", None, None), (2, "P1", "N0", "to_verify", None, None), (3, "S", "N1", "forbidden", "MAU", None),
    (4, "L", "MMA", "forbidden", None, "age"), (5, "M", "N2", "to_verify", None, None), (6, "S2", "MFU", "forbidden", None, None),
]


def rules(spark) -> DataFrame:
    return spark.createDataFrame(RULES, "rule_id int, target string, weight double, kind string, trigger string")


def contra(spark) -> DataFrame:
    return spark.createDataFrame(CONTRA, "rule_id int, target string, trigger string, verdict string, revoked string, missing string")


def base(spark, sf, unit: int = 3):
    """(sides, folds, candidates): sides as a written table, since every branch of a ranking plan reads it."""
    s = written(sides(spark, sf, unit), "sides")
    f = folds(s)
    return s, f, rk.candidates(s, f)


def _values(rows) -> str:
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"cast({v} as double)" if isinstance(v, float) else str(v)
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def base_sql(unit: int = 3) -> str:
    """CTEs code, sides, folds, cond, adds, rules, contra (no WITH)."""
    return f"""
code as (select p_partkey, p_name, p_brand, p_type, concat(substr(p_type,1,1), lpad(regexp_extract(p_brand,'[0-9]+',0),2,'0'), upper(substr(p_name,1,1)), upper(substr(split_part(p_name,' ',2),1,1)), lpad(cast(p_size as varchar),2,'0')) code from part),
rx as (select distinct o_custkey enc, o_orderdate < timestamp '{CUT}' adm, substr(code,1,{unit}) cls from lineitem join orders on l_orderkey = o_orderkey join code on l_partkey = p_partkey),
sides as (select * from rx where enc in (select enc from rx where not adm)),
folds as (select distinct enc, cast(('0x'||substr(sha256('20260915:'||cast(enc as varchar)),1,8)) as bigint) % 5 fold from sides),
cond as (select c_custkey enc, 'M'||substr(c_mktsegment,1,2) cond from customer union all select c_custkey, 'N'||lpad(cast(c_nationkey as varchar),2,'0') from customer),
bef as (select enc, cls from sides where adm), aft as (select enc, cls from sides where not adm),
adds as (select * from aft except select * from bef),
rules(rule_id, target, weight, kind, tr) as (values {_values(RULES)}),
contra(rule_id, target, tr, verdict, revoked, missing) as (values {_values(CONTRA)}),
cands as (select g.fold, cls from aft join folds f using (enc), (select distinct fold from folds) g where f.fold <> g.fold group by 1, 2 having count(*) >= 3),
grid as (select enc, fold, cls from folds join cands using (fold))"""


def scores_sql(kind: str) -> str:
    """CTE scores(enc, cls, score) of a ranker over grid."""
    freq = "freq as (select g.fold, cls, count(*) n from adds join folds f using (enc), (select distinct fold from folds) g where f.fold <> g.fold group by 1, 2)"
    fired = "fired as (select distinct enc, rule_id from rules r join cond on kind = 'cond' and starts_with(cond, tr) union select distinct enc, rule_id from rules r join bef on kind = 'therapy' and starts_with(cls, tr)), sym as (select g.enc, g.cls, coalesce(max(weight) + 0.01 * (count(weight) - 1), 0) score from grid g left join (select enc, target, weight from fired join (select distinct rule_id, target, weight from rules) using (rule_id)) h on h.enc = g.enc and starts_with(g.cls, h.target) group by 1, 2)"
    if kind == "continuity":
        return "scores as (select enc, cls, cast((enc, cls) in (select (enc, cls) from bef) as int)::double score from grid)"
    if kind == "frequency":
        return freq + ", scores as (select enc, cls, coalesce(n, 0)::double score from grid left join freq using (fold, cls))"
    if kind == "random_hash":
        return "scores as (select enc, cls, cast(('0x'||substr(sha256('20260915:'||cast(enc as varchar)||':'||cls),1,8)) as bigint)::double score from grid)"
    if kind == "symbolic":
        return fired + ", scores as (select enc, cls, score::double score from sym)"
    return freq + ", " + fired + """, feats as (select distinct enc, 'D:'||substr(cond,1,3) feat from cond where enc in (select enc from folds) union select enc, 'T:'||cls from bef),
fo as (select distinct fold from folds),
tot as (select g.fold, count(*) total from folds f, fo g where f.fold <> g.fold group by 1),
nf as (select g.fold, feat, count(*) nf from feats join folds f using (enc), fo g where f.fold <> g.fold group by 1, 2 having count(*) >= 5),
nb as (select g.fold, feat, cls, count(*) nb from feats join adds using (enc) join folds f using (enc), fo g where f.fold <> g.fold group by 1, 2, 3 having count(*) >= 3),
pm as (select fold, feat, cls, ln(nb::double * total::double / (nf::double * n::double)) pmi from nb join nf using (fold, feat) join freq using (fold, cls) join tot using (fold)),
best as (select enc, cls, max(pmi) pmi from feats join folds using (enc) join pm using (fold, feat) group by 1, 2),
scores as (select g.enc, g.cls, ln(coalesce(freq.n::double, 0.5) / total::double) + coalesce(pmi, 0) + 0.5 * sym.score score from grid g left join freq using (fold, cls) join tot using (fold) left join best on best.enc = g.enc and best.cls = g.cls join sym on sym.enc = g.enc and sym.cls = g.cls)"""


def ranked_sql() -> str:
    """CTE ranked(enc, cls, score, rnk) without current classes, from scores."""
    return "ranked as (select *, row_number() over (partition by enc order by round(score, 9) desc, cls) rnk from (select * from scores where (enc, cls) not in (select (enc, cls) from bef)))"
