"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, langid, licenses, mixing, neardup, packing, rans, sharding, syncmers, toxicity
from .common import held_out

SHARD_BYTES = 8 << 20


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_additive_quantisation(spark, sf_dir):
    vectors = ann.valid(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), top=20)


def op2_weighted_fair_mix(spark, sf_dir):
    return mixing.weighted_fair_mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_extendible_shards(spark, sf_dir):
    return sharding.shard_table(_docs(spark, sf_dir), SHARD_BYTES)


def op4_minhash_neardup(spark, sf_dir):
    return neardup.near_duplicates(_docs(spark, sf_dir))


def op5_syncmer_fingerprints(spark, sf_dir):
    return syncmers.fingerprints_with_neighbours(_docs(spark, sf_dir))


def op6_byte_gru_langid(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), langid.train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_rans_token_files(spark, sf_dir):
    tokens = rans.tokenised(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    freq = rans.Table.scaled(rans.count_ids(tokens))
    return rans.read_back(rans.blocks(tokens, freq), freq)


def op8_license_scan(spark, sf_dir):
    return licenses.wrapped_scan(_docs(spark, sf_dir))


def op9_compression_toxicity(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_cost_balanced_packing(spark, sf_dir):
    return packing.packed(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (
    op1_additive_quantisation, op2_weighted_fair_mix, op3_extendible_shards, op4_minhash_neardup, op5_syncmer_fingerprints, op6_byte_gru_langid,
    op7_rans_token_files, op8_license_scan, op9_compression_toxicity, op10_cost_balanced_packing,
)}

_MIX = r"""
with d as (
  select row_number() over () rid, doc_id, source, coalesce('s:' || source, 'null') skey,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
    md5('mix:' || coalesce(doc_id::varchar, '') || ':' || coalesce(md5(text), '')) h
  from documents),
s as (
  select skey, any_value(source) source, sum(size)::bigint source_size from d group by skey),
w as (
  select *, case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end weight, source_size * 3 cap from s),
l as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap::double / weight::double, skey rows between unbounded preceding and 1 preceding), 0))::double
    / (sum(weight) over (order by cap::double / weight::double, skey rows between current row and unbounded following))::double lev from w),
m as (
  select max(lev) lev from l where cap::double >= lev * weight),
t as (
  select skey, source_size, least(cap::double, coalesce(m.lev * weight, cap::double)) target from w cross join m),
q as (
  select d.*, t.source_size, t.target, sum(size) over (partition by d.skey order by h rows unbounded preceding) upto from d join t using (skey)),
c as (
  select q.rid, q.skey, q.h, q.size, k, ((k * source_size + upto)::double / target) fin
  from q, (values (0), (1), (2)) copies(k) where size > 0 and target > 0),
g as (
  select rid, sum(size) over (order by fin, skey, h, k rows unbounded preceding) acc from c),
n as (
  select rid, count(*) copies from g where acc <= (select sum(size) from d) group by rid)
select doc_id, size, source_size, target, coalesce(copies, 0)::bigint * size taken from q left join n using (rid)
"""

_SHARD = f"""
with r as (
  select row_number() over () rid, doc_id, coalesce(octet_length(encode(text)), 0)::bigint n_bytes,
    ('0x' || substr(md5('shard:' || coalesce(doc_id::varchar, '') || ':' || coalesce(md5(text), '')), 1, 15))::bigint a from documents),
p as (select rid, doc_id, n_bytes, d, a // (2 ** (60 - d))::bigint pre from r, range(0, 61) t(d)),
n as (select d, pre, sum(n_bytes)::bigint shard_bytes, count(*)::bigint shard_docs from p group by 1, 2 having sum(n_bytes) <= {SHARD_BYTES} or count(*) = 1),
e as (select rid, any_value(doc_id) doc_id, any_value(n_bytes) n_bytes, min({{'d': d, 'pre': pre, 'b': shard_bytes, 'n': shard_docs}}) x from p join n using (d, pre) group by rid)
select doc_id, n_bytes, lpad(x.d::varchar, 3, '0') || '-' || printf('%X', x.pre) shard_id, x.d::int depth, x.b shard_bytes, x.n shard_docs, x.b > {SHARD_BYTES} oversize from e
"""

_NEAR = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
s as (
  select distinct doc_id, case when len(ws) < 5 then array_to_string(ws, ' ') else array_to_string(ws[i : i + 4], ' ') end sh
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) i from w where len(ws) > 0)),
z as (select doc_id, count(*) n from s group by 1),
k as (select sh from s group by 1 having count(*) > 1),
v as (select s.* from s join k using (sh)),
e as (
  select x.doc_id a, y.doc_id b from v x join v y on x.sh = y.sh and x.doc_id <> y.doc_id group by 1, 2
  having 100 * count(*) >= 85 * ((select n from z where z.doc_id = x.doc_id) + (select n from z where z.doc_id = y.doc_id) - count(*))),
reach as (select a, b from e union select reach.a, e.b from reach join e on reach.b = e.a),
c as (select a doc_id, min(b) m from reach group by 1)
select w.doc_id, coalesce(z.n, 0)::bigint n_shingles, least(w.doc_id, coalesce(c.m, w.doc_id)) component_id, w.doc_id = least(w.doc_id, coalesce(c.m, w.doc_id)) kept
from w left join z using (doc_id) left join c using (doc_id)
"""


def _license_sql() -> str:
    known = ", ".join(f"('{s}', '{i}')" for s, i in licenses.SENTENCES.items())
    families = list(dict.fromkeys(f for f, _, _ in licenses.RULES))
    cases = ", ".join("case " + " ".join(f"when regexp_matches(sequence, '{licenses.rule_pattern(ids)}') then '{name}'" for g, name, ids in licenses.RULES if g == fam) + " end" for fam in families)
    return rf"""
with k(sentence, sid) as (values {known}),
d as (select row_number() over () rid, doc_id, regexp_split_to_array(text, '[.!?]+[ \t\n\f\r]+|[\n\r]+') cut from documents),
u as (select rid, unnest(range(1, len(cut) + 1)) pos, unnest(cut) s from d),
h as (select rid, pos, sid from u join k on k.sentence = trim(lower(regexp_replace(s, '[^A-Za-z0-9]+', ' ', 'g')))),
g as (select rid, count(*)::bigint n_sentences, string_agg('|' || sid || '|', '' order by pos) sequence from h group by rid),
f as (select doc_id, coalesce(n_sentences, 0) n_sentences, coalesce(sequence, '') sequence from d left join g using (rid))
select doc_id, n_sentences, sequence, array_to_string(list_sort(list_filter([{cases}], lambda x: x is not null)), ',') licenses from f
"""


ORACLES = {"op2_weighted_fair_mix": _MIX, "op3_extendible_shards": _SHARD, "op4_minhash_neardup": _NEAR, "op8_license_scan": _license_sql()}
