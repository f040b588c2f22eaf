"""Queries of parsing, vocabularies, resolution and quality, over parts, documents and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluation as ev
from ..operators import parsing as pr
from ..operators import resolve as rs
from ..operators import search as se
from . import views as v

QUERIES, ORACLES = {}, {}


def register(name, oracle=None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


NAME = r"[^\s\d:,][^\d:,]*"
BAD = r"(?i)\b(mg|mcg|gr?|ml|ui|u|cp|cpr|cps|cpz|gtt|fl|bust|puff|ore|die|al|alle)\b"


def admissions(spark, sf):
    p = v.table(spark, sf, "part")
    n, s, m = F.col("p_name"), F.col("p_size").cast("string"), F.col("p_partkey") % 7
    item = (
        F.when(m == 0, F.concat(n, F.lit(": "), s, F.lit(" mg cp /die"))).when(m == 1, F.concat(s, F.lit(" mg di "), n, F.lit(" in 100 ml"))).when(m == 2, F.concat(n, F.lit(" "), s, F.lit(" mg")))
        .when(m == 3, F.concat(F.lit("Ossigeno, "), n)).when(m == 4, F.concat(n, F.lit(" 75 mg, "), n, F.lit(" 5 mg"))).when(m == 5, F.lit("Nessuna terapia")).otherwise(F.concat(n, F.lit(" cpr "), s, F.lit(" mg")))
    )
    # the item stands in a list with an empty item after it
    return p.select("p_partkey", F.concat(item, F.lit(" ; ;")).alias("text"))


@register("tiered_parse_counts", rf"""with i as (select p_partkey % 7 m, p_name n, p_size::varchar s from part),
t as (select n, case m when 0 then n || ': ' || s || ' mg cp /die' when 1 then s || ' mg di ' || n || ' in 100 ml' when 2 then n || ' ' || s || ' mg' when 3 then 'Ossigeno, ' || n when 4 then n || ' 75 mg, ' || n || ' 5 mg' when 5 then 'Nessuna terapia' else n || ' cpr ' || s || ' mg' end item from i),
u as (select *, regexp_extract(item, '^\s*[\d.,/]+\s*(?:mg|g|ml|mcg|UI|U)\s+di\s+([A-Za-z][A-Za-z\s\-]*?)\s*(?:\*|\s+in\s+\d|$)', 1) inf, case when contains(item, ':') then trim(split_part(item, ':', 1)) else '' end col, trim(regexp_replace(trim(regexp_extract(item, '^\s*([^\d:]+?)\s*\d', 1)), '(?i)\s+(cpr?|cps)\.?$', '')) dose from t),
w as (select case when regexp_matches(item, '(?i)^\s*nessuna\s+terapia\b') then 'none_declared' when regexp_matches(item, '(?i)^\s*ossigeno\b') then 'excluded_not_a_drug' when inf <> '' then '2_infusion'
 when col <> '' and not contains(col, ',') and not regexp_matches(col, '{BAD}') then '1_name_and_dosage' when dose <> '' and not contains(item, ',') and not regexp_matches(dose, '{BAD}') then '3_name_then_dose' else 'rejected' end tier, inf, col, dose from u)
select tier, case tier when '2_infusion' then inf when '1_name_and_dosage' then col when '3_name_then_dose' then dose end as name, count(*) as n from w group by 1, 2""")
def tiered(spark, sf):
    return pr.admission_items(admissions(spark, sf)).groupBy("tier", "name").agg(F.count("*").alias("n"))


def discharges(spark, sf):
    p = v.table(spark, sf, "part")
    n, b, s, m = F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string"), F.col("p_partkey") % 8
    q = lambda *x: F.concat(F.lit('"'), *[F.lit(y) if isinstance(y, str) else y for y in x], F.lit('"'))
    item = (
        F.when(m == 0, q(n, " (", b, " cpr): da assumere ", s, " pezzi")).when(m == 1, q(n, " (syn) (", b, "): ", s)).when(m == 2, q(n, ": da assumere ", s)).when(m == 3, q(n, " (", b, ")"))
        .when(m == 4, q(n, " (", b, " (estero) cpr.): ", s)).when(m == 5, q(n, " cps ", s, " pezzi")).when(m == 6, q("N.D. (", b, "): ", s)).otherwise(q(s, " ml ", n))
    )
    return p.select("p_partkey", F.concat(F.lit("x "), item, F.lit(" y")).alias("text"))


@register("quoted_items_tiers", r"""with i as (select p_partkey % 8 m, p_name n, p_brand b from part)
select case m when 0 then '1_full' when 1 then '2_with_synonym' when 2 then '3_no_brand' when 3 then '4_no_dosage' when 4 then '5_nested_brand' when 5 then '6_name_and_dose' when 6 then 'excluded_placeholder' else 'rejected' end as tier,
 case when m <= 5 then n end as principle, case when m in (0, 4) then b || case m when 0 then ' cpr' else ' (estero) cpr.' end when m in (1, 3) then b end as brand, count(*) as n from i group by 1, 2, 3""")
def quoted(spark, sf):
    return pr.discharge_items(discharges(spark, sf)).groupBy("tier", "principle", "brand").agg(F.count("*").alias("n"))


@register("questionnaire_echo_counts", "select 'obesita ' || lower(p_type) as term, case when p_size % 2 = 0 then 'si' else 'no' end as polarity, count(*) as n from part group by 1, 2")
def echo(spark, sf):
    t = F.concat(F.lit("Obesita "), F.lower("p_type"), F.when(F.col("p_size") % 2 == 0, " si").otherwise(" no"), F.lit(". Altro."))
    return pr.questionnaire_echo(v.table(spark, sf, "part").select("p_partkey", t.alias("text"))).groupBy("term", "polarity").agg(F.count("*").alias("n"))


@register("allergy_states", "select case p_size % 3 when 0 then 'section_absent' when 1 then 'none_declared' else 'present' end as state, count(*) as n, count(*) filter (p_size % 3 = 2) as n_values from part group by 1")
def allergy_states(spark, sf):
    m = F.col("p_size") % 3
    t = F.when(m == 0, "Anamnesi: nulla").when(m == 1, "Allergie e intolleranze: Allergie e intolleranze non note Anamnesi: x").otherwise(F.concat(F.lit("Allergie e intolleranze: Principi attivi ("), F.col("p_name"), F.lit(") Anamnesi: x")))
    s = pr.allergy_section(v.table(spark, sf, "part").select("p_partkey", t.alias("text")))
    return s.groupBy("state").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("categories"), F.lit(0)).cast("long")).alias("n_values"))


@register("brand_root", r"select case p_partkey % 3 when 0 then lower(p_name) when 1 then lower(p_name) else lower(p_name) || ' 1000' end as root, count(*) as n from part group by 1")
def brand_root(spark, sf):
    m = F.col("p_partkey") % 3
    t = F.when(m == 0, F.concat(F.initcap("p_name"), F.lit(" cpr. 25 mg"))).when(m == 1, F.concat(F.upper("p_name"), F.lit(" 2,5 mg/die"))).otherwise(F.concat("p_name", F.lit(" 1000")))
    return v.table(spark, sf, "part").groupBy(tx.brand_root(t).alias("root")).agg(F.count("*").alias("n"))


@register("normal_forms", r"select doc_id, md5(trim(regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9/ ]', ' ', 'g'), '\s+', ' ', 'g'))) as form from documents")
def normal_forms(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", F.md5(tx.normal_ascii(F.col("text"))).alias("form"))


FRAG = r"""f as (select doc_id, source, unnest(regexp_split_to_array(text, '[.;]\s+')) raw, unnest(range(len(regexp_split_to_array(text, '[.;]\s+')))) pos from documents),
g as (select doc_id, source, pos, form, lower(form) fragment from (select *, regexp_replace(trim(raw, ' '), '^[ .,;:-]+|[ .,;:-]+$', '', 'g') form from f) where length(form) > 3 and length(form) <= 45
  and not regexp_matches(form, '^(?i)(si ricovera|ricovero|si esegue|esegue|eseguit|effettuat|in data|viene |veniva |prosegue|riferisce|si segnala|come da|nella norma|paziente di|anamnesi|terapia|indicazione)') and not regexp_matches(form, '\d{2}[./]\d{2}|\d+\s*(mg|ml|mm|cm|%|mmhg|bpm)'))"""


@register("fragment_vocab", f"with {FRAG}, r as (select *, row_number() over (partition by fragment order by doc_id, pos, form) k from g), c as (select fragment, count(*) n, count(distinct doc_id) n_records, string_agg(form, '|' order by k) filter (k <= 3) contexts from r group by 1 having count(*) >= 3) select fragment, n, n_records, contexts, case when starts_with(fragment, 'no ') then 'no' else '' end as hints from c")
def fragment_vocab(spark, sf):
    """Forms of three uses or more, their first three contexts in order, and the hints they begin with."""
    f = pr.fragments(v.table(spark, sf, "documents").select("doc_id", "text"))
    return pr.vocabulary(f, "doc_id", "fragment", "form", place=("pos",)).withColumn("hints", pr.hints("fragment"))


@register("vocab_threshold", f"with {FRAG}, c as (select fragment, count(*) n from g group by 1) select n >= 3 as kept, count(*) as n_forms, cast(sum(n) as bigint) as n_uses, count(*) filter (regexp_matches(fragment, '^(no|not|non|sin|ohne) ')) as hints from c group by 1")
def vocab_threshold(spark, sf):
    c = pr.fragments(v.table(spark, sf, "documents").select("doc_id", "text")).groupBy("fragment").agg(F.count("*").alias("n"))
    return c.groupBy((F.col("n") >= 3).alias("kept")).agg(F.count("*").alias("n_forms"), F.sum("n").alias("n_uses"), F.count_if(F.col("fragment").rlike("^(no|not|non|sin|ohne) ")).alias("hints"))


@register("heading_census", r"with h as (select unnest(regexp_extract_all(text, '(?m)^([A-Z][a-z]{2,12}) ', 1)) heading from documents) select heading, count(*) as n from h group by 1")
def heading_census(spark, sf):
    return pr.headings(v.table(spark, sf, "documents"), pattern=r"(?m)^([A-Z][a-z]{2,12}) ")


@register("length_stats", "with t as (select source, length(text) l, row_number() over (partition by source order by length(text)) - 1 i, count(*) over (partition by source) n from documents) select source, min(l) as least, max(l) filter (i = least(floor(n * 0.5), n - 1)) as median, max(l) filter (i = least(floor(n * 0.95), n - 1)) as p95, max(l) as most, round(avg(l), 6) as mean, count(*) as n from t group by 1")
def length_stats(spark, sf):
    t = v.table(spark, sf, "documents").select("source", F.length("text").cast("long").alias("l"))
    q = ev.sorted_index(t, ["source"], "l", {"median": (0.5, 0), "p95": (0.95, 0)})
    return t.groupBy("source").agg(F.min("l").alias("least"), F.max("l").alias("most"), F.round(F.avg("l"), 6).alias("mean"), F.count("*").alias("n")).join(q, "source").select("source", "least", "median", "p95", "most", "mean", "n")


@register("brand_principle_bridge", "with c as (select p_name brand, p_type principle, count(*) n from part group by 1, 2), r as (select *, row_number() over (partition by brand order by n desc, principle) rn from c) select brand, max(principle) filter (rn = 1) as principle, max(n) filter (rn = 1) as n, coalesce(string_agg(principle, ',' order by principle) filter (rn > 1), '') as others from r group by 1")
def bridge(spark, sf):
    c = v.table(spark, sf, "part").groupBy(F.col("p_name").alias("brand"), F.col("p_type").alias("principle")).agg(F.count("*").alias("n"))
    r = c.withColumn("rn", F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("n"), "principle")))
    first = F.col("rn") == 1
    return r.groupBy("brand").agg(F.max(F.when(first, F.col("principle"))).alias("principle"), F.max(F.when(first, F.col("n"))).alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(~first, F.col("principle")))), ",").alias("others"))


@register("drug_vocabulary", "select p_name as root, count(*) as n, count(distinct p_brand) as n_brands, count(*) filter (p_size < 25) as n_small, count(*) filter (p_size >= 25) as n_large, string_agg(distinct p_type, ',' order by p_type) as variants from part group by 1")
def drug_vocabulary(spark, sf):
    return v.table(spark, sf, "part").groupBy(tx.brand_root(F.col("p_name")).alias("root")).agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("n_brands"), F.count_if(F.col("p_size") < 25).alias("n_small"), F.count_if(F.col("p_size") >= 25).alias("n_large"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("variants"))


FORMS = """sub as (select distinct p_name form, 'S' || lpad((p_partkey % 40)::varchar, 2, '0') code from part where p_partkey % 37 = 0),
bra as (select distinct 'br ' || p_name form, 'B' || substr(p_brand, length(p_brand), 1) code from part where p_partkey % 41 = 0),
nam as (select distinct name from (select p_name name from part union all select p_name || ' sale' from part union all select 'br ' || split_part(p_name, ' ', 1) || ' ' || substr(split_part(p_name, ' ', 2), 1, 2) from part
 union all select split_part(p_name, ' ', 1) from part union all select 'Br ' || p_name from part union all select split_part(p_name, ' ', 1) || '/' || split_part(p_name, ' ', 2) from part)),
nf as (select name, lower(name) form from nam),
hit as (select name, code, 0 place from nf join sub using (form)
 union select name, code, 2 from nf join bra using (form)
 union select name, code, 3 from nf join bra b on split_part(nf.form, ' ', 1) = split_part(b.form, ' ', 1) and contains(nf.form, ' ') and len(string_split(b.form, ' ')) >= len(string_split(nf.form, ' ')) and starts_with(split_part(b.form, ' ', 2), split_part(nf.form, ' ', 2)) and starts_with(split_part(b.form, ' ', 3), split_part(nf.form, ' ', 3))
 union select name, code, 4 from nf join sub on contains(nf.form, ' ') and sub.form = regexp_replace(nf.form, ' [^ ]*$', '')
 union select name, code, 5 from nf join sub on starts_with(sub.form, nf.form || ' ')),
best as (select name, place, list_sort(list(distinct code)) codes from hit h where place = (select min(place) from hit x where x.name = h.name) group by 1, 2),
res as (select nam.name, case when len(codes) = 1 then 'resolved' when len(codes) > 1 then 'ambiguous' else 'nil' end status, case when len(codes) = 1 then codes[1] end code, coalesce(array_to_string(codes, ','), '') codes, ['exact_substance', 'association', 'brand', 'abbreviated_brand', 'salt_suffix', 'salt_form'][place + 1] as method from nam left join best using (name))"""


def cascade_inputs(spark, sf):
    p = v.table(spark, sf, "part")
    word = lambda i: F.element_at(F.split("p_name", " "), i)
    sub = p.where("p_partkey % 37 = 0").select(F.col("p_name").alias("form"), F.concat(F.lit("S"), F.lpad((F.col("p_partkey") % 40).cast("string"), 2, "0")).alias("code")).distinct()
    bra = p.where("p_partkey % 41 = 0").select(F.concat(F.lit("br "), "p_name").alias("form"), F.concat(F.lit("B"), F.substring("p_brand", -1, 1)).alias("code")).distinct()
    variants = F.array(F.col("p_name"), F.concat("p_name", F.lit(" sale")), F.concat(F.lit("br "), word(1), F.lit(" "), F.substring(word(2), 1, 2)), word(1), F.concat(F.lit("Br "), "p_name"), F.concat(word(1), F.lit("/"), word(2)))
    return p.select(F.explode(variants).alias("name")).distinct(), sub, bra


@register("cascade_resolution", f"with {FORMS} select * from res")
def cascade(spark, sf):
    names, sub, bra = cascade_inputs(spark, sf)
    return rs.drug_cascade(names, sub, bra)


@register("cascade_coverage", f"with {FORMS}, occ as (select name, (length(name) % 5 + 1)::bigint n from nam) select cast(sum(n) as bigint) as n, cast(sum(case when status = 'resolved' then n else 0 end) as bigint) as resolved, round(sum(case when status = 'resolved' then n else 0 end)::double / sum(n), 6) as share from occ join res using (name)")
def cascade_coverage(spark, sf):
    names, sub, bra = cascade_inputs(spark, sf)
    occ = names.distinct().withColumn("n", (F.length("name") % 5 + 1).cast("long"))
    return rs.coverage(rs.drug_cascade(names, sub, bra), occ)


@register("token_prefix_join", f"with {FORMS} select distinct name, code from hit where place = 3")
def token_prefix(spark, sf):
    names, _, bra = cascade_inputs(spark, sf)
    return rs.abbreviated(names.distinct().withColumn("form", tx.normal_ascii(F.col("name"))), bra)


@register("generalise_to_category", "with t as (select distinct p_name form, case when split_part(p_name, ' ', 1) in ('red', 'hot', 'new') then 'X1' else 'C' || substr(p_name, length(p_name), 1) end || '.' || (length(p_name) % 4)::varchar code from part), k as (select split_part(form, ' ', 1) as key, count(distinct form) n, count(distinct split_part(code, '.', 1)) cats, min(split_part(code, '.', 1)) code from t group by 1) select key as name, code from k where n >= 2 and cats = 1")
def generalise(spark, sf):
    p = v.table(spark, sf, "part")
    first = F.element_at(F.split("p_name", " "), 1)
    code = F.concat(F.when(first.isin("red", "hot", "new"), "X1").otherwise(F.concat(F.lit("C"), F.substring("p_name", -1, 1))), F.lit("."), (F.length("p_name") % 4).cast("string"))
    terms = p.select(F.col("p_name").alias("form"), code.alias("code")).distinct()
    return rs.generalised(p.select(first.alias("name"), first.alias("form")).distinct(), terms)


@register("condition_cascade", "with t as (select distinct p_name form, 'C' || substr(p_name, length(p_name), 1) || '.' || (p_partkey % 2)::varchar code from part where p_partkey % 3 = 0), n as (select distinct p_name name from part union select distinct split_part(p_name, ' ', 1) from part), e as (select name, list_sort(list(distinct code)) c, list_sort(list(distinct split_part(code, '.', 1))) k from n join t on t.form = n.name group by 1), g as (select split_part(form, ' ', 1) as name, count(distinct form) nn, list(distinct split_part(code, '.', 1)) k from t group by 1 having count(distinct form) >= 2 and count(distinct split_part(code, '.', 1)) = 1), r as (select n.name, case when e.name is not null then case when len(e.c) = 1 or len(e.k) > 1 then e.c else e.k end when g.name is not null then g.k end codes, case when e.name is not null then 'exact_term' when g.name is not null then 'generalised' end as method from n left join e using (name) left join g using (name)) select name, case when len(codes) = 1 then 'resolved' when len(codes) > 1 then 'ambiguous' else 'nil' end as status, case when len(codes) = 1 then codes[1] end as code, coalesce(array_to_string(codes, ','), '') as codes, method from r")
def condition_cascade(spark, sf):
    p = v.table(spark, sf, "part")
    terms = p.where("p_partkey % 3 = 0").select(F.col("p_name").alias("form"), F.concat(F.lit("C"), F.substring("p_name", -1, 1), F.lit("."), (F.col("p_partkey") % 2).cast("string")).alias("code")).distinct()
    names = p.select(F.explode(F.array(F.col("p_name"), F.element_at(F.split("p_name", " "), 1))).alias("name"))
    return rs.condition_cascade(names, terms)


TRI = """tn as (select distinct name from (select substr(p_name, 1, length(p_name) - 1) || 'x' as name from part) where length(name) >= 6), tt as (select distinct p_name term from part where length(p_name) >= 6),
ga as (select distinct name, substr(' ' || name || ' ', i::int, 3) gram from tn, range(1, 60) r(i) where i <= length(name)), gb as (select distinct term, substr(' ' || term || ' ', i::int, 3) gram from tt, range(1, 60) r(i) where i <= length(term)),
na as (select name, count(*) na from ga group by 1), nb as (select term, count(*) nb from gb group by 1),
sc as (select name, term, count(*)::double / (any_value(na) + any_value(nb) - count(*))::double score from ga join gb using (gram) join na using (name) join nb using (term) group by 1, 2),
tb as (select *, row_number() over (partition by name order by score desc, term) rn from sc where score >= 0.35)"""


@register("trigram_best_match", f"with {TRI} select name, term, round(score, 6) as score from tb where rn = 1")
def trigram(spark, sf):
    p = v.table(spark, sf, "part")
    names = p.select(F.expr("concat(substr(p_name, 1, length(p_name) - 1), 'x')").alias("name"))
    return rs.trigram_best(names, p.select(F.col("p_name").alias("term"))).select("name", "term", F.round("score", 6).alias("score"))


@register("linker", f"with {FORMS}, {TRI.replace('tn as (select distinct name from (select substr(p_name, 1, length(p_name) - 1) || %sx%s as name from part)' % (chr(39), chr(39)), 'tn as (select distinct name from (select name from res where status = %snil%s)' % (chr(39), chr(39)))} select name, case when term is not null then 'ambiguous' else status end as status, code, codes, coalesce('similar:' || printf('%.2f', score) || ':' || term, method) as method from res left join (select * from tb where rn = 1) using (name)")
def linker(spark, sf):
    names, sub, bra = cascade_inputs(spark, sf)
    return rs.linked(names, rs.drug_cascade(names, sub, bra), v.table(spark, sf, "part").select(F.col("p_name").alias("term")))


@register("composite_lookup", "with f as (select distinct p_name form, substr(p_name, 1, 2) code from part union select distinct lower(p_brand), 'B' || substr(p_brand, length(p_brand), 1) from part where p_size < 25), n as (select distinct p_name || ' (' || p_brand || '): ' || p_type as name, p_name a, lower(p_brand) b from part), h as (select name, code, case when form = a then 2 else 3 end place from n join f on form = a or form = b), g as (select name, count(distinct code) k, arg_min(code, place) code from h group by 1) select n.name, case when k = 1 then 'resolved' when k > 1 then 'ambiguous' else 'nil' end as status, case when k = 1 then code end as code from n left join g using (name)")
def composite(spark, sf):
    p = v.table(spark, sf, "part")
    forms = p.select(F.col("p_name").alias("form"), F.substring("p_name", 1, 2).alias("code")).union(p.where("p_size < 25").select(F.lower("p_brand"), F.concat(F.lit("B"), F.substring("p_brand", -1, 1)))).distinct()
    return rs.composite(p.select(F.concat("p_name", F.lit(" ("), "p_brand", F.lit("): "), "p_type").alias("name")), forms)


@register("bridge_verification", "with r as (select p_name brand, string_agg(distinct lower(p_type), ' ' order by lower(p_type)) subs from part where p_partkey % 97 = 0 group by 1), b as (select distinct p_name brand, p_type principle from part) select case when subs is null then 'absent' when length(regexp_replace(principle, '[^A-Za-z].*$', '')) >= 5 and contains(subs, lower(substr(principle, 1, 6))) then 'confirmed' else 'discordant' end as outcome, count(*) as n from b left join r using (brand) group by 1")
def bridge_check(spark, sf):
    p = v.table(spark, sf, "part")
    reg = p.where("p_partkey % 97 = 0").select(F.col("p_name").alias("brand"), F.col("p_type").alias("substance"))
    return rs.confirmed(p.select(F.col("p_name").alias("brand"), F.col("p_type").alias("principle")).distinct(), reg).groupBy("outcome").agg(F.count("*").alias("n"))


@register("parenthetical_expansion", "with t as (select distinct p_name a, p_brand b, p_type c from part) select a || ' (' || b || ') end (' || c || ')' as term, a || ' end|' || a || ' ' || b || ' end|' || a || ' end ' || c || '|' || a || ' ' || b || ' end ' || c as expansions from t")
def expansion(spark, sf):
    t = v.table(spark, sf, "part").select(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") end ("), "p_type", F.lit(")")).alias("term")).distinct()
    return t.select("term", F.array_join(tx.expand_parentheses(F.col("term")), "|").alias("expansions"))


@register("term_inverted_index", "select p_name as term, string_agg(distinct p_brand, ',' order by p_brand) as codes from part where length(p_name) >= 4 group by 1")
def term_index(spark, sf):
    return pr.term_index(v.table(spark, sf, "part").select(F.col("p_name").alias("term"), F.col("p_brand").alias("code"))).select("term", F.array_join("codes", ",").alias("codes"))


@register("anchor_quotes", "with q as (select doc_id, text, case when doc_id % 3 = 0 then lower(substr(text, 11, 12)) when doc_id % 3 = 1 then substr(text, 11, 12) else 'zzzzqq' end quote from documents) select doc_id, cast(case when instr(text, quote) > 0 then instr(text, quote) - 1 when instr(lower(text), lower(quote)) > 0 then instr(lower(text), lower(quote)) - 1 end as int) as start from q")
def anchor_quotes(spark, sf):
    d = v.table(spark, sf, "documents")
    m = F.col("doc_id") % 3
    quote = F.when(m == 0, F.lower(F.substring("text", 11, 12))).when(m == 1, F.substring("text", 11, 12)).otherwise("zzzzqq")
    return d.select("doc_id", tx.anchor(F.col("text"), quote).cast("int").alias("start"))


@register("code_search_tiers", f"with {v.base_sql(3)}, s as (select distinct code, p_name name, case when code = 'E1' or lower(p_name) = 'e1' then 0 when starts_with(code, 'E1') or starts_with(lower(p_name), 'e1') then 1 when contains(code, 'E1') or contains(lower(p_name), 'e1') then 2 end tier from code) select tier::int as tier, code, name from s where tier is not null order by tier, code, name limit 50")
def code_search(spark, sf):
    c = v.codes(spark, sf).select("code", F.col("p_name").alias("name")).distinct()
    return se.search(c, "E1", 50)


@register("substring_counts", "select source, cast(sum((length(lower(text)) - length(replace(lower(text), 'tion', ''))) / 4) as bigint) as n, count(*) filter (contains(lower(text), 'tion')) as docs from documents group by 1")
def substring_counts(spark, sf):
    low = F.lower("text")
    return v.table(spark, sf, "documents").groupBy("source").agg(F.sum(F.regexp_count(low, F.lit("tion")).cast("long")).alias("n"), F.count_if(F.contains(low, F.lit("tion"))).alias("docs"))


@register("proportion_error", "with p as (select source, avg((lang = 'en')::int::double) p, count(*) n from documents group by 1) select source, round(p, 6) as p, round(sqrt(p * (1 - p) / n), 6) as se, n from p")
def proportion(spark, sf):
    d = v.table(spark, sf, "documents").groupBy("source").agg(F.avg((F.col("lang") == "en").cast("double")).alias("p"), F.count("*").alias("n"))
    return d.select("source", F.round("p", 6).alias("p"), F.round(F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n")), 6).alias("se"), "n")


@register("phrase_match_ngrams", r"""with d as (select doc_id, string_split(lower(text), ' ') w from documents), t as (select doc_id, unnest(range(len(w))) pos, unnest(w) w1 from d),
n as (select *, lead(w1, 1) over o w2, lead(w1, 2) over o w3 from t window o as (partition by doc_id order by pos)),
p as (select distinct unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i : i + 2], ' '))) phrase from (select string_split(lower(text), ' ') w from benchmark)), q as (select phrase from p)
select phrase, count(*) as n, count(distinct doc_id) as n_docs from n join q on q.phrase = w1 || ' ' || w2 || ' ' || w3 group by 1""")
def phrases(spark, sf):
    d = v.table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    w = F.split(F.lower("text"), " ", -1)  # every phrase of three words of every passage
    grams = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.array_join(F.slice(w, i, 3), " ")))
    b = v.table(spark, sf, "benchmark").select(F.explode(grams).alias("phrase")).distinct()
    return se.phrase_matches(d, "doc_id", "text", b, 3).groupBy("phrase").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@register("tool_choice_score", "with f as (select conv_id, arg_min(role, turn) first_role, count(*) filter (role = 'assistant') n_a, bool_and(length(text) > 0) ok from conversations group by 1) select first_role, count(*) as n, count(*) filter (first_role = 'user' and n_a > 0) as right_tool, count(*) filter (ok) as intact from f group by 1")
def tool_choice(spark, sf):
    f = v.table(spark, sf, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"), F.count_if(F.col("role") == "assistant").alias("n_a"), F.min(F.length("text") > 0).alias("ok"))
    return f.groupBy("first_role").agg(F.count("*").alias("n"), F.count_if((F.col("first_role") == "user") & (F.col("n_a") > 0)).alias("right_tool"), F.count_if("ok").alias("intact"))


@register("quality_report", "with l as (select source, text, count(*) n from documents group by 1, 2) select source, cast(sum(n) as bigint) as n, cast(sum(n - 1) as bigint) as duplicates, count(*) filter (length(text) > 5000) as over_cap from l group by 1")
def quality(spark, sf):
    # grouped by a digest: the text itself is not shuffled
    d = v.table(spark, sf, "documents").select("source", F.sha2("text", 256).alias("h"), F.length("text").alias("len")).groupBy("source", "h", "len").agg(F.count("*").alias("n"))
    return d.groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("duplicates"), F.count_if(F.col("len") > 5000).alias("over_cap"))


@register("run_comparison", "with a as (select source, count(*)::double v from documents where doc_id % 2 = 0 group by 1), b as (select source, count(*)::double v from documents where doc_id % 2 = 1 group by 1) select coalesce(a.source, b.source) as metric, a.v as old, b.v as new, case when a.v is null then 'new' when b.v is null then 'gone' when b.v > a.v then 'better' when b.v < a.v then 'worse' else 'same' end as direction from a full join b on a.source = b.source")
def run_comparison(spark, sf):
    d = v.table(spark, sf, "documents")
    a, b = (d.where(F.col("doc_id") % 2 == i).groupBy(F.col("source").alias("metric")).agg(F.count("*").cast("double").alias(n)) for i, n in enumerate(("old", "new")))
    return se.compare_runs(a, b)


@register("engine_difference", "with a as (select distinct source, lang from documents where doc_id % 2 = 0), b as (select distinct source, lang from documents where doc_id % 3 = 0) select 'only_first' as side, count(*) as n from (select * from a except select * from b) union all select 'only_second', count(*) from (select * from b except select * from a)")
def engine_difference(spark, sf):
    d = v.table(spark, sf, "documents").select("doc_id", "source", "lang")
    a, b = d.where("doc_id % 2 = 0").drop("doc_id").distinct(), d.where("doc_id % 3 = 0").drop("doc_id").distinct()
    n = lambda x, s: x.agg(F.count("*").alias("n")).select(F.lit(s).alias("side"), "n")
    return n(a.subtract(b), "only_first").union(n(b.subtract(a), "only_second"))


@register("in_all_pipelines", "with m as (select doc_id, source from documents) select count(*) as n from (select source from m where doc_id % 3 in (0, 1, 2) group by 1 having count(distinct doc_id % 3) = 3)")
def in_all(spark, sf):
    m = v.table(spark, sf, "documents").select("source", (F.col("doc_id") % 3).alias("agent"))
    return m.groupBy("source").agg(F.countDistinct("agent").alias("k")).where("k = 3").agg(F.count("*").alias("n"))


@register("anti_remaining", "select count(*) as n, min(doc_id) as first_id from documents where doc_id not in (select doc_id from labels)")
def remaining(spark, sf):
    """Work left: documents without a stored result."""
    return v.table(spark, sf, "documents").join(v.table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@register("config_fingerprint", """select p_brand as name, sha256('{"brand":"' || p_brand || '","n":' || count(*)::varchar || '}') as fingerprint from part group by 1""")
def fingerprint(spark, sf):
    from ..sources.registers import fingerprint as fp

    g = v.table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return g.select(F.col("p_brand").alias("name"), fp(F.struct(F.col("p_brand").alias("brand"), "n")).alias("fingerprint"))


@register("fallback_labels", f"with {v.base_sql(3)}, l as (select code, min(p_name) name from code where p_partkey % 2 = 0 group by 1), c as (select substr(code,1,3) code, 'class ' || substr(code,1,3) as name from code group by 1), x as (select distinct code from code) select x.code, coalesce(l.name, c.name) as label from x left join l on l.code = x.code left join c on c.code = substr(x.code,1,3)")
def fallback(spark, sf):
    c = v.codes(spark, sf)
    own = c.where("p_partkey % 2 = 0").groupBy("code").agg(F.min("p_name").alias("label"))
    cats = c.select(F.substring("code", 1, 3).alias("code")).distinct().select("code", F.concat(F.lit("class "), "code").alias("label"))
    return se.labelled(c.select("code").distinct(), own, cats, 3)


@register("uncited_codes", f"with {v.base_sql(3)}, cited as (select target code from rules union select tr from rules union select target from contra union select tr from contra), known as (select distinct substr(cls,1,1) code from sides union select cls from sides union select cond from cond) select code from cited where code not in (select code from known)")
def uncited(spark, sf):
    r, c = v.rules(spark), v.contra(spark)
    cited = r.select(F.col("target").alias("code")).union(r.select("trigger")).union(c.select("target")).union(c.select("trigger")).distinct()
    s = v.sides(spark, sf)
    known = s.select(F.substring("cls", 1, 1).alias("code")).union(s.select("cls")).union(v.conditions(spark, sf).select("cond"))
    return cited.join(known.distinct(), "code", "left_anti")


@register("valid_codes", f"with {v.base_sql(3)} select regexp_matches(code, '^[A-Z]\\d{{2}}([A-Z]([A-Z](\\d{{2}})?)?)?$') as valid, count(*) as n from code group by 1")
def valid_codes(spark, sf):
    return v.codes(spark, sf).groupBy(F.col("code").rlike(tx.ATC_CODE).alias("valid")).agg(F.count("*").alias("n"))
