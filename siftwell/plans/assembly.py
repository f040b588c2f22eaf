"""Queries of record assembly, dictionaries, vocabularies, gold spans, cases and splits, on synthetic records made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import api
from ..functions import text as tx
from ..operators import assembly as asm
from ..operators import graph as gr
from ..operators import intervals as iv
from ..operators import parsing as pr
from ..operators import search as se
from ..operators import scopes as sc
from ..sources import records as rec
from ..sources import registers
from ..store import shared_dir
from . import alignment as ap
from . import views as v

QUERIES, ORACLES = {}, {}


def register(name, oracle=None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


def part(spark, sf):
    return v.table(spark, sf, "part")


def of(cases, key="p_partkey"):
    """A column that takes the case of key modulo the number of cases."""
    out = F.lit(None).cast("string")
    for i, c in reversed(list(enumerate(cases))):
        out = F.when(F.col(key) % len(cases) == i, c).otherwise(out)
    return out


@register("unicode_forms", "select p_partkey, p_name || '), città ' || lower(p_brand) as form, p_name || ' città ' || lower(replace(p_brand, '#', ' ')) as words, p_partkey % 2 = 0 as faithful from part")
def unicode_forms(spark, sf):
    t = F.concat(F.lit("  ("), "p_name", F.lit("),  Città "), "p_brand", F.lit("... "))
    said = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" CITTÀ"))).otherwise(F.lit("altro testo"))
    return part(spark, sf).select("p_partkey", tx.normal_unicode(t).alias("form"), tx.normal_words(t).alias("words"), tx.faithful(said, t).alias("faithful"))


@register("term_forms", """with t as (select p_partkey % 6 m, p_name n from part)
select case m when 0 then 'altro ' || n || ', non specificata' when 2 then 'dolore' when 3 then '077 ' || n when 4 then n || ' di altro tipo' else n end as term,
 m in (1, 4, 5) as admissible, case m when 0 then 'altro ' || n || '|' || n when 4 then n else '' end as variants, count(*) as n from (select m, n from t) group by 1, 2, 3""".replace("when 0 then 'altro ' || n || '|' || n", "when 0 then n"))
def term_forms(spark, sf):
    """Cleaned terms, whether a dictionary takes them, and their forms without residual qualifiers."""
    n = F.col("p_name")
    raw = of([F.concat(F.lit("altro "), n, F.lit(", non specificata")), F.concat(n, F.lit(" (I27.2)")), F.lit("dolore"), F.concat(F.lit("077 "), n), F.concat(n, F.lit("† di altro tipo")), n])
    t = part(spark, sf).select(tx.clean_term(raw).alias("term"))
    return t.groupBy("term", tx.admissible_term(F.col("term")).alias("admissible"), F.array_join(tx.derived_variants(F.col("term")), "|").alias("variants")).agg(F.count("*").alias("n"))


@register("dictionary_forms", """with t as (select case p_partkey % 3 when 0 then p_name when 1 then 'altro ' || p_name else split_part(p_name, ' ', 1) end term, p_brand code from part),
x as (select term form, code from t where not starts_with(term, 'altro ') union all select substr(term, 7), code from t where starts_with(term, 'altro ')),
k as (select distinct split_part(p_name, ' ', 1) w from part where p_size < 10)
select form, string_agg(distinct code, ',' order by code) as codes from x where length(form) >= 5 and (contains(form, ' ') or form in (select w from k)) group by 1""")
def dictionary_forms(spark, sf):
    n, first = F.col("p_name"), F.element_at(F.split("p_name", " "), 1)
    terms = part(spark, sf).select(of([n, F.concat(F.lit("altro "), n), first]).alias("term"), F.col("p_brand").alias("code"))
    titles = part(spark, sf).where("p_size < 10").select(F.initcap(first).alias("title"))
    return tx.dictionary_forms(terms, titles)


@register("drug_forms", "select form, coalesce(string_agg(distinct code, ',' order by code), '') as codes from (select lower(p_name) form, case p_partkey % 4 when 0 then p_brand when 1 then 'x' end code from part where p_partkey % 4 <> 3 union all select lower(p_name), 'y' from part where p_partkey % 4 = 1) group by 1")
def drug_forms(spark, sf):
    n = F.col("p_name")
    rows = part(spark, sf).select(of([F.concat(F.lit(" "), F.initcap(n)), n, n, F.lit("5 mg cpr.")], "p_partkey").alias("form"), of([F.col("p_brand"), F.lit(None), F.lit(None), F.col("p_brand")]).alias("code"), F.when(F.col("p_partkey") % 4 == 1, F.array(F.lit("y"), F.lit("x"))).alias("candidates"))
    return tx.drug_forms(rows)


def raw_pages(spark, sf):
    p = v.table(spark, sf, "pages")
    m = F.col("page_id") % 7
    enc = F.when(F.col("page_id") % 10 == 0, F.col("page_id") - 1).otherwise(F.col("page_id")).cast("string")
    sec = lambda t, x: F.concat(F.lit('{"tipo":"' + t + '","data":"d","reportOid":1,"testo":'), x, F.lit("}"))
    a = sec("Anamnesi", F.when(m == 2, "5").when(m == 3, '"  "').otherwise(F.concat(F.lit('"prose '), F.col("page_id").cast("string"), F.lit('"'))))
    b = F.when(m == 4, F.lit("")).otherwise(F.concat(F.lit(","), sec("Terapia medica all'ingresso", F.lit('"x: 1"'))))
    c = F.when(m == 1, F.concat(F.lit(","), sec("Altro", F.lit('"y"')))).otherwise(F.lit(""))
    return p.select(F.col("page_id").alias("place"), F.concat(F.lit('{"encOid":'), enc, F.lit(',"referti":['), a, b, c, F.lit("]}")).alias("body"))


@register("record_sections", """with d as (select case when page_id % 10 = 0 then page_id - 1 else page_id end enc, page_id from pages), f as (select enc, min(page_id) id from d group by 1)
select enc::bigint as enc_oid, 'Anamnesi' as tipo, 'prose ' || id as testo from f where id % 7 not in (2, 3) union all select enc::bigint, 'Terapia medica all''ingresso', 'x: 1' from f where id % 7 <> 4""")
def record_sections(spark, sf):
    """Sections of the first record of each id; texts that are no strings or blank do not count."""
    return rec.records(raw_pages(spark, sf)).select("enc_oid", "tipo", "testo")


@register("registry_index", f"with {v.base_sql(3)}, c as (select distinct lower(p_name) name, code from code) select name, string_agg(code, ',' order by code) as codes from c group by 1")
def registry_index(spark, sf):
    """A semicolon CSV is written, read again, and indexed by lower-cased name; codes of seven characters only."""
    path = f"{shared_dir(spark)}/siftwell/registry-{spark.sparkContext.applicationId}-{abs(hash(sf))}"
    c = v.codes(spark, sf)
    rows = c.select("code", F.upper("p_name").alias("nome")).union(c.where("p_partkey % 5 = 0").select(F.substring("code", 1, 5), F.upper("p_name")))
    rows.write.mode("overwrite").option("header", True).option("sep", ";").csv(path)
    return rec.registry(spark, path, "code", "nome", 7).select("name", F.array_join("codes", ",").alias("codes"))


@register("turtle_rules", f"with r(rule_id, target, weight, kind, tr) as (values {v._values(v.RULES)}) select 'k:r' || lpad((row_number() over ())::varchar, 4, '0') as rule, target, tr as \"trigger\", kind, weight::varchar as weight from r".replace("weight::varchar", "printf('%.1f', weight)"))
def turtle_rules(spark, sf):
    """Rules written as Turtle, read back as triples, and turned into rows ordered by subject."""
    text = rec.write_turtle([(t, x, k, w) for _, t, w, k, x in v.RULES], "k", ("target", "trigger", "kind", "weight"))
    rows = rec.rules_from_triples(spark.createDataFrame(rec.read_turtle(text), "s string, p string, o string"))
    one = lambda n: F.col("facts")[f"k:{n}"][0].alias(n)
    return rows.select(F.col("s").alias("rule"), one("target"), one("trigger"), one("kind"), one("weight"))


@register("state_files", f"with {ap.M} select agent, kind, count(*) as n, count(code) as coded, cast(sum(\"end\" - \"start\") as bigint) as width from men where agent = 'B' and id % 4 <> 0 group by 1, 2")
def state_files(spark, sf):
    """States as JSON in a folder, read without service files, flattened; mentions without a place go."""
    m = ap.mentions(spark, sf).where("agent = 'B'").withColumn("start", F.when(F.col("id") % 4 != 0, F.col("start")))
    item = F.struct("id", "start", "end", "code", "state", "subject")
    pick = lambda k: F.collect_list(F.when(F.col("kind") == k, item))
    folder = f"{shared_dir(spark)}/siftwell/states-{spark.sparkContext.applicationId}-{abs(hash(sf))}"
    made = m.groupBy("enc").agg(pick("condition").alias("conditions"), pick("drug").alias("drugs"))
    rec.write_json(made, folder)
    flat = rec.flattened(rec.states(spark, folder, "B", made.schema, whole_files=False))
    return flat.groupBy("agent", "kind").agg(F.count("*").alias("n"), F.count("code").alias("coded"), F.sum(F.col("end") - F.col("start")).alias("width"))


@register("gold_occurrences", """with p as (select p_partkey k, p_name n, length(p_name) l from part)
select k as enc, 0 as "start", l as "end", null as problem from p where k % 4 in (0, 1) union all select k, 2 * l + 7, 3 * l + 7, null from p where k % 4 in (0, 2) union all select k, null, null, 'too few occurrences' from p where k % 4 = 3""".replace("null as problem", "null::varchar as problem"))
def gold_occurrences(spark, sf):
    """A string that stands alone twice and inside a word once: all word-bounded occurrences, the first, the second, the ninth."""
    n = F.col("p_name")
    p = part(spark, sf).select(F.col("p_partkey").alias("enc"), F.concat(n, F.lit(" x "), n, F.lit("y - "), n, F.lit(".")).alias("text"), n.alias("quote"))
    nth = F.when(F.col("enc") % 4 == 1, 1).when(F.col("enc") % 4 == 2, 2).when(F.col("enc") % 4 == 3, 9)
    a = p.select("enc", F.lit("condition").alias("kind"), F.col("quote").alias("text"), F.lit("affirmed").alias("state"), F.lit("patient").alias("subject"), nth.alias("nth"))
    return asm.gold_spans(a, p.select("enc", "text")).select("enc", "start", "end", "problem")


@register("replayed_responses", "select case when n % 3 = 0 then 'no response' when n % 3 = 1 then 'unreadable' else 'answered' end as outcome, count(*) as n, cast(sum(case when n % 3 = 2 then n else 0 end) as bigint) as total from (select p_brand, count(*) n from part group by 1) group by 1")
def replayed_responses(spark, sf):
    """Requests answered from a cache by their fingerprint; what is missing or unreadable is told apart."""
    g = part(spark, sf).groupBy("p_brand").agg(F.count("*").alias("n"))
    cache = g.where("n % 3 != 0").select(registers.fingerprint(F.struct("p_brand")).alias("fingerprint"), F.lit("m").alias("model"), F.when(F.col("n") % 3 == 1, "no json").otherwise(F.concat(F.lit('{"a": '), F.col("n").cast("string"), F.lit("}"))).alias("response"))
    ok, errors = registers.replay(g.select("p_brand"), cache, "a int")
    return ok.agg(F.lit("answered").alias("outcome"), F.count("*").alias("n"), F.coalesce(F.sum("parsed.a"), F.lit(0)).cast("long").alias("total")).union(errors.groupBy(F.col("error").alias("outcome")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("total")))


@register("budget_log", "with c as (select s_suppkey, abs(s_acctbal) cost, sum(abs(s_acctbal)) over (order by s_suppkey) spent from supplier) select s_suppkey, round(spent, 2) as spent from c where spent <= 100000")
def budget_log(spark, sf):
    c = v.table(spark, sf, "supplier").select("s_suppkey", F.abs("s_acctbal").alias("cost"))
    return registers.within_budget(c, "s_suppkey", "cost", 100_000.0).select("s_suppkey", F.round("spent", 2).alias("spent"))


@register("allergy_rows", "select p_partkey, 'principi attivi' as kind, p_name as allergen, case when p_size < 25 then p_brand end as code from part union all select p_partkey, 'principi attivi', 'Beta', null from part union all select p_partkey, 'alimenti', 'uova', null from part")
def allergy_rows(spark, sf):
    p = part(spark, sf)
    t = p.select("p_partkey", F.concat(F.lit("Allergie e intolleranze: Principi attivi ("), "p_name", F.lit(", Beta) Alimenti (uova) Anamnesi: x")).alias("text"))
    known = p.where("p_size < 25").select(F.col("p_name").alias("form"), F.col("p_brand").alias("code"), "p_partkey")
    out = pr.allergy_values(t, known.groupBy("form").agg(F.min("code").alias("code")))
    own = p.where("p_size < 25").select("p_partkey", F.col("p_name").alias("allergen"), F.col("p_brand").alias("own"))
    # names repeat among parts: each row shows its own part's code
    return out.join(own, ["p_partkey", "allergen"], "left").select("p_partkey", "kind", "allergen", F.when(F.col("code").isNotNull() & F.col("own").isNotNull(), F.col("own")).alias("code"))


# Three synthetic records (history, admission, discharge), dealt to customers in turn, and small dictionaries.
RECORDS = (
    ("Nega diabete. Scompenso cardiaco noto. Fibrillazione atriale parossistica.", "Lasix: 25 mg ; altro, ignoto 3 ;", '"Bisoprololo (Congescor cpr. 2,5 mg): da assumere 1 cp"'),
    ("Familiarità per diabete (padre). Ipertensione in terapia. Allergie e intolleranze: Principi attivi (Bisoprololo, Zeta) Anamnesi: x", "Nessuna terapia", ""),
    ("Sospetto scompenso cardiaco.", "Congescor: 2,5 mg ; Congescor: 1,25 mg ;", ""),
)
CONDITIONS = (("diabete", "E11"), ("scompenso cardiaco", "I50.9"), ("fibrillazione atriale", "I48"), ("ipertensione", "I10"))
DRUGS = (("lasix", "C03CA01"), ("congescor", "C07AB07"), ("bisoprololo", "C07AB07"))
CLASSES = ("B01AF", "C03CA", "C07AB", "C08DA", "C09AA", "N02BE")


def synthetic(spark, sf):
    """(sections, conditions, drugs) of one record per customer."""
    c = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("enc_oid"))
    texts = spark.createDataFrame([(i, j, rec.TYPES[j], t) for i, r in enumerate(RECORDS) for j, t in enumerate(r) if t], "m long, pos int, tipo string, testo string")
    s = c.withColumn("m", F.col("enc_oid") % len(RECORDS)).join(F.broadcast(texts), "m")
    sections = s.select("enc_oid", "pos", "tipo", F.lit(None).cast("string").alias("data"), F.col("enc_oid").alias("report_oid"), "testo")
    return sections, spark.createDataFrame(list(CONDITIONS), "form string, code string"), spark.createDataFrame(list(DRUGS), "form string, code string")


_MENTIONS = "with x(m, field, kind, s, e, code, state, subject) as (values (0,'history','condition',5,12,'E11','negated','patient'), (0,'history','condition',14,32,'I50.9','affirmed','patient'), (0,'history','condition',39,60,'I48','affirmed','patient'), (0,'admission','drug',0,5,'C03CA01','affirmed','patient'), (0,'discharge','drug',1,12,'C07AB07','affirmed','patient'), (1,'history','condition',16,23,'E11','affirmed','family'), (1,'history','condition',33,45,'I10','affirmed','patient'), (1,'history','drug',100,111,'C07AB07','affirmed','patient'), (2,'history','condition',9,27,'I50.9','uncertain','patient'), (2,'admission','drug',0,9,'C07AB07','affirmed','patient'), (2,'admission','drug',0,9,'C07AB07','affirmed','patient'))"


@register("record_mentions", _MENTIONS + ' select c_custkey as enc, field, kind, s as "start", e as "end", code, state, subject from customer join x on m = c_custkey % 3')
def record_mentions(spark, sf):
    """Dictionary mentions with state and subject, and drugs of both therapy fields with the characters they stand at."""
    sections, cond, drugs = synthetic(spark, sf)
    return api.mentions_of(sections, cond, drugs).select("enc", "field", "kind", "start", "end", "code", "state", "subject")


@register("text_to_proposals", """with x(m, rank, cls, score, verdict, reasons, grounding, strength, missing, lacking) as (values
 (0, 1, 'C07AB', 1.01, 'allowed', '', 'cited indication', 'I', null, null), (0, 2, 'B01AF', 1.0, 'allowed', '', 'cited indication', 'I', 'stroke risk score: age and sex', null),
 (0, 3, 'C09AA', 1.0, 'allowed', '', 'cited indication', 'I', 'ejection fraction', null), (0, 4, 'N02BE', 0.0, 'allowed', '', 'measured co-occurrence', null, null, null),
 (1, 1, 'C09AA', 1.0, 'allowed', '', 'cited indication', 'I', null, 'allergy without a code: Zeta;no drug read from the therapy'), (1, 2, 'C07AB', 0.6, 'to_verify', 'allergy_group', 'cited indication', 'IIa', null, 'allergy without a code: Zeta;no drug read from the therapy'),
 (1, 3, 'B01AF', 0.0, 'allowed', '', 'measured co-occurrence', null, null, 'allergy without a code: Zeta;no drug read from the therapy'), (1, 4, 'C03CA', 0.0, 'allowed', '', 'measured co-occurrence', null, null, 'allergy without a code: Zeta;no drug read from the therapy'),
 (2, 1, 'B01AF', 0.0, 'allowed', '', 'measured co-occurrence', null, null, 'no coded condition'), (2, 2, 'C03CA', 0.0, 'allowed', '', 'measured co-occurrence', null, null, 'no coded condition'),
 (2, 3, 'C08DA', 0.0, 'allowed', '', 'measured co-occurrence', null, null, 'no coded condition'), (2, 4, 'C09AA', 0.0, 'allowed', '', 'measured co-occurrence', null, null, 'no coded condition'))
select c_custkey as enc, cls, rank::int as rank, score::double as score, verdict, reasons, grounding, strength, missing, lacking from customer join x on m = c_custkey % 3""")
def text_to_proposals(spark, sf):
    """From the texts of each record to its ranked proposals, their verdicts and grounds, and what the record lacks."""
    sections, cond, drugs = synthetic(spark, sf)
    cands = spark.createDataFrame([(c,) for c in CLASSES], "cls string")
    return api.text_to_proposals(spark, sections, cond, drugs, cands, 4).select("enc", "cls", "rank", F.round("score", 6).alias("score"), "verdict", "reasons", "grounding", "strength", "missing", "lacking")


LIST = """with s as (select s_suppkey k, s_nationkey book, chr((65 + s_suppkey % 26)::int) || lpad(((s_suppkey // 26) % 100)::varchar, 2, '0') code from supplier)"""


@register("printed_code_list", LIST + """ select book::varchar as book, code, 'category' as level, 'IX - Nome del volume' as chapter, 'Malattia ' || k as title, 'forma ' || k || ' rara del cuore|forma ' || k || ' (benigna) del cuore|riga sola|forma ' || k || ' doppia prima' as included, 'altro caso' as excluded from s
union all select book::varchar, code || '.0', 'subcategory', 'IX - Nome del volume', 'Sotto ' || k, 'termine unico', '' from s""")
def printed_code_list(spark, sf):
    """Printed lists of many volumes: chapters, categories and subcategories, lists under prefixes, braces, notes."""
    k = F.col("s_suppkey").cast("string")
    code = F.concat(F.chr(F.col("s_suppkey") % 26 + 65), F.lpad((F.floor(F.col("s_suppkey") / 26) % 100).cast("string"), 2, "0"))
    lines = [
        F.concat(F.lit("  "), code, F.lit("         Malattia "), k, F.lit(" (Z99)")), F.lit("         Incl.: forma x:"), F.lit("                 \u2022 rara                 del cuore"), F.lit("                 \u2022 (benigna)"),
        F.lit("         riga sola"), F.lit("                 \u2022 doppia:"), F.lit("                   \u2022 prima"), F.lit("         utilizzare un codice aggiuntivo se"), F.lit("         coda della nota"),
        F.lit("         Escl.: altro caso (I27.0)"), F.lit(""), F.concat(code, F.lit(".0         Sotto "), k, F.lit("\u2020")), F.lit("         Incl.: termine unico"), F.lit("12 Centro Collaboratore"),
    ]
    lines[1] = F.concat(F.lit("         Incl.: forma "), k, F.lit(":"))
    s = v.table(spark, sf, "supplier")
    # codes come round after 2,600 suppliers, and a list has each of its codes once: a book's next 2,600 are its next volume
    volume = F.concat_ws("/", F.col("s_nationkey").cast("string"), F.floor(F.col("s_suppkey") / 2600).cast("string")).alias("volume")
    rows = s.select(volume, "s_suppkey", F.posexplode(F.array(*lines)).alias("i", "line")).select("volume", (F.col("s_suppkey") * 100 + F.col("i")).alias("line_no"), "line")
    heads = s.select(volume).distinct().select("volume", F.lit(-1).cast("long").alias("line_no"), F.lit("   Capitolo IX - Nome del volume  ").alias("line"))
    got = pr.terminology_blocks(heads.union(rows), "volume")
    return got.select(F.substring_index("volume", "/", 1).alias("book"), "code", "level", "chapter", "title", F.array_join("included", "|").alias("included"), F.array_join("excluded", "|").alias("excluded"))


@register("principle_confirmation", """with s as (select distinct p_name form, 'S' || lpad((p_partkey % 40)::varchar, 2, '0') code from part where p_partkey % 3 = 0), n as (select distinct p_name name from part union select distinct split_part(p_name, ' ', 1) from part union select 'ignoto'),
h as (select name, code, 0 w from n join s on s.form = name union select name, code, 1 from n join s on starts_with(s.form, name || ' ')), b as (select name, string_agg(distinct code, ',' order by code) codes from h where w = (select min(w) from h x where x.name = h.name) group by 1)
select name, case when codes is null then 'not_found' else 'confirmed' end as outcome, coalesce(codes, '') as codes from n left join b using (name)""")
def principle_confirmation(spark, sf):
    p = part(spark, sf)
    sub = p.where("p_partkey % 3 = 0").select(F.col("p_name").alias("form"), F.concat(F.lit("S"), F.lpad((F.col("p_partkey") % 40).cast("string"), 2, "0")).alias("code")).distinct()
    names = p.select(F.explode(F.array(F.col("p_name"), F.element_at(F.split("p_name", " "), 1), F.lit("ignoto"))).alias("name"))
    return asm.confirmed_principles(names, sub)


@register("concept_conversion", """with p as (select p_partkey k, p_name n, p_partkey % 4 m from part), t as (select p_name form, min('C' || (p_partkey % 7)::varchar) code from part where p_partkey % 2 = 0 group by 1)
select k as enc, case when m = 3 then null else 3 end::int as "start", case when m = 3 then null else 3 + length(n) end::int as "end", case when m = 2 then null else t.code end as code,
 case when m <> 2 and t.code is not null then 'resolved' else 'nil' end as status, m <> 3 as anchored from p left join t on t.form = n""")
def concept_conversion(spark, sf):
    """Answers whose concept resolves, whose quote does, whose neither; quotes in another case, and quotes that the text has not."""
    p = part(spark, sf)
    n, m = F.col("p_name"), F.col("p_partkey") % 4
    forms = p.where("p_partkey % 2 = 0").groupBy(F.col("p_name").alias("name")).agg(F.min(F.concat(F.lit("C"), (F.col("p_partkey") % 7).cast("string"))).alias("code"))
    names = p.select(F.col("p_name").alias("name")).distinct().join(forms, "name", "left")
    resolved = names.select("name", F.when(F.col("code").isNotNull(), "resolved").otherwise("nil").alias("status"), "code", F.lit("exact_term").alias("method"))
    a = p.select(F.col("p_partkey").alias("enc"), F.lit(0).alias("pos"), n.alias("quote"), F.when(m == 1, "zz").when(m == 2, F.lit("zz")).otherwise(n).alias("concept"), F.lit("affirmed").alias("state"))
    a = a.withColumn("quote", F.when(F.col("enc") % 4 == 2, F.upper("quote")).otherwise(F.col("quote")))
    texts = p.select(F.col("p_partkey").alias("enc"), F.when(m == 3, "nothing").otherwise(F.concat(F.lit("Ha "), n, F.lit("."))).alias("text"))
    return asm.converted(a, texts, resolved).select("enc", "start", "end", "code", "status", "anchored")


@register("span_expansion", """with t as (select doc_id, unnest(range(len(w))) pos, unnest(w) token from (select doc_id, string_split(text, ' ') w from documents)),
o as (select doc_id, pos, coalesce(sum(length(token) + 1) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0)::int s, length(token) l from t),
x as (select o.doc_id, min(pos) a, max(pos) b, min(s) xs, max(s + l) xe from o where l > 0 and s < 22 and 13 < s + l group by 1)
select d.doc_id as enc, a::int as first_token, b::int as last_token, xs::int as x_start, xe::int as x_end from documents d left join x using (doc_id)""")
def span_expansion(spark, sf):
    """Spans of characters, widened to the tokens they touch."""
    d = v.table(spark, sf, "documents").select("doc_id", "text")
    t = se.tokens(d, "doc_id", "text").where("token != ''").select(F.col("doc_id").alias("enc"), "pos", F.col("start").alias("t_start"), (F.col("start") + F.length("token")).alias("t_end"))
    spans = d.select(F.col("doc_id").alias("enc"), F.lit(1).alias("id"), F.lit(13).alias("start"), F.lit(22).alias("end"))
    return asm.expanded_spans(iv.binned(spans, "start", "end", 256), iv.binned(t, "t_start", "t_end", 256)).select("enc", "first_token", "last_token", "x_start", "x_end")


@register("window_mentions", r"""with w as (select doc_id, unnest(range(0, greatest(length(text), 1), 1500)) o, text from documents), c as (select doc_id, o, substr(text, o + 1, 24) cut from w),
k as (select doc_id, o, length(cut) - length(regexp_replace(cut, '^\s+', '')) lead, regexp_replace(cut, '^\s+|\s+$', '', 'g') core from c) select doc_id as enc, (o + lead)::int as "start", (o + lead + length(core))::int as "end", md5(core) as form from k where core <> ''""")
def window_mentions(spark, sf):
    """What is found in a window, moved to its place in the whole text and trimmed."""
    d = v.table(spark, sf, "documents").select("doc_id", "text")
    pieces = sc.window_table(d, "doc_id", "text").withColumnRenamed("doc_id", "enc")
    found = pieces.select("enc", "offset", F.lit(0).alias("start"), F.lit(24).alias("end"), F.lit("x").alias("label"))
    return asm.rebased(pieces, found).select("enc", "start", "end", F.md5("form").alias("form"))


@register("drug_vocabulary_full", """with i as (select p_partkey enc, 'admission' field, p_name nm, null principle from part union all select p_partkey, 'discharge', p_name, p_type from part where p_size >= 10),
f as (select nm root, field, count(*) n, count(distinct enc) r from i group by 1, 2), u as (select nm root, principle, count(*) k from i where principle is not null group by 1, 2),
b as (select root, principle from u qualify row_number() over (partition by root order by k desc, principle) = 1), c as (select p_name root, string_agg(distinct lower(p_type), ' | ' order by lower(p_type)) subs from part where p_partkey % 3 = 0 group by 1)
select root, cast(sum(n) as bigint) as n, string_agg(field || ':' || n || ':' || r, '|' order by field || ':' || n || ':' || r) as fields, root as variants, any_value(principle) as principle,
 case when any_value(subs) is null then 'not_found' when any_value(principle) is null then 'not_verified' when bool_and(len(list_filter(string_split(lower(principle), ' '), lambda w: length(w) >= 5)) > 0 and len(list_filter(string_split(lower(principle), ' '), lambda w: length(w) >= 5 and not contains(subs, substr(w, 1, 6)))) = 0) then 'confirmed' else 'discordant' end as outcome
from f left join b using (root) left join c using (root) group by root""")
def drug_vocabulary_full(spark, sf):
    """Brands by root: uses and records in each field, variants, the prevailing principle, its outcome against a registry."""
    p = part(spark, sf)
    i = p.select(F.col("p_partkey").alias("enc"), F.lit("admission").alias("field"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("principle"))
    i = i.union(p.where("p_size >= 10").select("p_partkey", F.lit("discharge"), "p_name", "p_type"))
    return pr.drug_vocabulary(i, p.where("p_partkey % 3 = 0").select(F.col("p_name").alias("root"), F.col("p_type").alias("substances")))


@register("extraction_summary", f"with {ap.M} select count(distinct enc) as records, count(*) filter (kind = 'condition') as conditions, count(*) filter (kind = 'condition' and code is not null) as conditions_coded, count(*) filter (kind = 'condition' and state = 'negated') as conditions_negated, count(*) filter (kind = 'drug') as drugs, count(*) filter (kind = 'drug' and code is not null) as drugs_coded, count(*) filter (subject = 'family') as of_family, count(*) filter (id % 9 = 0) as unanchored from men")
def extraction_summary(spark, sf):
    m = ap.mentions(spark, sf)
    return asm.summary(m.withColumn("start", F.when(F.col("id") % 9 != 0, F.col("start"))))


@register("invented_allergies", "select count(*) filter (m in (1, 2)) as records, cast(coalesce(sum(case when m in (1, 2) then m end), 0) as bigint) as allergies from (select p_partkey % 4 m from part)")
def invented_allergies(spark, sf):
    """Allergies of records whose text does not speak of any (m of them in record m modulo 4; the fourth kind does)."""
    p = part(spark, sf)
    m = (F.col("p_partkey") % 4).cast("int")
    a = p.select(F.col("p_partkey").alias("enc"), F.explode(F.array_repeat(F.lit("x"), m)).alias("allergen"))
    texts = p.select(F.col("p_partkey").alias("enc"), F.when(m == 3, "Riferisce ALLERGIE note").otherwise(F.col("p_name")).alias("text"))
    return asm.invented_allergies(a, texts)


@register("agents_table", f"select agent, name from (values {v._values(asm.AGENTS)}) t(agent, name)")
def agents_table(spark, sf):
    return asm.agents(spark)


@register("patient_graph", f"with {ap.A}, q as (select * from asr where enc = 7) select s, p, o from (select enc || '-F-' || grp::bigint::varchar s, unnest(['kind', 'agents', 'state', 'subject', 'codes']) p, unnest([kind, n_agents::varchar, state, subject, codes]) o from q) where o is not null and o <> ''")
def patient_graph(spark, sf):
    """All triples of one encounter's assertions."""
    from ..operators import alignment as al

    one = ap.mentions(spark, sf).where("enc = 7")
    return gr.to_triples(gr.assertions(al.groups(one)))


_CASES = ap.M + """, mm as (select *, case when kind = 'drug' then case id % 3 when 0 then 'admission' when 1 then 'discharge' else 'history' end else 'history' end moment from men where code is not null),
cs as (select enc, coalesce(list_sort(list(distinct code) filter (kind = 'condition' and state = 'affirmed' and subject = 'patient')), []) conditions, coalesce(list_sort(list(distinct code) filter (kind = 'drug' and moment = 'admission')), []) admission, coalesce(list_sort(list(distinct code) filter (kind = 'drug' and moment = 'discharge')), []) discharge from mm group by 1)"""


def case_table(spark, sf):
    m = ap.mentions(spark, sf)
    moment = F.when(F.col("kind") == "drug", of([F.lit("admission"), F.lit("discharge"), F.lit("history")], "id")).otherwise("history")
    return asm.cases(m.withColumn("moment", moment))


@register("cases_from_states", f"with {_CASES} select enc, array_to_string(conditions, ',') as conditions, array_to_string(admission, ',') as admission, array_to_string(discharge, ',') as discharge from cs where len(discharge) > 0")
def cases_from_states(spark, sf):
    return case_table(spark, sf).select("enc", *[F.array_join(c, ",").alias(c) for c in ("conditions", "admission", "discharge")])


@register("case_texts", f"with {_CASES} select enc, 'CONDITIONS OF THE PATIENT (ICD-10):' || chr(10) || case when len(conditions) > 0 then '  ' || array_to_string(conditions, '; ') else '  no coded condition' end || chr(10) || chr(10) || 'THERAPY AT ADMISSION (ATC classes):' || chr(10) || case when len(admission) > 0 then '  ' || array_to_string(admission, '; ') else '  none' end || chr(10) || chr(10) || 'CANDIDATE CLASSES, filtered for safety:' || chr(10) || '  ' || array_to_string(discharge, chr(10) || '  ') as text from cs where len(discharge) > 0")
def case_texts(spark, sf):
    return case_table(spark, sf).select("enc", asm.case_text(F.col("conditions"), F.col("admission"), F.col("allergies"), F.col("discharge")).alias("text"))


@register("entity_scores", f"with {ap.M}, a as (select distinct enc seg, \"start\", \"end\" - id % 2 \"end\", kind label from men where agent = 'B' or id % 5 = 0), b as (select distinct enc seg, \"start\", \"end\", kind label from men where agent = 'B'), j as (select coalesce(a.label, b.label) label, a.seg p, b.seg t from a full join b on a.seg = b.seg and a.\"start\" = b.\"start\" and a.\"end\" = b.\"end\" and a.label = b.label), k as (select unnest([label, 'all']) label, p, t from j), c as (select label, count(p) np, count(t) nt, count(case when p is not null and t is not null then 1 end) nh from k group by 1) select label, np, nt, nh, round(nh::double / np, 6) as precision, round(nh::double / nt, 6) as recall, round(2 * nh::double / (np + nt), 6) as f1 from c")
def entity_scores(spark, sf):
    """Exact spans per label: every other end is off by one, and some spans are found that are none."""
    m = ap.mentions(spark, sf)
    b = m.where("agent = 'B'").select(F.col("enc").alias("seg"), "start", "end", F.col("kind").alias("label"))
    a = m.where("agent = 'B' or id % 5 = 0").select(F.col("enc").alias("seg"), "start", (F.col("end") - F.col("id") % 2).alias("end"), F.col("kind").alias("label"))
    return asm.entity_scores(a, b).select("label", "np", "nt", "nh", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@register("three_way_split", "with r as (select c_custkey k, row_number() over (order by sha256('20260915:' || c_custkey::varchar), c_custkey) i, count(*) over () n from customer) select k as c_custkey, case when i <= floor(n * 0.7) then 'train' when i <= floor(n * 0.7) + floor(n * 0.15) then 'dev' else 'test' end as part from r")
def three_way_split(spark, sf):
    return asm.three_way_split(v.table(spark, sf, "customer").select("c_custkey"), "c_custkey")


@register("hash_sample", "select c_custkey from (select c_custkey from customer order by sha256('20260915:' || c_custkey::varchar), c_custkey limit 50) union select c_custkey from customer where c_custkey in (3, 5)")
def hash_sample(spark, sf):
    """A reproducible sample of fifty, and two ids by name."""
    c = v.table(spark, sf, "customer").select("c_custkey")
    return asm.sampled(c, "c_custkey", 50).union(asm.sampled(c, "c_custkey", None, only=[3, 5])).distinct()


@register("verify_codes", f"with {v.base_sql(3)}, reg as (select distinct substr(code, 1, n) c from code, range(1, 8) r(n)), x as (select p_partkey enc, case p_partkey % 3 when 0 then code when 1 then 'bad' else 'Z99' end cls from code) select case when x.cls in (select c from reg) and regexp_matches(x.cls, '^[A-Z]\\d{{2}}([A-Z]([A-Z](\\d{{2}})?)?)?$') then 'allowed' else 'rejected' end as verdict, count(*) as n from x group by 1")
def verify_codes(spark, sf):
    """Prescriptions against a registry: malformed and unknown codes are rejected, never allowed."""
    c = v.codes(spark, sf)
    x = c.select(F.col("p_partkey").alias("enc"), of([F.col("code"), F.lit("bad"), F.lit("Z99")]).alias("cls"))
    none = spark.createDataFrame([], "enc long, cls string")
    return api.verify(spark, x, c.select("code"), spark.createDataFrame([], "enc long, cond string"), none, none).groupBy("verdict").agg(F.count("*").alias("n"))


@register("bio_round_trip", "select p_partkey, 1 as n, 0 as \"start\", length(p_name) as \"end\", 'X' as label from part")
def bio_round_trip(spark, sf):
    """Spans to labels of tokens and back; an I that continues nothing opens nothing."""
    p = part(spark, sf).select("p_partkey", F.concat("p_name", F.lit(" in corso.")).alias("text"), F.length("p_name").alias("n"))
    got = sc.bio_table(p.select("p_partkey", "text", F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("end"), F.lit("X").alias("label"))).alias("spans")), "p_partkey")
    return got.groupBy("p_partkey").agg(F.count("*").cast("int").alias("n"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("label").alias("label"))


@register("last_form_wins", "select lower(p_brand) as form, arg_max(p_name, p_partkey) as code from part group by 1")
def last_form_wins(spark, sf):
    """Of equal forms the one that stands last gives the code."""
    from ..operators.resolve import last_wins

    return last_wins(part(spark, sf).select(F.col("p_brand").alias("form"), F.col("p_name").alias("code"), "p_partkey"), "form", "code", "p_partkey")


@register("phrase_labels", r"""with b as (select string_split(text, ' ') w from benchmark), q as (select distinct array_to_string(w[1:2], ' ') phrase, 'x' label from b where len(w) >= 2 union select distinct array_to_string(w[1:5], ' '), 'y' from b where len(w) >= 5),
t as (select doc_id, unnest(range(len(w))) pos, unnest(w) a from (select doc_id, string_split(text, ' ') w from documents)),
n as (select *, lead(a, 1) over o b, lead(a, 2) over o c, lead(a, 3) over o d, lead(a, 4) over o e from t window o as (partition by doc_id order by pos)),
h as (select doc_id, unnest([a || ' ' || b, a || ' ' || b || ' ' || c || ' ' || d || ' ' || e]) phrase from n)
select label, count(*) as n, count(distinct doc_id) as n_docs from h join q using (phrase) group by 1""")
def phrase_labels(spark, sf):
    """Phrases of two labels and up to six words found in whole texts."""
    w = F.split("text", " ", -1)
    b = v.table(spark, sf, "benchmark")
    cut = lambda n, x: b.where(F.size(w) >= n).select(F.array_join(F.slice(w, 1, n), " ").alias("phrase"), F.lit(x).alias("label")).distinct()
    d = v.table(spark, sf, "documents").select("doc_id", "text")
    return se.phrase_matches_upto(d, "doc_id", "text", cut(2, "x").union(cut(5, "y")), 6, 2).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))
