"""Queries of mentions, scopes, segments, anomalies and sources over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as iv
from ..operators import scopes as sc
from ..operators import search as se
from ..sources import records as rec
from . import views as v

QUERIES, ORACLES = {}, {}


def register(name, oracle=None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return put


# Markers and terminators for the invented prose of the driver's documents.
MARKERS = (("not", "negation", 1, 4), ("of the", "history", 1, 6), ("with", "uncertainty", 1, 5), ("was", "negation", -1, 3))
CLOSE = {"and", "to", "in the"}
FORMS = {"thing": "x", "tion of": "y", "the": "z", "for the": "w"}


def docs(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", "text")


@register("marker_scopes")
def marker_scopes(spark, sf):
    return sc.scope_table(docs(spark, sf), "doc_id", "text", MARKERS, CLOSE)


@register("family_scopes")
def family_scopes(spark, sf):
    """Texts with a family marker put before them: every scope of a relative."""
    d = docs(spark, sf).select("doc_id", F.concat(F.lit("Familiarità per cardiopatia (padre). Madre deceduta per "), "text").alias("text"))
    return sc.family_table(d, "doc_id", "text")


@register("assessed_mentions")
def assessed(spark, sf):
    """Dictionary matches, longest first, with state and subject from their scopes."""
    d = docs(spark, sf)
    m = iv.longest_wins(sc.dictionary_table(d, "doc_id", "text", FORMS), ["doc_id"]).withColumn("id", F.xxhash64("doc_id", "start"))
    out = sc.assessed(m, sc.scope_table(d, "doc_id", "text", MARKERS, CLOSE), sc.family_table(d, "doc_id", "text"), "doc_id")
    return out.groupBy("label", "state", "subject").agg(F.count("*").alias("n"))


@register("literal_occurrences", r"select 'the' as literal, count(*) as n from (select unnest(regexp_extract_all(regexp_replace(text, '[^A-Za-z0-9_\x{80}-\x{10ffff}]+', '  ', 'g'), '(?:^| )the(?: |$)')) x from documents) union all select 'of', count(*) from (select unnest(regexp_extract_all(regexp_replace(text, '[^A-Za-z0-9_\x{80}-\x{10ffff}]+', '  ', 'g'), '(?:^| )of(?: |$)')) x from documents)")
def literals(spark, sf):
    return sc.occurrence_table(docs(spark, sf), "doc_id", "text", ["the", "of"]).groupBy("literal").agg(F.count("*").alias("n"))


@register("text_windows", "with w as (select doc_id, unnest(range(0, greatest(length(text), 1), 1500)) o, text from documents) select doc_id, o::int as \"offset\", length(substr(text, o + 1, 1500))::int as n from w")
def windows(spark, sf):
    return sc.window_table(docs(spark, sf), "doc_id", "text").select("doc_id", "offset", F.length("piece").alias("n"))


@register("safe_segments", r"""with d as (select doc_id, text, string_split(text, '') ch, length(text) n from documents where length(text) > 0),
c as (select doc_id, text, n, case when n > 1000 then list_filter(range(1, n + 1), lambda i: ch[i] = chr(10) or (ch[i] in ('.', ';', '!', '?') and i < n and ch[i + 1] in (' ', chr(10)) and not (i >= 2 and regexp_matches(ch[i - 1], '\p{L}') and (i < 3 or not regexp_matches(ch[i - 2], '\p{L}'))))) else [] end cuts from d),
r as (select doc_id, text, n, list_reduce(list_concat([[0]], list_transform(cuts, lambda x: [x])), lambda acc, x: case when x[1] - acc[len(acc)] >= 1000 then list_concat(acc, x) else acc end) k from c),
e as (select doc_id, text, case when k[len(k)] = n then k else list_concat(k, [n]) end k from r),
p as (select doc_id, text, unnest(range(1, len(k))) i, k from e)
select doc_id, k[i]::int as "offset", (k[i + 1] - k[i])::int as n from p where trim(substr(text, (k[i] + 1)::bigint, (k[i + 1] - k[i])::bigint), ' ' || chr(10) || chr(9) || chr(13)) <> ''""")
def segments(spark, sf):
    return sc.segment_table(docs(spark, sf), "doc_id", "text").select("doc_id", "offset", F.length("piece").alias("n"))


@register("token_offsets", "with t as (select doc_id, unnest(range(len(w))) pos, unnest(w) token from (select doc_id, string_split(text, ' ') w from documents)), o as (select *, coalesce(sum(length(token) + 1) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint \"start\" from t) select doc_id, count(*) as n, cast(sum(('0x' || substr(md5(pos::varchar || ':' || \"start\"::varchar || ':' || token), 1, 8))::bigint) as bigint) as digest from o group by 1")
def token_offsets(spark, sf):
    """Place, offset and token of every token, as a sum of hashes per document."""
    t = se.tokens(docs(spark, sf), "doc_id", "text")
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("pos").cast("string"), F.col("start").cast("string"), "token")), 1, 8), 16, 10).cast("long")
    return t.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(h).alias("digest"))


@register("marker_scope_native", """with t as (select doc_id, unnest(range(len(w))) pos, unnest(w) tok from (select doc_id, string_split(lower(text), ' ') w from documents)),
x as (select *, min(case when tok = 'and' or contains(tok, '.') then pos end) over (partition by doc_id order by pos rows between 1 following and unbounded following) stop, max(pos) over (partition by doc_id) top from t),
s as (select doc_id, pos, least(coalesce(stop, top + 1), pos + 5, top + 1) fin from x where tok = 'was') select doc_id, pos::int as pos, (fin - pos - 1)::int as width from s""")
def marker_native(spark, sf):
    """A forward scope of four tokens within the text's row: up to the first terminator of the four after the marker."""
    d = docs(spark, sf).select("doc_id", F.split(F.lower("text"), " ", -1).alias("w"))
    scopes = F.transform("w", lambda x, i: F.when(x == "was", F.struct(i.alias("pos"), F.slice("w", i + 2, 4).alias("after"))))
    s = d.select("doc_id", F.explode(F.filter(scopes, lambda x: x.isNotNull())).alias("s")).select("doc_id", "s.pos", "s.after")
    stop = F.array_position(F.transform("after", lambda x: (x == "and") | F.contains(x, F.lit("."))), True).cast("int")
    return s.select("doc_id", "pos", F.when(stop > 0, stop - 1).otherwise(F.size("after")).alias("width"))


@register("record_anomalies", """with d as (select page_id, case when page_id % 10 = 0 then page_id - 1 else page_id end enc, page_id % 7 m from pages),
f as (select enc, max(m) filter (page_id = enc or page_id % 10 = 0) m from d group by 1)
select 'duplicate_id' as kind, count(*) as n from (select enc from d group by 1 having count(*) > 1) union all select 'unexpected_type', count(*) from d where m = 1 union all select 'text_not_a_string', count(*) from d where m = 2
union all select 'blank_text', count(*) from d where m = 3 union all select 'missing_section', count(*) from (select enc from d group by 1 having bool_and(m = 4))""")
def anomalies(spark, sf):
    """Records made of pages, with every kind of fault planted."""
    p = v.table(spark, sf, "pages")
    m = F.col("page_id") % 7
    enc = F.when(F.col("page_id") % 10 == 0, F.col("page_id") - 1).otherwise(F.col("page_id")).cast("string")
    sec = lambda t, x: F.concat(F.lit('{"tipo":"' + t + '","data":"d","reportOid":1,"testo":'), x, F.lit("}"))
    a = sec("Anamnesi", F.when(m == 2, "5").when(m == 3, '"  "').otherwise('"prose"'))
    b = F.when(m == 4, F.lit("")).otherwise(F.concat(F.lit(","), sec("Terapia medica all'ingresso", F.lit('"x: 1"'))))
    c = F.when(m == 1, F.concat(F.lit(","), sec("Altro", F.lit('"y"')))).otherwise(F.lit(""))
    raw = p.select(F.col("page_id").alias("place"), F.concat(F.lit('{"encOid":'), enc, F.lit(',"referti":['), a, b, c, F.lit("]}")).alias("body"))
    return rec.anomalies(raw).groupBy("kind").agg(F.count("*").alias("n"))
