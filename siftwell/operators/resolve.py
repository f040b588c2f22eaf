"""Resolution of names to codes: a generic cascade of strategies, and the similarity join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normal_ascii


def cascade(names: DataFrame, strategies: list[tuple[str, DataFrame]]) -> DataFrame:
    """names(name) and strategies in order, each (name, code) -> name, status, code, codes, method.

    The first strategy with a result decides; one code resolves, several are ambiguous (no code
    is picked), none is nil. All strategies run in one plan, the least place per name wins.
    """
    found = None
    for i, (_, hits) in enumerate(strategies):
        one = hits.select("name", "code", F.lit(i).alias("place"))
        found = one if found is None else found.unionByName(one)
    best = Window.partitionBy("name")
    first = found.withColumn("least", F.min("place").over(best)).where("place = least").groupBy("name", "place").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    methods = F.array(*[F.lit(n) for n, _ in strategies])
    out = names.select("name").distinct().join(first, "name", "left")
    n = F.coalesce(F.size("codes"), F.lit(0))
    status = F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("nil")
    return out.select("name", status.alias("status"), F.when(n == 1, F.col("codes")[0]).alias("code"), F.array_join(F.coalesce("codes", F.array().cast("array<string>")), ",").alias("codes"), F.when(F.col("place").isNotNull(), F.element_at(methods, F.col("place") + 1)).alias("method"))


def exact(names: DataFrame, forms: DataFrame) -> DataFrame:
    """names(name, form) joined to forms(form, code)."""
    return names.join(forms.select("form", "code"), "form").select("name", "code")


def association(names: DataFrame, forms: DataFrame) -> DataFrame:
    """'a/b' as 'a e b'; 'a/b/c' as 'a, b e c' in normal form."""
    parts = F.split("form", r"\s*/\s*")
    n = F.size(parts)
    joined = F.concat_ws(" e ", F.array_join(F.slice(parts, F.lit(1), n - 1), " "), F.element_at(parts, -1))
    return exact(names.where(F.contains("form", F.lit("/"))).withColumn("form", joined), forms)


def abbreviated(names: DataFrame, forms: DataFrame) -> DataFrame:
    """Token by token prefixes ('pantoprazolo sand'): blocked on the whole first token."""
    first = lambda c: F.element_at(F.split(c, " "), 1)
    a = names.withColumn("t", F.split("form", " ")).where(F.size("t") >= 2).withColumn("b", first("form"))
    f = forms.select(F.split("form", " ").alias("u"), first("form").alias("b"), "code")
    ok = (F.size("u") >= F.size("t")) & F.forall(F.arrays_zip("t", F.slice("u", F.lit(1), F.size("t")).alias("u2")), lambda x: F.startswith(x["u2"], x["t"]))
    return a.join(f, "b").where(ok).select("name", "code").distinct()


def drop_last(names: DataFrame, forms: DataFrame) -> DataFrame:
    """Without the last token (a salt)."""
    t = F.split("form", " ")
    return exact(names.where(F.size(t) >= 2).withColumn("form", F.array_join(F.slice(t, F.lit(1), F.size(t) - 1), " ")), forms)


def prefix_of(names: DataFrame, forms: DataFrame) -> DataFrame:
    """The name and a blank begin a form: every token prefix of a form is a key of an equi-join."""
    t = F.split("form", " ")
    cut = forms.where(F.size(t) >= 2).select("code", F.explode(F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda n: F.array_join(F.slice(t, F.lit(1), n), " "))).alias("form"))
    return exact(names, cut).distinct()


def drug_cascade(names: DataFrame, substances: DataFrame, brands: DataFrame) -> DataFrame:
    """names(name) against substances(form, code) and brands(form, code), all forms normalised."""
    n = names.select("name").distinct().withColumn("form", normal_ascii(F.col("name")))
    return cascade(names, [
        ("exact_substance", exact(n, substances)), ("association", association(n, substances)), ("brand", exact(n, brands)),
        ("abbreviated_brand", abbreviated(n, brands)), ("salt_suffix", drop_last(n, substances)), ("salt_form", prefix_of(n, substances)),
    ])


def generalised(names: DataFrame, terms: DataFrame) -> DataFrame:
    """A name that begins two terms or more, all of one category, takes the category."""
    t = F.split("form", " ")
    cut = terms.where(F.size(t) >= 2).select("form", F.substring_index("code", ".", 1).alias("code"), F.explode(F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda n: F.array_join(F.slice(t, F.lit(1), n), " "))).alias("key"))
    one = cut.groupBy("key").agg(F.countDistinct("form").alias("n"), F.countDistinct("code").alias("cats"), F.min("code").alias("code")).where("n >= 2 and cats = 1")
    return names.join(one.withColumnRenamed("key", "form"), "form").select("name", "code")


def common_category(codes) -> object:
    """The one category all codes share, else null."""
    cats = F.array_distinct(F.transform(codes, lambda c: F.substring_index(c, ".", 1)))
    return F.when(F.size(cats) == 1, cats[0])


def condition_cascade(names: DataFrame, terms: DataFrame, phrases: DataFrame | None = None) -> DataFrame:
    """Exact, then generalised, then phrase matches; several codes of one category become it."""
    n = names.select("name").distinct().withColumn("form", normal_ascii(F.col("name")))
    hits = exact(n, terms)
    codes = hits.groupBy("name").agg(F.collect_set("code").alias("c"))
    settled = codes.withColumn("cat", common_category(F.col("c"))).select("name", F.explode(F.when(F.size("c") == 1, F.col("c")).when(F.col("cat").isNotNull(), F.array("cat")).otherwise(F.col("c"))).alias("code"))
    steps = [("exact_term", settled), ("generalised", generalised(n, terms))]
    if phrases is not None:
        steps.append(("phrase", phrases))
    return cascade(names, steps)


def composite(names: DataFrame, forms: DataFrame) -> DataFrame:
    """A mention's parts in order: whole, before ':', before '(', in '('; differing codes are ambiguous."""
    low = F.lower("name")
    parts = F.array(low, F.trim(F.substring_index(low, ":", 1)), F.trim(F.substring_index(low, "(", 1)), F.trim(F.regexp_extract(low, r"\(([^()]*)\)", 1)))
    names = names.select("name").distinct()  # all that follows is in proportion to the names, not to their mentions
    rows = names.select("name", F.posexplode(parts).alias("place", "form")).where("form != ''")
    hit = rows.join(forms.select("form", "code"), "form")
    agg = hit.groupBy("name").agg(F.countDistinct("code").alias("n"), F.min(F.struct("place", "code")).alias("first"))
    out = names.join(agg, "name", "left")
    status = F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("nil")
    return out.select("name", status.alias("status"), F.when(F.col("n") == 1, F.col("first.code")).alias("code"))


def last_wins(rows: DataFrame, key: str, value: str, place: str) -> DataFrame:
    """Lower-cased keys, each with the value that stands last."""
    return rows.groupBy(F.lower(key).alias(key)).agg(F.max_by(value, place).alias(value))


def _grams(text: str):
    padded = F.concat(F.lit(" "), F.col(text), F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: padded.substr(i, F.lit(3)))


def trigrams(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.explode(F.array_distinct(_grams(text))).alias("gram"))


def trigram_best(names: DataFrame, terms: DataFrame, least: float = 0.35, shortest: int = 6) -> DataFrame:
    """(name, term, score): the most alike term by Jaccard of trigrams; ties to the smaller term.

    An inverted join on trigrams with prefix filtering, exact: two sets of a and b trigrams can only reach
    the threshold with ceil(least * a) in common, so one of the a - ceil(least * a) + 1 rarest of either is
    shared. Only those are joined, a common trigram hardly ever, and pairs are then compared on whole sets.
    """
    a = names.select("name").distinct().where(F.length("name") >= shortest)
    b = terms.select("term").distinct().where(F.length("term") >= shortest)
    sets = lambda df, c: df.select(c, F.array_distinct(_grams(c)).alias("g"))
    sa, sb = sets(a, "name"), sets(b, "term")
    freq = sa.select(F.explode("g").alias("gram")).union(sb.select(F.explode("g"))).groupBy("gram").agg(F.count("*").alias("f"))

    def rare(df, c):
        ranked = df.select(c, F.size("g").alias("n"), F.explode("g").alias("gram")).join(freq, "gram").groupBy(c, "n").agg(F.array_sort(F.collect_list(F.struct("f", "gram"))).alias("x"))
        keep = (F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).cast("int")
        return ranked.select(c, F.col("n").alias(f"n_{c}"), F.explode(F.slice("x", F.lit(1), keep)).alias("y")).select(c, f"n_{c}", F.col("y.gram").alias("gram"))

    pairs = rare(sa, "name").join(rare(sb, "term"), "gram").where((F.col("n_name") >= least * F.col("n_term")) & (F.col("n_term") >= least * F.col("n_name"))).select("name", "term").distinct()
    both = pairs.join(sa, "name").join(sb.withColumnRenamed("g", "h"), "term").select("name", "term", F.size(F.array_intersect("g", "h")).alias("k"), F.size("g").alias("na"), F.size("h").alias("nb"))
    scored = both.withColumn("score", F.col("k").cast("double") / (F.col("na") + F.col("nb") - F.col("k")).cast("double")).where(F.col("score") >= least)
    best = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("score"), "term"))
    return scored.withColumn("_n", best).where("_n = 1").select("name", "term", "score")


def linked(names: DataFrame, resolved: DataFrame, terms: DataFrame) -> DataFrame:
    """The cascade's result, and for nil names a proposal by likeness: always ambiguous, without a code."""
    nil = resolved.where("status = 'nil'").select("name")
    p = trigram_best(nil, terms).select("name", F.concat(F.lit("similar:"), F.format_string("%.2f", "score"), F.lit(":"), F.col("term")).alias("proposal"))
    j = resolved.join(p, "name", "left")
    return j.select("name", F.when(F.col("proposal").isNotNull(), "ambiguous").otherwise(F.col("status")).alias("status"), "code", "codes", F.coalesce("proposal", "method").alias("method"))


def coverage(resolved: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Share of occurrences (name, n) whose name resolves."""
    j = occurrences.join(resolved.select("name", "status"), "name", "left")
    ok = F.when(F.col("status") == "resolved", F.col("n")).otherwise(0)
    return j.agg(F.sum("n").alias("n"), F.sum(ok).alias("resolved"), F.round(F.sum(ok).cast("double") / F.sum("n").cast("double"), 6).alias("share"))


def confirmed(bridge: DataFrame, registry: DataFrame) -> DataFrame:
    """(brand, principle) against (brand, substance): confirmed, discordant or absent.

    Confirmed: each word of five letters or more of the principle has its first six letters in
    some substance of the brand.
    """
    subs = registry.groupBy("brand").agg(F.array_join(F.array_sort(F.collect_set(F.lower("substance"))), " ").alias("subs"))
    j = bridge.join(subs, "brand", "left")
    words = F.filter(F.split(F.lower("principle"), r"[^a-z]+"), lambda w: F.length(w) >= 5)
    ok = F.forall(words, lambda w: F.contains("subs", F.substring(w, 1, 6))) & (F.size(words) > 0)
    return j.select("brand", "principle", F.when(F.col("subs").isNull(), "absent").when(ok, "confirmed").otherwise("discordant").alias("outcome"))
