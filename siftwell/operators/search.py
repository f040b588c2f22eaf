"""Look-ups: tiered code search, labels with fallback, phrase matching, comparison of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def search(table: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(tier, code, name): 0 exact, 1 prefix, 2 contains; a row takes its best tier; 1 to 50 rows."""
    limit, q = max(1, min(50, limit)), query.strip()
    code, name, low = F.upper("code"), F.lower("name"), q.lower()
    tier = F.when((code == q.upper()) | (name == low), 0).when(code.startswith(q.upper()) | name.startswith(low), 1).when(F.contains(code, F.lit(q.upper())) | F.contains(name, F.lit(low)), 2)
    return table.select(tier.alias("tier"), "code", "name").where("tier is not null").distinct().orderBy("tier", "code", "name").limit(limit)


def labelled(codes: DataFrame, labels: DataFrame, categories: DataFrame, length: int) -> DataFrame:
    """A code's own label, else that of its category (its first ``length`` characters)."""
    cat = categories.select(F.col("code").alias("_cat"), F.col("label").alias("_label"))
    return codes.join(labels, "code", "left").withColumn("_cat", F.substring("code", 1, length)).join(cat, "_cat", "left").select("code", F.coalesce("label", "_label").alias("label"))


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, start, token): blank-separated tokens with exact 0-based offsets."""
    parts = df.select(key, F.split(text, " ", -1).alias("_t"))
    # offsets of slices first, then inside each slice by the length of what stands before
    size = 32
    slices = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_t") - 1, F.lit(0)), F.lit(size)), lambda i: F.slice("_t", i + 1, F.lit(size)))
    cut = parts.select(key, slices.alias("_g")).select(key, F.posexplode("_g").alias("_i", "_s"))
    w = Window.partitionBy(key).orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)  # a row per slice, not per token
    placed = cut.withColumn("_at", F.coalesce(F.sum(F.length(F.array_join("_s", " ")) + 1).over(w), F.lit(0)).cast("int"))
    before = F.transform("_s", lambda x, j: F.struct((F.col("_i") * size + j).alias("pos"), (F.col("_at") + F.when(j > 0, F.length(F.array_join(F.slice("_s", F.lit(1), j), " ")) + 1).otherwise(0)).alias("start"), x.alias("token")))
    return placed.select(key, F.explode(before).alias("x")).select(key, "x.pos", "x.start", "x.token")


def phrase_matches(df: DataFrame, key: str, text: str, phrases: DataFrame, n: int) -> DataFrame:
    """(key, pos, phrase): phrases of n tokens found by an equi-join on n-grams.

    n-grams are built inside the text's own token array (split once, in a projection of its own), and
    only where a token begins a phrase: nothing else is exploded or shuffled.
    """
    return phrase_matches_upto(df, key, text, phrases.select("phrase", F.lit("").alias("label")), n, n).select(key, "pos", "phrase")


def phrase_matches_upto(df: DataFrame, key: str, text: str, phrases: DataFrame, longest: int = 6, shortest: int = 1) -> DataFrame:
    """(key, pos, n, phrase, label): dictionary phrases of ``shortest`` to ``longest`` tokens at every place.

    phrases: (phrase, label). First words of phrases are a small table where the dictionary is one.
    """
    words = phrases.select("phrase", "label").distinct().withColumn("_n", F.size(F.split("phrase", " "))).where(F.col("_n").between(shortest, longest))
    lengths = sorted(r[0] for r in words.select("_n").distinct().collect())  # at most ``longest`` numbers
    t = df.select(key, F.split(text, " ", -1).alias("_t"))
    if not lengths:
        return words.join(t, F.lit(False)).select(key, F.lit(0).alias("pos"), F.col("_n").alias("n"), "phrase", "label")
    # n-grams are made inside the text's own array, so an exploded row carries its phrase only
    begin = words.select(F.element_at(F.split("phrase", " "), 1).alias("w")).distinct().limit(65).collect()  # a few first words at most
    few = F.array(*[F.lit(r.w) for r in begin]) if len(begin) <= 64 else None
    places = F.sequence(F.lit(0), F.size("_t") - 1)
    if few is not None:
        places = F.filter(places, lambda i: F.array_contains(few, F.get("_t", i)))

    def gram(n):
        made = F.transform(places, lambda i: F.when(i + n <= F.size("_t"), F.struct(i.alias("pos"), F.concat_ws(" ", *[F.get("_t", i + k) for k in range(n)]).alias("phrase"))))
        return F.array_compact(made)

    grams = t.select(key, F.explode(F.concat(*[gram(n) for n in lengths])).alias("g")).select(key, "g.pos", "g.phrase")
    return grams.join(words, "phrase").select(key, "pos", F.col("_n").alias("n"), "phrase", "label")


def compare_runs(old: DataFrame, new: DataFrame, lower_is_better: tuple[str, ...] = ()) -> DataFrame:
    """(metric, old) and (metric, new) -> direction: better, worse, same, new or gone."""
    j = old.join(new, "metric", "full")
    up = F.col("new") > F.col("old")
    down = F.col("new") < F.col("old")
    flip = F.col("metric").isin(*lower_is_better) if lower_is_better else F.lit(False)
    d = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(up & ~flip | down & flip, "better").when(up | down, "worse").otherwise("same")
    return j.select("metric", "old", "new", d.alias("direction"))


def most_common(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values; ties in value order."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
