"""Licence scan by sentence rules (native DataFrame operations only).

Texts are cut into sentences, sentences normalised to lower-case ASCII words, and each known
sentence becomes its identifier. A document's identifiers, in order, form a sequence against
which the ordered rules are matched: a rule is a sequence of identifiers that must follow
each other (other sentences may lie between). The first rule of each licence family that
matches names the licence, so full texts outrank one-line references.

Edge cases: null or empty text has no sentences and no licence; repeated rows each get their
own result; an empty table gives an empty result. A newline ends a sentence; ``unwrap=True`` joins
lines that no blank line parts. ``wrapped_scan``, the registered query, reads both ways: a known
sentence may be one line or run over any number of consecutive lines, with comment marks, indents
and blank lines between them, and 'v. 2' is no end of a sentence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import license_data

CUT = r"[.!?]+[ \t\n\f\r]+|[\n\r]+"

SENTENCES = license_data.sentences()

# Longer forms of known sentences, for ``wrapped_scan`` only.
LONGER = {
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC_GRANT",
}

RULES = license_data.rules()


def rule_pattern(ids) -> str:
    """Identifiers as they stand in a ``|A|B|C|`` sequence, others between them allowed."""
    return ".*".join(rf"\|{x}\|" for x in ids)


def license_scan(docs: DataFrame, unwrap: bool = False) -> DataFrame:
    """doc_id, n_sentences (known ones), sequence, licenses (sorted, comma separated; '' if none)."""
    spark = docs.sparkSession
    text = F.regexp_replace("text", r"([^\n])\n([^\n])", "$1 $2") if unwrap else F.col("text")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text.alias("text"))
    known = F.broadcast(spark.createDataFrame(list(SENTENCES.items()), "sentence string, sid string"))  # a fixed table
    cuts = rows.select("rid", "doc_id", F.posexplode_outer(F.split("text", CUT)).alias("pos", "sentence"))
    cuts = cuts.select("rid", "doc_id", "pos", F.trim(F.lower(F.regexp_replace("sentence", "[^A-Za-z0-9]+", " "))).alias("sentence"))
    # a row of each document stays, so that documents without licence sentences stay too
    hits = cuts.join(known, "sentence", "left").where("sid is not null or pos = 0 or pos is null")
    seq = hits.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.count("sid").alias("n_sentences"), F.array_sort(F.collect_list(F.when(F.col("sid").isNotNull(), F.struct("pos", "sid")))).alias("found"))
    names = F.transform("found", lambda x: F.concat(F.lit("|"), x["sid"], F.lit("|")))
    return named(seq.withColumn("sequence", F.array_join(names, "")))


def words(c) -> object:
    return F.trim(F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", " ")))


def wrapped_scan(docs: DataFrame) -> DataFrame:
    """As ``license_scan``, for texts wrapped at any line width as well.

    A known sentence is found where it begins with a line and ends with that line or a later one
    of the same sentence; of several that begin with a line the longest counts.
    """
    spark = docs.sparkSession
    table = SENTENCES | LONGER
    most = max(len(k.split()) for k in table)  # lines: each has a word at least
    firsts = sorted({k.split()[0] for k in table})
    head = lambda c: F.substring_index(c, " ", 3)  # every known sentence has three words at least
    known = F.broadcast(spark.createDataFrame([(k, i, " ".join(k.split()[:3])) for k, i in table.items()], "known string, sid string, first string"))  # a fixed table
    whole = F.regexp_replace("text", r"\b([vV])\.[ \t\n\f\r]+(?=[0-9])", "$1 ")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", whole.alias("text"))
    cuts = rows.select("rid", "doc_id", F.posexplode_outer(F.split("text", r"[.!?]+[ \t\n\f\r]+")).alias("pos", "sentence"))
    lines = cuts.select("rid", "doc_id", "pos", F.filter(F.transform(F.split("sentence", r"[\n\r]+"), words), lambda x: x != "").alias("lines"))
    places = F.filter(F.transform("lines", lambda x, i: F.when(F.substring_index(x, " ", 1).isin(firsts), i)), lambda i: i.isNotNull())
    # a row of each document stays, so that documents without licence sentences stay too
    starts = lines.withColumn("places", places).where("size(places) > 0 or pos = 0 or pos is null").select("rid", "doc_id", "pos", "lines", F.explode_outer("places").alias("at"))
    joined = starts.withColumn("broken", F.array_join(F.slice("lines", F.col("at") + 1, most), "\n"))
    joined = joined.select("rid", "doc_id", "pos", "at", "broken", F.translate("broken", "\n", " ").alias("plain"), head(F.translate("broken", "\n", " ")).alias("first"))
    n = F.length("known")
    ends = F.startswith(F.col("plain"), F.col("known")) & ((F.length("plain") == n) | (F.substring(F.col("broken"), n + 1, F.lit(1)) == "\n"))
    hits = joined.join(known, (joined["first"] == known["first"]) & ends, "left").groupBy("rid", "pos", "at").agg(F.first("doc_id").alias("doc_id"), F.max_by("sid", F.length("known")).alias("sid"))
    seq = hits.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.count("sid").alias("n_sentences"), F.array_sort(F.collect_list(F.when(F.col("sid").isNotNull(), F.struct("pos", "at", "sid")))).alias("found"))
    return named(seq.withColumn("sequence", F.array_join(F.transform("found", lambda x: F.concat(F.lit("|"), x["sid"], F.lit("|"))), "")))


def named(seq: DataFrame) -> DataFrame:
    """The licences that the rules see in each sequence."""
    families = list(dict.fromkeys(f for f, _, _ in RULES))
    picks = []
    for fam in families:
        pick = None
        for _, name, ids in (r for r in RULES if r[0] == fam):
            cond = F.col("sequence").rlike(rule_pattern(ids))
            pick = F.when(cond, name) if pick is None else pick.when(cond, name)
        picks.append(pick)
    return seq.select("doc_id", "n_sentences", "sequence", F.array_join(F.array_sort(F.array_compact(F.array(*picks))), ",").alias("licenses"))
