"""Assembling a record's state: conversion of responses and spans, gold annotations, cases, samples, reports.

Tables: mentions(enc, field, agent, kind, start, end, code, state, subject) as in ``alignment``.
"""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import resolve

# Agents of the provenance graph (letter, name).
AGENTS = (
    ("A", "dictionary with negation, uncertainty, history and subject rules"),
    ("B", "language model under a fixed schema; codes come from the resolvers"),
    ("C", "neural recogniser of entities"),
    ("P", "parser of the structured therapy fields, shared by all pipelines"),
)


def agents(spark) -> DataFrame:
    """(agent, name): the constant table of agents."""
    return spark.createDataFrame(list(AGENTS), "agent string, name string")


def first_place(text: Column, name: Column) -> Column:
    """0-based place of the first occurrence, null if there is none; repeated names share it."""
    return F.nullif(F.instr(text, name), F.lit(0)) - 1


def placed_items(items: DataFrame, texts: DataFrame, key: str, name: str) -> DataFrame:
    """items(key, pos, name, ...) of texts(key, text) with start and end in characters."""
    at = first_place(F.col("text"), F.col(name))
    j = items.join(texts.select(key, "text"), key)
    return j.withColumn("start", at.cast("int")).withColumn("end", (F.col("start") + F.length(name)).cast("int")).drop("text")


def converted(answers: DataFrame, texts: DataFrame, resolved: DataFrame) -> DataFrame:
    """answers(enc, pos, quote, concept, state) -> (enc, pos, start, end, code, status, method, anchored).

    The concept is resolved first, the quote only if the concept resolves to nothing. resolved: the
    cascade's result for every name (without proposals by likeness). A quote is anchored exactly, else
    ignoring case, else it stays unanchored and is counted so.
    """
    r = resolved.select("name", "status", "code", "method")
    c = r.select(F.col("name").alias("concept"), F.col("status").alias("cs"), F.col("code").alias("cc"), F.col("method").alias("cm"))
    q = r.select(F.col("name").alias("quote"), F.col("status").alias("qs"), F.col("code").alias("qc"), F.col("method").alias("qm"))
    j = answers.join(c, "concept", "left").join(q, "quote", "left").join(texts.select("enc", "text"), "enc", "left")
    nil = F.coalesce(F.col("cs"), F.lit("nil")) == "nil"
    start = tx.anchor(F.coalesce("text", F.lit("")), F.col("quote"))
    j = j.withColumn("start", start.cast("int"))
    pick = lambda a, b: F.when(nil, F.col(b)).otherwise(F.col(a))
    return j.select(
        "enc", "pos", "quote", "state", "start", (F.col("start") + F.length("quote")).cast("int").alias("end"), pick("cc", "qc").alias("code"),
        F.coalesce(pick("cs", "qs"), F.lit("nil")).alias("status"), pick("cm", "qm").alias("method"), F.col("start").isNotNull().alias("anchored"),
    )


def expanded_spans(spans: DataFrame, tokens: DataFrame) -> DataFrame:
    """spans(enc, id, start, end) and tokens(enc, pos, t_start, t_end) -> first and last token that a span touches.

    A span inside a token takes the whole token; one that touches none has no tokens.
    """
    hit = spans.join(tokens, "enc").where("t_start < end and start < t_end") if "_bin" not in spans.columns else spans.join(tokens, ["enc", "_bin"]).where("t_start < end and start < t_end")
    found = hit.groupBy("enc", "id").agg(F.min("pos").alias("first_token"), F.max("pos").alias("last_token"), F.min("t_start").alias("x_start"), F.max("t_end").alias("x_end"))
    return spans.drop("_bin").distinct().join(found, ["enc", "id"], "left")


def rebased(pieces: DataFrame, found: DataFrame) -> DataFrame:
    """found(enc, offset, start, end, label) inside pieces(enc, offset, piece) -> spans of the whole text.

    Outer white space goes and the span moves with it; blank spans are dropped; a span that overlapping
    windows both give counts once.
    """
    j = found.join(pieces, ["enc", "offset"])
    cut = F.col("piece").substr(F.col("start") + 1, F.col("end") - F.col("start"))
    core = F.regexp_replace(cut, r"(?uU)^\s+|\s+$", "")
    lead = F.length(cut) - F.length(F.regexp_replace(cut, r"(?uU)^\s+", ""))
    at = F.col("offset") + F.col("start") + lead
    return j.where(core != "").select("enc", at.cast("int").alias("start"), (at + F.length(core)).cast("int").alias("end"), "label", core.alias("form")).distinct()


def gold_spans(annotations: DataFrame, texts: DataFrame) -> DataFrame:
    """annotations(enc, kind, text, state, subject, nth) -> every word-bounded occurrence, or the nth (from 1).

    One row per span, and one with a null start for what does not resolve (``problem``).
    """
    a = annotations.withColumnRenamed("text", "quote").join(texts.select("enc", "text"), "enc", "left")
    # pieces between occurrences: their running length gives the places, without leaving the JVM
    mark = F.concat(F.lit(r"(?uU)(?<!\w)\Q"), F.col("quote"), F.lit(r"\E(?!\w)"))
    parts = F.split(F.coalesce("text", F.lit("")), mark, -1)
    sizes = F.slice(F.transform(parts, lambda x: F.length(x)), F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    places = F.transform(sizes, lambda x, i: F.aggregate(F.slice(sizes, F.lit(1), i + 1), F.lit(0), lambda s, n: s + n) + i * F.length("quote"))
    each = a.withColumn("places", places)
    chosen = F.when(F.col("nth").isNull(), F.col("places")).when(F.col("nth") <= F.size("places"), F.slice("places", F.col("nth"), F.lit(1))).otherwise(F.slice("places", F.lit(1), F.lit(0)))
    problem = F.when(F.col("text").isNull(), "record absent").when(F.size("places") == 0, "not in the text").when(F.col("nth") > F.size("places"), "too few occurrences")
    out = each.select("enc", "kind", "quote", "state", "subject", problem.alias("problem"), F.explode_outer(chosen).alias("start"))
    return out.select("enc", "kind", "start", (F.col("start") + F.length("quote")).alias("end"), "quote", "state", "subject", "problem")


def cases(mentions: DataFrame, unit: int = 5) -> DataFrame:
    """mentions(enc, kind, code, state, subject, moment) -> (enc, conditions, admission, discharge, allergies), sorted arrays.

    Only encounters with a coded discharge; conditions only if affirmed of the patient.
    """
    m = mentions.where("code is not null")
    drug = lambda moment: F.array_sort(F.collect_set(F.when((F.col("kind") == "drug") & (F.col("moment") == moment), F.substring("code", 1, unit))))
    cond = (F.col("kind") == "condition") & (F.col("state") == "affirmed") & (F.col("subject") == "patient")
    g = m.groupBy("enc").agg(
        F.array_sort(F.collect_set(F.when(cond, F.col("code")))).alias("conditions"), drug("admission").alias("admission"), drug("discharge").alias("discharge"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "allergy", F.col("code")))).alias("allergies"),
    )
    return g.where(F.size("discharge") > 0)


def case_text(conditions: Column, admission: Column, allergies: Column, candidates: Column) -> Column:
    """A case as the text a model is given: codes in order, candidates line by line."""
    listed = lambda c, none: F.when(F.size(c) > 0, F.concat(F.lit("  "), F.array_join(F.array_sort(c), "; "))).otherwise(none)
    parts = [F.lit("CONDITIONS OF THE PATIENT (ICD-10):"), listed(conditions, "  no coded condition"), F.lit(""), F.lit("THERAPY AT ADMISSION (ATC classes):"), listed(admission, "  none")]
    allergy = F.when(F.size(allergies) > 0, F.concat(F.lit("\n\nALLERGIES (ATC): "), F.array_join(F.array_sort(allergies), "; "))).otherwise("")
    lines = F.array_join(F.transform(candidates, lambda c: F.concat(F.lit("  "), c)), "\n")
    return F.concat(F.concat_ws("\n", *parts), allergy, F.lit("\n\nCANDIDATE CLASSES, filtered for safety:\n"), lines)


def entity_scores(found: DataFrame, truth: DataFrame) -> DataFrame:
    """P, R and F1 of exact spans (seg, start, end, label), per label and 'all'."""
    from .evaluation import prf

    a = found.select("seg", "start", "end", "label").distinct().withColumn("p", F.lit(1))
    b = truth.select("seg", "start", "end", "label").distinct().withColumn("t", F.lit(1))
    j = a.join(b, ["seg", "start", "end", "label"], "full")
    counts = j.select(F.explode(F.array(F.col("label"), F.lit("all"))).alias("label"), "p", "t").groupBy("label").agg(
        F.count("p").alias("np"), F.count("t").alias("nt"), F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("nh"))
    return prf(counts)


def three_way_split(ids: DataFrame, key: str, shares=(0.7, 0.15), seed: int = 20260915) -> DataFrame:
    """(key, part): train, dev and test by rank of a hash; sizes are exact, reruns agree.

    Ranks are counted over hash buckets first, so no task holds all ids.
    """
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    rows = ids.select(key).distinct().withColumn("h", h).withColumn("b", F.substring("h", 1, 3))
    per = rows.groupBy("b").agg(F.count("*").alias("m"))
    ahead = F.coalesce(F.sum("m").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # 4,096 rows at most
    n = per.agg(F.sum("m").alias("n"))
    placed = rows.join(per.select("b", ahead.alias("ahead")), "b").crossJoin(n)  # one row
    rank = F.col("ahead") + F.row_number().over(Window.partitionBy("b").orderBy("h", key))
    first, second = (F.floor(F.col("n") * F.lit(Decimal(str(s)))) for s in shares)  # as doubles, 0.7 of 90 is under 63
    part = F.when(F.col("rank") <= first, "train").when(F.col("rank") <= first + second, "dev").otherwise("test")
    return placed.withColumn("rank", rank).select(key, part.alias("part"))


def sampled(ids: DataFrame, key: str, n: int | None, seed: int = 20260915, only: list | None = None) -> DataFrame:
    """A reproducible sample of n ids (the first by hash), or an explicit list, which must be there."""
    if only:
        found = ids.where(F.col(key).isin(only)).select(key).distinct()
        missing = set(only) - {r[0] for r in found.collect()}  # as many as were asked for
        if missing:
            raise ValueError(f"ids that are absent: {sorted(missing)}")
        return found
    if n is None:
        return ids.select(key).distinct()
    return ids.select(key).distinct().orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key).limit(n)


def summary(mentions: DataFrame) -> DataFrame:
    """One row: counts of an extraction, with codes, states, moments and unanchored mentions."""
    kind = lambda k: F.col("kind") == k
    return mentions.agg(
        F.countDistinct("enc").alias("records"), F.count_if(kind("condition")).alias("conditions"), F.count_if(kind("condition") & F.col("code").isNotNull()).alias("conditions_coded"),
        F.count_if(kind("condition") & (F.col("state") == "negated")).alias("conditions_negated"), F.count_if(kind("drug")).alias("drugs"),
        F.count_if(kind("drug") & F.col("code").isNotNull()).alias("drugs_coded"), F.count_if(F.col("subject") == "family").alias("of_family"), F.count_if(F.col("start").isNull()).alias("unanchored"),
    )


def invented_allergies(allergies: DataFrame, texts: DataFrame, word: str = r"(?iuU)allerg") -> DataFrame:
    """(records, allergies): allergies of records whose text does not speak of any."""
    a = allergies.groupBy("enc").agg(F.count("*").alias("n")).join(texts.select("enc", "text"), "enc", "left")
    return a.where(~F.coalesce(F.col("text").rlike(word), F.lit(False))).agg(F.count("*").alias("records"), F.coalesce(F.sum("n"), F.lit(0)).alias("allergies"))


def confirmed_principles(names: DataFrame, substances: DataFrame) -> DataFrame:
    """names(name) against substances(form, code): the exact description, else every one that the name and a blank begin."""
    n = names.select("name").distinct().withColumn("form", tx.normal_ascii(F.col("name")))
    exact = resolve.exact(n, substances).withColumn("way", F.lit(0))
    begins = resolve.prefix_of(n, substances).withColumn("way", F.lit(1))
    hits = exact.union(begins).withColumn("best", F.min("way").over(Window.partitionBy("name"))).where("way = best")
    found = hits.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    return n.select("name").join(found, "name", "left").select("name", F.when(F.col("codes").isNotNull(), "confirmed").otherwise("not_found").alias("outcome"), F.coalesce("codes", F.lit("")).alias("codes"))


def flat_schema(schema: dict) -> dict:
    """A JSON Schema without references: definitions are put in place, defaults and titles go, all properties are required."""
    known = schema.get("$defs", {})

    def plain(node):
        if isinstance(node, list):
            return [plain(x) for x in node]
        if not isinstance(node, dict):
            return node
        name = node.get("$ref", "").rpartition("/")[2]
        merged = (known[name] | {k: x for k, x in node.items() if k != "$ref"}) if name else node
        return {k: plain(x) for k, x in merged.items() if k not in ("default", "title", "$defs")}

    out = plain(schema)
    return out | {"required": list(out.get("properties", {}))}


def strict_schema(schema):
    """The same with every object closed and all its properties required."""
    if isinstance(schema, list):
        return [strict_schema(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    out = {k: strict_schema(x) for k, x in schema.items()}
    if out.get("type") == "object":
        out["additionalProperties"] = out.get("additionalProperties", False)
        if "properties" in out:
            out["required"] = list(out["properties"])
    return out


_JSON = {"string": "string", "long": "integer", "integer": "integer", "double": "number", "float": "number", "boolean": "boolean"}


def json_schema(schema) -> dict:
    """A Spark type as JSON Schema."""
    kind = schema if isinstance(schema, dict) else json.loads(schema.json())
    if isinstance(kind, str):
        return {"type": _JSON.get(kind, "string")}
    if kind["type"] == "struct":
        part = lambda f: json_schema(f["type"]) if isinstance(f["type"], dict) else {"type": _JSON.get(f["type"], "string")}
        return {"type": "object", "properties": {f["name"]: part(f) for f in kind["fields"]}, "required": [f["name"] for f in kind["fields"] if not f["nullable"]]}
    if kind["type"] == "array":
        item = kind["elementType"]
        return {"type": "array", "items": json_schema(item) if isinstance(item, dict) else {"type": _JSON.get(item, "string")}}
    if kind["type"] == "map":
        item = kind["valueType"]
        return {"type": "object", "additionalProperties": json_schema(item) if isinstance(item, dict) else {"type": _JSON.get(item, "string")}}
    return {"type": _JSON.get(kind["type"], "string")}


def report(df: DataFrame, title: str, rows: int = 40) -> str:
    """A small result table as text, for a console or a log."""
    head, body = df.columns, [["" if x is None else str(x) for x in r] for r in df.limit(rows).collect()]
    width = [max(len(c), *[len(r[i]) for r in body], 0) if body else len(c) for i, c in enumerate(head)]
    line = lambda r: "  ".join(x.ljust(w) for x, w in zip(r, width)).rstrip()
    return "\n".join([title, line(head), line(["-" * w for w in width]), *map(line, body)])
