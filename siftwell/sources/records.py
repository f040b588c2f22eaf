"""Scans of records, registries, states and rules, and the sinks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECTION = "tipo string, data string, reportOid bigint, testo string"
SCHEMA = f"encOid bigint, referti array<struct<{SECTION.replace(' string', ':string').replace(' bigint', ':bigint')}>>"
TYPES = ("Anamnesi", "Terapia medica all'ingresso", "Terapia alla Dimissione")
MANDATORY = TYPES[:2]


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records -> (place, body): each record's JSON, unparsed, in file order."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", "array<string>")).alias("place", "body"))


def records(raw: DataFrame) -> DataFrame:
    """Sections (enc_oid, pos, tipo, data, report_oid, testo) of the first record of each id.

    A section counts if its type is known and its text is a string that is not blank.
    """
    from pyspark.sql import Window

    p = raw.select("place", F.parse_json("body").alias("v")).select("place", F.try_variant_get("v", "$.encOid", "bigint").alias("enc_oid"), F.try_variant_get("v", "$.referti", "array<variant>").alias("r"))
    first = p.withColumn("_n", F.row_number().over(Window.partitionBy("enc_oid").orderBy("place"))).where("_n = 1")
    s = first.select("enc_oid", F.posexplode("r").alias("pos", "x"))
    get = lambda name, kind: F.try_variant_get("x", f"$.{name}", kind)
    s = s.withColumn("kind_of", F.schema_of_variant(get("testo", "variant")))
    s = s.select("enc_oid", "pos", get("tipo", "string").alias("tipo"), get("data", "string").alias("data"), get("reportOid", "bigint").alias("report_oid"), F.when(F.col("kind_of") == "STRING", get("testo", "string")).alias("testo"))
    return s.where(F.col("tipo").isin(*TYPES) & F.col("testo").isNotNull() & (F.trim("testo") != ""))


def anomalies(raw: DataFrame) -> DataFrame:
    """(enc_oid, kind, detail): duplicate ids, unexpected types, texts that are no strings, blank texts, missing sections."""
    v = raw.select("place", F.try_variant_get(F.parse_json("body"), "$.encOid", "bigint").alias("enc_oid"), F.variant_get(F.parse_json("body"), "$.referti", "array<variant>").alias("r"))
    dup = v.groupBy("enc_oid").agg(F.count("*").alias("n")).where("n > 1").select("enc_oid", F.lit("duplicate_id").alias("kind"), F.col("n").cast("string").alias("detail"))
    s = v.select("enc_oid", F.explode("r").alias("x"))
    s = s.select("enc_oid", F.try_variant_get("x", "$.tipo", "string").alias("tipo"), F.schema_of_variant(F.try_variant_get("x", "$.testo", "variant")).alias("kind_of"), F.try_variant_get("x", "$.testo", "string").alias("testo"))
    bad_type = s.where(~F.col("tipo").isin(*TYPES) | F.col("tipo").isNull()).select("enc_oid", F.lit("unexpected_type"), "tipo")
    no_text = s.where(F.col("kind_of").isNotNull() & (F.col("kind_of") != "STRING")).select("enc_oid", F.lit("text_not_a_string"), "tipo")
    blank = s.where((F.col("kind_of") == "STRING") & (F.trim("testo") == "")).select("enc_oid", F.lit("blank_text"), "tipo")
    need = v.select("enc_oid").distinct().withColumn("tipo", F.explode(F.array(*[F.lit(t) for t in MANDATORY])))
    missing = need.join(s.select("enc_oid", "tipo").distinct(), ["enc_oid", "tipo"], "left_anti").select("enc_oid", F.lit("missing_section"), "tipo")
    return dup.union(bad_type).union(no_text).union(blank).union(missing)


def section(df: DataFrame, kind: str) -> DataFrame:
    """(enc_oid, testo) of a section; the first of a kind counts."""
    return df.where(F.col("tipo") == kind).groupBy("enc_oid").agg(F.min_by("testo", "pos").alias("testo"))


def wide(df: DataFrame) -> DataFrame:
    return df.groupBy("enc_oid").pivot("tipo", list(TYPES)).agg(F.min_by("testo", "pos"))


def record_of(spark: SparkSession, history: str, admission: str) -> DataFrame:
    """Sections of one record made of two texts."""
    return spark.createDataFrame([(0, 0, TYPES[0], None, 0, history), (0, 1, TYPES[1], None, 1, admission)], "enc_oid long, pos int, tipo string, data string, report_oid long, testo string")


def registry(spark: SparkSession, path: str, code: str, name: str, length: int | None = None) -> DataFrame:
    """(name, codes) of a semicolon CSV, lower-cased names, optionally codes of one length only."""
    r = spark.read.option("header", True).option("sep", ";").option("maxCharsPerColumn", -1).csv(path)
    r = r.select(F.trim(F.regexp_replace(F.col(code), "﻿", "")).alias("code"), F.lower(F.trim(F.col(name))).alias("name")).where("code is not null and name is not null")
    if length:
        r = r.where(F.length("code") == length)
    return r.groupBy("name").agg(F.array_sort(F.collect_set("code")).alias("codes"))


def labels(spark: SparkSession, path: str, code: str, name: str, sep: str = ",") -> DataFrame:
    """(code, label) of a CSV that may begin with a byte order mark; labels lower-cased."""
    r = spark.read.option("header", True).option("sep", sep).csv(path)
    for c in r.columns:
        r = r.withColumnRenamed(c, c.lstrip("﻿"))
    return r.select(F.col(code).alias("code"), F.lower(F.col(name)).alias("label"))


def states(spark: SparkSession, folder: str, agent: str, schema, whole_files: bool = True) -> DataFrame:
    """State files of one agent (names with a leading underscore are service files); whole_files: a file is one JSON, else JSON lines."""
    return spark.read.option("multiLine", whole_files).option("pathGlobFilter", "[!_]*.json").schema(schema).json(folder).withColumn("agent", F.lit(agent))


def flattened(states: DataFrame) -> DataFrame:
    """Mentions of states: conditions and drugs as rows, those without a place are dropped."""
    parts = [states.select("enc", "agent", F.lit(kind).alias("kind"), F.inline(col)) for kind, col in (("condition", "conditions"), ("drug", "drugs"))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).where("start is not null")


def gold(spark: SparkSession, path: str) -> DataFrame:
    """(enc, kind, text, state, subject, nth) of hand annotations: {enc: {kind: [[text, state, subject, nth?]]}}."""
    text = spark.read.text(path, wholetext=True)
    by = text.select(F.explode(F.from_json("value", "map<string,map<string,array<array<string>>>>")).alias("enc", "kinds")).select("enc", F.explode("kinds").alias("kind", "rows"))
    r = by.select(F.col("enc").cast("long").alias("enc"), "kind", F.explode("rows").alias("x"))
    return r.select("enc", "kind", F.col("x")[0].alias("text"), F.col("x")[1].alias("state"), F.col("x")[2].alias("subject"), F.get("x", F.lit(3)).cast("int").alias("nth"))


_STATEMENT = re.compile(r"""(?:[^."';#]|"(?:[^"\\]|\\.)*"|<[^>]*>|\.(?=\S)|;)+\.(?=\s|$)""")
_TERM = re.compile(r"""<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@[\w-]+|\^\^\S+)?|([^\s;,]+)|([;,])""")


def read_turtle(text: str) -> list[tuple[str, str, str]]:
    """Triples of a Turtle subset: prefixes, lists with ; and , strings, prefixed names. For rule files of a few hundred lines."""
    triples = []
    body = "\n".join(line for line in text.splitlines() if not line.lstrip().startswith(("@prefix", "#")))
    for st in _STATEMENT.findall(body):
        parts = [(a or b.replace('\\"', '"') if a or b else c, sep) for a, b, c, sep in _TERM.findall(st.rstrip(". \n") + " ")]
        s = p = None
        for value, sep in parts:
            if sep == ";":
                p = None
            elif sep != ",":
                if s is None:
                    s = value
                elif p is None:
                    p = "rdf:type" if value == "a" else value
                else:
                    triples.append((s, p, value))
    return triples


def rules_from_triples(triples: DataFrame) -> DataFrame:
    """(s, p, o) -> one row per subject with a map of predicate to sorted objects, ordered by subject."""
    each = triples.groupBy("s", "p").agg(F.array_sort(F.collect_set("o")).alias("o"))
    return each.groupBy("s").agg(F.map_from_entries(F.collect_list(F.struct("p", "o"))).alias("facts")).orderBy("s")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_states(df: DataFrame, path: str) -> None:
    """States as Parquet, a folder per agent (a file per encounter would be millions of files)."""
    df.write.mode("overwrite").partitionBy("agent").parquet(path)


def write_triples(triples: DataFrame, path: str) -> None:
    """N-Triples lines of (s, p, o)."""
    quote = F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"')
    triples.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit('> "'), quote, F.lit('" .')).alias("value")).write.mode("overwrite").text(path)


def append_responses(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_turtle(rows: list[tuple], prefix: str, names: tuple[str, ...]) -> str:
    """A fixed table as Turtle: a subject per row, a predicate per column, lists for repeated values; nulls are left out."""
    out = [f"@prefix {prefix}: <urn:{prefix}#> ."]
    for i, row in enumerate(rows, 1):
        facts = [f'  {prefix}:{n} ' + ", ".join(f'"{x}"' for x in (v if isinstance(v, (tuple, list)) else (v,))) for n, v in zip(names, row) if v not in (None, ())]
        out.append(f"{prefix}:r{i:04d} a {prefix}:Rule ;\n" + " ;\n".join(facts) + " .")
    return "\n".join(out) + "\n"


def write_manifest(spark: SparkSession, path: str, sources: list[dict]) -> None:
    """What was fetched, one JSON line per source (name, path, sha256, rows, ...), as one file."""
    import json

    spark.createDataFrame([(json.dumps(s, sort_keys=True, ensure_ascii=False),) for s in sources], "value string").coalesce(1).write.mode("overwrite").text(path)
