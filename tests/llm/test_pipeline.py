"""The pipeline's stages on rows with null and repeated ids, clashing columns and empty tables."""

import random

import corpus_pipeline as cp
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, copies string, score double, lang_pred string, toxicity_score double, near_row long, mix_row int"
WORDS = {"en": ["the", "thing", "with", "when", "which", "other"], "fr": ["le", "été", "où", "être", "avec", "dans"]}


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """(folder, documents as read, rows): two languages, insults, copies, rows without ids or words."""
    path = str(tmp_path_factory.mktemp("world"))
    rng = random.Random(9)
    fresh = {x: [w + str_ for w in ws for str_ in ["", *("".join(rng.choice("aeinrst") for _ in range(3)) for _ in range(60))]] for x, ws in WORDS.items()}
    rows, labels = [], []
    for i in range(500):
        x = ["en", "fr"][i % 2]
        words = [rng.choice(fresh[x] if k % 2 else WORDS[x]) for k in range(70)]
        bad = i % 5 == 0
        for _ in range(4 if bad else 0):
            words[rng.randrange(70)] = rng.choice(["grumblefoot", "zonkhead", "wixlbrain"])
        rows.append((i, " ".join(words), x, ["a", "b", "c", None][i % 4]))
        labels.append((i, 1, int(bad)))
    clean = [r for r in rows if r[0] % 5]
    rows += [(None, clean[0][1], "en", "a"), (None, clean[0][1], "en", "a"), (None, clean[1][1] + " extra", "en", "b"), (7, "unrelated words but the same id as another row, with enough of the other things", "en", "b"), (7, None, None, None), (None, "", "en", "a"), (None, "12 34", "en", "a")]
    extra = lambda r: (*r, 0, "c", 0.5, "lp", 0.25, 3, 4)
    spark.createDataFrame([extra(r) for r in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, spark.read.parquet(f"{path}/documents.parquet"), rows


def texts(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)


def test_language_id_rejects_what_has_no_letters(spark, world):
    path, docs, rows = world
    got = cp.identify_language(spark, docs, path)
    assert got.columns == docs.columns
    assert texts(got) == sorted([(r[0], r[1], r[3]) for r in rows if r[1] not in (None, "", "12 34")], key=str)
    assert got.where("score != 0.5 or lang_pred != 'lp'").count() == 0


def test_toxicity_rejects_planted_words(spark, world):
    path, docs, rows = world
    got = cp.drop_toxic(spark, docs, path)
    assert got.columns == docs.columns and got.where("toxicity_score != 0.25").count() == 0
    left = texts(got)
    bad = [x for x in left if x[1] and any(w in x[1] for w in ("grumblefoot", "zonkhead", "wixlbrain"))]
    assert len(bad) <= 5 and len(left) >= 400


def test_near_duplicates_go_by_row(spark, world):
    path, docs, rows = world
    got = cp.drop_near_duplicates(spark, docs, path)
    assert got.columns == docs.columns
    left = texts(got)
    # the copies without an id and the near copy go but one; rows that share an id stay
    assert len(left) == len(rows) - 3
    assert sum(x[0] == 7 for x in left) == 3
    assert sorted({x[1] for x in left if x[1]}) and len({x[1] for x in left if x[1] is not None and x[1].startswith(rows[1][1][:40])}) == 1


def test_mix_takes_rows_without_ids(spark, world):
    path, docs, rows = world
    got = cp.mix_sources(spark, docs, path)
    assert got.columns == docs.columns and got.where("copies != 'c' or mix_row != 4").count() == 0
    total = sum(len(r[1].split()) for r in rows if r[1])
    n = got.select(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0]
    assert abs(n - total) < 80 and {r.doc_id for r in got.collect()} >= {None, 7}


def test_packing_reads_small_batches(spark, tmp_path, monkeypatch):
    spark.range(0, 5000, 1, 1).selectExpr("id doc_id", "'some words' text").write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(docs, tokenizer):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

        return docs.mapInArrow(run, "n long")

    monkeypatch.setattr(cp.packing, "packed", sizes)
    got = [r.n for r in cp.pack_sequences(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()]
    assert sum(got) == 5000 and max(got) <= 2000


def test_run_is_its_stages(spark, world):
    path, docs, rows = world
    packed = cp.run(spark, path)
    stage = docs
    for name, f in cp.STAGES[:-1]:
        stage = f(spark, stage, path)
        target = f"{path}/stage-{name}"
        stage.write.parquet(target)
        stage = spark.read.parquet(target)
    want = {}
    for r in stage.collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + 1
    got = {r.doc_id: r.n for r in packed.where("start = 0").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == want


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, f in cp.STAGES:
        assert f(spark, docs, str(tmp_path)).count() == 0
    assert cp.run(spark, str(tmp_path)).count() == 0
