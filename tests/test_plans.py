"""Registered queries on small tables of their own."""

import datetime as dt
import hashlib

import pytest

from siftwell.plans import alignment as ap
from siftwell.plans import assembly as asp
from siftwell.plans import mentions as mp
from siftwell.plans import ranking as rp
from siftwell.plans import text as tp


def test_all_parts_give_names(spark, tmp_path):
    parts = [(37, "warm wheel", "Brand#1", "T", 1), (41, "cold plate", "Brand#2", "T", 1), (401, "rare spindle", "Brand#3", "T", 1), (407, "tall mast", "Brand#4", "T", 1)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r.name: (r.status, r.code, r.method) for r in tp.cascade(spark, str(tmp_path)).collect()}
    assert len(got) == 6 * 4
    assert got["rare spindle"] == ("nil", None, None) and got["tall mast sale"] == ("resolved", "S07", "salt_suffix") and got["tall"] == ("resolved", "S07", "salt_form")
    total = tp.cascade_coverage(spark, str(tmp_path)).first()
    assert total.n == sum(len(name) % 5 + 1 for name in got)
    assert {r.name for r in tp.linker(spark, str(tmp_path)).collect()} == set(got)
    more = (410, "cold plate", "Brand#5", "T", 1)  # brand of a part beyond 400: 410 = 10 * 41
    spark.createDataFrame([*parts, more], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.mode("overwrite").parquet(f"{tmp_path}/part.parquet")
    assert {(r.name, r.code) for r in tp.token_prefix(spark, str(tmp_path)).collect()} >= {("br cold pl", "B2"), ("br cold pl", "B5")}


def test_spans_over_midnight_meet(spark, tmp_path):
    at = lambda day, hour: dt.datetime(2024, 5, day, hour, tzinfo=dt.timezone.utc)
    # value: tens of minutes; event_id % 3 is the agent (0 A, 1 B)
    events = [(3, 1, at(1, 22), 30.0), (4, 1, at(2, 1), 12.0), (6, 1, at(2, 5), 6.0), (7, 1, at(2, 5), 6.0), (9, 2, at(1, 22), 30.0), (10, 2, at(2, 4), 12.0), (13, 3, at(2, 1), 12.0)]
    spark.createDataFrame([(i, u, t, v, "{}") for i, u, t, v in events], "event_id long, user_id long, ts timestamp, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(r.label for r in ap.longest(spark, str(tmp_path)).collect()) == ["A3", "A6", "A9", "B10", "B13"]
    r = ap.gold_prf(spark, str(tmp_path)).first()
    assert (r.np, r.nt, r.nh) == (4, 3, 2)


def test_intervals_rest_on_1000_rounds(spark, monkeypatch):
    rows = [(1, e, (e * e * 37 % 101) / 101) for e in range(40)]  # fine enough that 100 rounds give other bounds
    monkeypatch.setattr(rp, "ranked", lambda *a, **b: (None, None, None))
    monkeypatch.setattr(rp, "proposal", lambda *a: None)
    monkeypatch.setattr(rp.rk, "after", lambda s: None)
    monkeypatch.setattr(rp.rk, "before", lambda s: "before")
    each = lambda p, t, levels: spark.createDataFrame([(n, e, 0.5 if p == "before" else x) for n, e, x in rows], "level int, enc int, f1 double")
    monkeypatch.setattr(rp.ev, "hierarchical", each)
    draw = lambda r, i: int(hashlib.sha256(f"20260916:{r}:{i}".encode()).hexdigest()[:8], 16) % len(rows)
    means = sorted(sum(rows[draw(r, i)][2] for i in range(len(rows))) / len(rows) for r in range(1000))
    want = [sum(x for _, _, x in rows) / len(rows), means[25], means[975]]
    for query, off in ((rp.bootstrap, 0.0), (rp.paired, 0.5)):
        got = query(spark, "").first()
        assert [got.mean, got.low, got.high] == pytest.approx([x - off for x in want], abs=2e-6)


def test_resampling_deals_no_draws(spark):
    """Draws stay in their task: the plan explodes no encounters into rounds, and keys of different sizes keep their own numbers."""
    rows = spark.range(25_000).selectExpr("cast(1 as int) level", "id * 7 enc", "(id * id % 97) / 97.0D f1").union(spark.sql("select 3, 5L, 0.25D union all select 3, 4L, 0.75D"))
    out = rp.ev.bootstrap(rows, ["level"], "f1", 200)
    assert "sha2" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.level: (r.mean, r.low, r.high) for r in out.collect()}
    for level, x in ((1, [(i * i % 97) / 97 for i in range(25_000)]), (3, [0.75, 0.25])):
        draws = (int(hashlib.sha256(f"20260916:{t}:{i}".encode()).hexdigest()[:8], 16) % len(x) for t in range(200) for i in range(len(x)))
        means = sorted(sum(x[next(draws)] for _ in x) / len(x) for _ in range(200))
        assert got[level] == pytest.approx((sum(x) / len(x), means[5], means[195]), abs=2e-6)


def test_codes_that_come_round_are_entries_of_their_own(spark, tmp_path):
    spark.createDataFrame([(7, 1), (2607, 1), (2607 + 2600, 1), (7 + 26, 2)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    got = sorted((r.book, r.code, r.title) for r in asp.printed_code_list(spark, str(tmp_path)).collect())
    assert got == sorted([(b, c + end, f"{t} {k}") for b, c, k in (("1", "H00", 7), ("1", "H00", 2607), ("1", "H00", 5207), ("2", "H01", 33)) for end, t in (("", "Malattia"), (".0", "Sotto"))])


def test_shares_are_exact(spark):
    """0.7 * 90 is 62.99... as doubles."""
    got = asp.asm.three_way_split(spark.range(90), "id").groupBy("part").count().collect()
    assert {r.part: r["count"] for r in got} == {"train": 63, "dev": 13, "test": 14}


def test_replay_needs_no_pairs(spark):
    folds = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "enc long, fold int")
    order = rp.rk.placed(rp.rk.constant(spark.createDataFrame([(0, c) for c in ("A", "B", "C", "D")] + [(1, "C"), (1, "B")], "fold int, cls string")))
    answers = spark.createDataFrame([(1, ["zz", " c9", "b", "C", None]), (3, ["a"])], "enc long, answer array<string>")
    out = rp.rk.replayed(answers, order, folds, 3)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [row_number() windowspecdefinition(enc" not in plan and "LeftAnti" not in plan
    assert sorted(tuple(r) for r in out.collect()) == [(1, "A", 3), (1, "B", 2), (1, "C", 1), (2, "A", 1), (2, "B", 2), (2, "C", 3), (3, "B", 1), (3, "C", 2)]


def test_hybrid_in_rows_is_the_hybrid_of_pairs(spark, monkeypatch):
    """What an encounter's row gives is what the join of all pairs gave, also where the tables are too large for a task."""
    sides = [(e, adm, "CEPS"[(e * (7 if adm else 3) + j) % 4] + str((e + j * j) % 3)) for e in range(60) for adm in (True, False) for j in range(3)]
    s = spark.createDataFrame(sorted({*sides, (99, False, "E1")}), "enc long, adm boolean, cls string")
    f = s.select("enc").distinct().withColumn("fold", (rp.F.col("enc") % 5).cast("int"))
    cond = spark.createDataFrame([(e, c) for e in range(60) for c in ("MBUx", f"N{e % 13:02d}")], "enc long, cond string")
    rules, now = rp.v.rules(spark), rp.rk.before(s)
    base = rp.rk.placed(rp.rk.base_rates(s, f, rp.rk.candidates(s, f)))
    pairs = rp.rk.hybrid_parts(base, rules, cond, s, f)
    top = lambda df: sorted((r.enc, r["rank"], r.cls, round(r.score, 9)) for r in df.collect())
    for most in (rp.rk.TABLE, 0):
        monkeypatch.setattr(rp.rk, "TABLE", most)
        got = rp.rk.hybrid_first_k(base, rules, cond, s, f, 5, (0.0, 0.5))
        for w in (0.0, 0.5):
            want = top(rp.rk.first_k(base, f, now, 5, rp.rk.by_hybrid(pairs, w)))
            assert len(want) > 250 and top(got.where(rp.F.col("weight") == w)) == want


def test_composite_reads_a_name_once(spark):
    names = spark.createDataFrame([("a (b): c",)] * 5 + [("zz",)], "name string")
    forms = spark.createDataFrame([("a", "1"), ("b", "1"), ("q", "2")], "form string, code string")
    out = tp.rs.composite(names, forms)
    assert "Aggregate" in out._jdf.queryExecution().optimizedPlan().toString().split("Generate")[1]
    assert sorted(tuple(r) for r in out.collect()) == [("a (b): c", "resolved", "1"), ("zz", "nil", None)]


def test_rules_join_only_prefixes_that_rules_name(spark):
    drugs = spark.createDataFrame([(1, "E01"), (1, "X11"), (2, "S22")], "enc long, cls string")
    cond = spark.createDataFrame([(1, "MBU"), (2, "N11"), (2, "MAU")], "enc long, cond string")
    out = ap.ru.contra_reasons(drugs, cond, ap.v.contra(spark))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 2
    assert sorted(tuple(r) for r in out.collect()) == [(1, "E01", "contra_1", "forbidden")]


def test_marker_scopes_stay_in_their_row(spark, tmp_path):
    texts = [(1, "it Was a b c d e"), (2, "was and"), (3, "x was a b.c was"), (4, None), (5, "was was a and")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = mp.marker_native(spark, str(tmp_path))
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in out.collect()) == [(1, 1, 4), (2, 0, 0), (3, 1, 1), (3, 4, 0), (5, 0, 2), (5, 1, 1)]
