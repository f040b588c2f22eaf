"""Intervals, cascades, scopes, rules, metrics, sources and the stream on small cases."""

import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell import api, rules_data
from siftwell.operators import alignment as al
from siftwell.operators import assembly as asm
from siftwell.operators import evaluation as ev
from siftwell.operators import intervals as iv
from siftwell.operators import ranking as rk
from siftwell.operators import resolve as rs
from siftwell.operators import rules as ru
from siftwell.operators import scopes as sc
from siftwell.sources import records as rec
from siftwell.sources import registers

MENTIONS = "enc long, field string, agent string, kind string, start long, end long, code string, state string, subject string"


def mentions(spark, spans):
    return spark.createDataFrame([(1, "F", a, "condition", s, e, None, "affirmed", "patient") for a, s, e in spans], MENTIONS)


@pytest.mark.parametrize(("spans", "expected"), [
    ([("A", 0, 5), ("B", 10, 15)], [("A", False), ("B", False)]), ([("A", 0, 10), ("B", 5, 15)], [("AB", False)]), ([("A", 0, 5), ("B", 5, 10)], [("A", False), ("B", False)]),
    ([("A", 0, 5), ("A", 8, 12), ("B", 0, 20)], [("AB", True)]), ([("A", 0, 6), ("B", 4, 12), ("C", 10, 16)], [("ABC", False)]),
])
def test_groups(spark, spans, expected):
    assert [(r.agents, r.ambiguous) for r in al.group_table(al.groups(mentions(spark, spans))).orderBy("start").collect()] == expected


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), min_size=1, max_size=25), st.booleans())
def test_merge_equals_a_sweep(spark, spans, touching):
    rows = [(i, s, s + n) for i, (s, n) in enumerate(spans)]
    want, reach = [], None
    for _, s, e in sorted(rows, key=lambda r: (r[1], r[2])):
        if reach is None or (s > reach if touching else s >= reach):
            want.append([s, e])
        else:
            want[-1][1] = max(want[-1][1], e)
        reach = want[-1][1]
    got = iv.merged(spark.createDataFrame(rows, "i int, start int, end int").withColumn("k", F.lit(1)), ["k"], "start", "end", ["i"], touching)
    assert [[r.start, r.end] for r in got.orderBy("start").collect()] == want


def test_longest_wins_and_greedy(spark):
    df = spark.createDataFrame([(1, 0, 10, "a"), (1, 5, 8, "b"), (1, 10, 12, "c"), (1, 0, 10, "z")], "k int, start int, end int, label string")
    assert sorted((r.start, r.label) for r in iv.longest_wins(df, ["k"]).collect()) == [(0, "a"), (10, "c")]
    g = spark.createDataFrame([(1, 0, 5), (1, 3, 9)], "k int, start long, end long")
    f = spark.createDataFrame([(1, 2, 6)], "k int, start long, end long")
    assert sorted((r.gold_start, r.found_start) for r in iv.greedy_matches(g, f, ["k"]).collect()) == [(0, 2), (3, None)]


def test_drug_cascade(spark):
    sub = [("bisoprololo", "C07AB07"), ("rosuvastatina e ezetimibe", "C10BA06"), ("rosuvastatina amlodipina e lisinopril", "C10BX07"), ("warfarin", "B01AA03"), ("enoxaparina sodica", "B01AB05"), ("pantoprazolo", "A02BC02"), ("ferroso gluconato", "B03AA03")]
    brands = [("pantoprazolo sandoz", "A02BC02"), ("congescor", "C07AB07"), ("lyrica", "N02BF02"), ("lyrica", "N03AX16")]
    names = ["Bisoprololo", "Rosuvastatina/ezetimibe", "Rosuvastatina/amlodipina/lisinopril", "Congescor", "pantoprazolo sand", "Warfarin sodico", "Enoxaparina", "lyrica", "ignoto", "Ferroso solfato"]
    f = "form string, code string"
    got = {r.name: (r.status, r.code, r.method) for r in rs.drug_cascade(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(sub, f), spark.createDataFrame(brands, f)).collect()}
    assert got == {
        "Bisoprololo": ("resolved", "C07AB07", "exact_substance"), "Rosuvastatina/ezetimibe": ("resolved", "C10BA06", "association"), "Rosuvastatina/amlodipina/lisinopril": ("resolved", "C10BX07", "association"),
        "Congescor": ("resolved", "C07AB07", "brand"), "pantoprazolo sand": ("resolved", "A02BC02", "abbreviated_brand"), "Warfarin sodico": ("resolved", "B01AA03", "salt_suffix"),
        "Enoxaparina": ("resolved", "B01AB05", "salt_form"), "lyrica": ("ambiguous", None, "brand"), "ignoto": ("nil", None, None), "Ferroso solfato": ("nil", None, None),
    }


def covered(text, word):
    at = text.lower().index(word.lower())
    return {a for s, e, a, _ in sc.scopes(text) if s <= at and at + len(word) <= e}


def test_scopes():
    assert covered("Versamento pericardico assente.", "Versamento pericardico") == {sc.NEGATION}
    assert covered("Ipertensione arteriosa ben compensata dai farmaci.", "Ipertensione") == set()
    assert covered("Nega diabete ma riferisce ipertensione.", "diabete") == {sc.NEGATION} and covered("Nega diabete ma riferisce ipertensione.", "ipertensione") == set()
    assert covered("Pregressa ischemia. Angina.", "Angina") == set()
    text = "Familiarita per cardiopatia ischemica (padre). Diabete."
    (s, e, _), = sc.family_scopes(text)
    assert text[s:e] == " cardiopatia ischemica (padre)"
    assert sc.family_scopes("la madre riferisce") == [] and len(sc.family_scopes("Madre deceduta per ictus")) == 1


def test_segments_and_bio():
    text = "Uno due. Tre quattro cinque. Sei."
    parts, lost = sc.segments(text, [(9, 12, "X"), (25, 31, "Y")], 10)
    assert [t for _, t, _ in parts] == ["Uno due. Tre quattro cinque.", " Sei."] and lost == 2 and parts[0][2] == [(9, 12, "X")]
    assert sc.safe_cuts("Sig. R. Rossi; dott. B. qui! fine.\nSi") == [4, 14, 20, 28, 34, 35]
    assert sc.segments("corto. " * 3, [], 1000)[0] == [(0, "corto. " * 3, [])]
    spans = [(9, 20, "X")]
    assert sc.from_bio(text, sc.to_bio(text, spans)) == spans
    assert sc.from_bio("a b", ["I-X", "O"]) == [] and sc.occurrences("TVS e TVSostenuta", "TVS") == [(0, 3)]


def test_rules(spark):
    d = spark.createDataFrame([(1, "C07AB07"), (1, "N06AX11"), (2, "C07AB07"), (3, "C07AB07"), (1, "C09AA05")], "enc int, cls string")
    al_ = spark.createDataFrame([(1, "N06AX11"), (1, "C09AA01")], "enc int, cls string")
    cond = spark.createDataFrame([(1, "I44.2"), (2, "J45.0"), (3, "I44.2"), (3, "Z95.0")], "enc int, cond string")
    th = spark.createDataFrame([(2, "C07AB02")], "enc int, cls string")
    got = {(r.enc, r.cls): (r.verdict, r.reasons) for r in ru.verdicts(d, ru.all_reasons(d, al_, th, cond, rules_data.contraindications(spark))).collect()}
    assert got[1, "N06AX11"] == ("forbidden", "allergy_exact") and got[1, "C09AA05"] == ("to_verify", "allergy_group")
    assert got[1, "C07AB07"][0] == "to_verify"  # forbidden, but the pacemaker is unknown
    assert got[3, "C07AB07"] == ("allowed", "") and got[2, "C07AB07"] == ("to_verify", "contra_1,duplicate_group")


def test_symbolic_ranking(spark):
    ind = rules_data.indications(spark)
    assert len(rules_data.INDICATIONS) == 27 and len(rules_data.CONTRAINDICATIONS) == 12
    cond = spark.createDataFrame([(1, "I50.9"), (2, "I48")], "enc int, cond string")
    sides = spark.createDataFrame([(2, True, "B01AC")], "enc int, adm boolean, cls string")
    classes = ("C09AA", "C07AB", "C03DA", "A10BK", "B01AA", "B01AF", "A02BC")
    grid = spark.createDataFrame([(e, c) for e in (1, 2) for c in classes], "enc int, cls string")
    got = {(r.enc, r.cls): r.score for r in rk.by_rules(grid, ind, cond, sides).collect()}
    assert [got[1, c] for c in ("C09AA", "C07AB", "C03DA", "A10BK")] == [1.0] * 4 and (1, "B01AF") not in got
    assert got[2, "B01AF"] > got[2, "B01AA"] and got[2, "A02BC"] == 0.6 and (1, "A02BC") not in got
    folds, cands = spark.createDataFrame([(1, 0), (2, 0)], "enc int, fold int"), spark.createDataFrame([(0, c) for c in classes], "fold int, cls string")
    own = rk.by_rules_of_fold(cands, folds, ind, cond, sides)
    assert {(r.enc, r.cls): r.score for r in own.collect()} == got
    # the first of each order equal those of the whole grid
    now = spark.createDataFrame([(1, "C07AB")], "enc int, cls string")
    for k in (1, 3, 7):
        top = {(r.enc, r.cls): r.rank for r in rk.first_k(rk.placed(rk.constant(cands)), folds, now, k, own).collect()}
        want = {}
        for e in (1, 2):
            order = sorted((c for c in classes if (e, c) != (1, "C07AB")), key=lambda c: (-got.get((e, c), 0.0), c))
            want |= {(e, c): i for i, c in enumerate(order[:k], 1)}
        assert top == want


def test_worked_example(spark):
    before = "A02BC01 B01AC06 B05BA10 C09AA05 C10BA06".split()
    new = "A02BC02 B01AC04 C07AB07 C03CA01 B01AX06".split()
    truth = "A02BC02 B01AA03 B01AC06 C03CA01 C03DA04 C07AB07 C08CA01 C09AA05 C10BA06".split()
    df = lambda x: spark.createDataFrame([(1, c) for c in x], "enc int, cls string")
    got = {r.level: (r.np, r.nt, r.nh) for r in ev.hierarchical(df(before + new), df(truth)).collect()}
    assert got == {1: (3, 3, 3), 3: (7, 7, 6), 4: (7, 8, 6), 5: (8, 9, 6), 7: (10, 9, 6)}


def test_metrics(spark):
    c = spark.createDataFrame([(2, 2, 1), (0, 3, 0), (0, 0, 0)], "np int, nt int, nh int")
    assert [(r.precision, r.recall, r.f1) for r in ev.prf(c).collect()] == [(0.5, 0.5, 0.5), (0, 0, 0), (0, 0, 0)]
    fold = spark.range(1).select(ev.hash_fold(F.lit(9764312))).first()[0]
    assert fold == int(hashlib.sha256(b"20260915:9764312").hexdigest()[:8], 16) % 5 == 1
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "enc int, cls string, rank int")
    target = spark.createDataFrame([(1, "a"), (1, "c")], "enc int, cls string")
    assert abs(ev.average_precision(ranked, target).first().ap - (1 + 2 / 3) / 2) < 1e-12


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.sampled_from(["A01AA", "A01AB", "B02CC", "C03DD", "C03DE"])), st.sets(st.sampled_from(["A01AA", "A01AC", "B02CC", "C03DE"]), min_size=1))
def test_hierarchical_f1_never_falls_towards_the_root(spark, p, t):
    df = lambda x: spark.createDataFrame([(1, c) for c in x], "enc int, cls string")
    f = {r.level: r.nh for r in ev.hierarchical(df(p), df(t), (1, 5)).collect()}
    assert f[5] == len(p & t) and f[1] == len({x[0] for x in p} & {x[0] for x in t})


def test_records_and_anomalies(spark, tmp_path):
    sec = lambda t, x, o=1: {"tipo": t, "data": "d", "reportOid": o, "testo": x}
    a, b = rec.TYPES[:2]
    data = [
        {"encOid": 1, "referti": [sec(a, "prosa"), sec(b, "x: 1"), sec(rec.TYPES[2], '"y (Z): 1"')]}, {"encOid": 1, "referti": [sec(a, "altra")]},
        {"encOid": 2, "referti": [sec(a, 5), sec(b, " "), sec("Altro", "q")]}, {"encOid": 3, "referti": [sec(a, "sola")]},
    ]
    path = tmp_path / "r.json"
    path.write_text(json.dumps(data))
    raw = rec.raw_records(spark, str(path))
    r = rec.records(raw)
    assert {(x.enc_oid, x.testo) for x in rec.section(r, a).collect()} >= {(1, "prosa"), (3, "sola")}
    got = {(x.enc_oid, x.kind) for x in rec.anomalies(raw).collect()}
    assert got == {(1, "duplicate_id"), (2, "text_not_a_string"), (2, "blank_text"), (2, "unexpected_type"), (3, "missing_section")}


def test_turtle_and_sinks(spark, tmp_path):
    t = rec.read_turtle('@prefix k: <http://k/> .\nk:r1 a k:Rule ;\n  k:atc "C07" ;\n  k:icd "J45", "J44" .\n<http://k/r2> k:atc "C08D" .\n')
    assert ("k:r1", "k:icd", "J44") in t and ("http://k/r2", "k:atc", "C08D") in t and len(t) == 5
    df = spark.createDataFrame(t, "s string, p string, o string")
    assert rec.rules_from_triples(df).where("s = 'k:r1'").first().facts["k:icd"] == ["J44", "J45"]
    rec.write_triples(df, str(tmp_path / "nt"))
    rec.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "nt")).count() == 5 == spark.read.option("header", True).csv(str(tmp_path / "csv")).count()
    (tmp_path / "reg.csv").write_text("﻿codice;nome\nC07AB07;Congescor\nX;Corto\n", encoding="utf-8")
    reg = rec.registry(spark, str(tmp_path / "reg.csv"), spark.read.option("header", True).option("sep", ";").csv(str(tmp_path / "reg.csv")).columns[0], "nome", 7)
    assert [(r.name, r.codes) for r in reg.collect()] == [("congescor", ["C07AB07"])]


def test_registers(spark, tmp_path):
    p = str(tmp_path / "runs")
    assert registers.open_run(spark, p, "r", "a=1") and not registers.open_run(spark, p, "r", "a=1")
    with pytest.raises(ValueError):
        registers.open_run(spark, p, "r", "a=2")
    req = spark.createDataFrame([("q1",), ("q2",)], "prompt string")
    mark = req.where("prompt = 'q1'").select(registers.fingerprint(F.struct("prompt"))).first()[0]
    cache = spark.createDataFrame([(mark, "m", '{"a": 1}')], "fingerprint string, model string, response string")
    ok, errors = registers.replay(req, cache, "a int")
    assert ok.first().parsed.a == 1 and errors.first().error == "no response"


def test_api(spark):
    sections = rec.record_of(spark, "Nega diabete. Scompenso cardiaco noto.", "Lasix: 25 mg ;")
    cond = spark.createDataFrame([("diabete", "E11"), ("scompenso cardiaco", "I50.9")], "form string, code string")
    drugs = spark.createDataFrame([("lasix", "C03CA01")], "form string, code string")
    m = api.mentions_of(sections, cond, drugs).cache()
    assert {(r.code, r.state) for r in m.collect()} == {("E11", "negated"), ("I50.9", "affirmed"), ("C03CA01", "affirmed")}
    none = spark.createDataFrame([], "enc long, cls string")
    cands = spark.createDataFrame([("C09AA",), ("C03CA",), ("C08DA",), ("N02BE",)], "cls string")
    got = api.propose(spark, m, none, cands, 3).orderBy("rank").collect()
    assert [r.cls for r in got] == ["C09AA", "N02BE"]  # C03CA is taken already, C08D is forbidden
    rx = spark.createDataFrame([(0, "C08DA01"), (0, "bad"), (0, "Z99")], "enc long, cls string")
    reg = spark.createDataFrame([("C08DA01",)], "code string")
    facts = m.where("kind = 'condition' and state = 'affirmed'").select("enc", F.col("code").alias("cond"))
    assert {(r.cls, r.verdict) for r in api.verify(spark, rx, reg, facts, none, none).collect()} == {("C08DA01", "forbidden"), ("bad", "rejected"), ("Z99", "rejected")}
    assert api.statistics(m).count() == 2


def test_ranks_without_the_grid(spark):
    order = rk.placed(spark.createDataFrame([(0, c, float(s)) for c, s in zip("abcdef", (1, 5, 5, 2, 0, 9))], "fold int, cls string, score double"))
    folds = spark.createDataFrame([(1, 0), (2, 0)], "enc int, fold int")
    now = spark.createDataFrame([(1, "f"), (1, "c"), (2, "zz")], "enc int, cls string")
    targets = spark.createDataFrame([(1, "a"), (1, "b"), (2, "e"), (2, "q")], "enc int, cls string")
    assert {(r.enc, r.cls): r.rank for r in rk.ranks_of(targets, order, folds, now).collect()} == {(1, "b"): 1, (1, "a"): 3, (2, "e"): 6}


def test_gold_and_conversion(spark):
    texts = spark.createDataFrame([(1, "episodio di FA oggi, assenza di FA. TVS e TVSostenuta"), (2, "niente")], "enc long, text string")
    a = [(1, "condition", "FA", "affirmed", "patient", None), (1, "condition", "FA", "negated", "patient", 2), (1, "condition", "TVS", "affirmed", "patient", None), (2, "condition", "FA", "affirmed", "patient", None), (3, "condition", "x", "affirmed", "patient", None), (1, "condition", "FA", "affirmed", "patient", 3)]
    got = asm.gold_spans(spark.createDataFrame(a, "enc long, kind string, text string, state string, subject string, nth int"), texts).collect()
    assert {(r.enc, r.start, r.quote, r.state) for r in got if r.problem is None} == {(1, 12, "FA", "affirmed"), (1, 32, "FA", "affirmed"), (1, 32, "FA", "negated"), (1, 36, "TVS", "affirmed")}
    assert {r.problem for r in got if r.problem} == {"not in the text", "record absent", "too few occurrences"}


def test_schemas_and_reports(spark, tmp_path):
    raw = {"$defs": {"S": {"type": "object", "title": "S", "properties": {"a": {"type": "string", "default": "x"}}}}, "type": "object", "title": "T", "properties": {"one": {"$ref": "#/$defs/S"}, "many": {"type": "array", "items": {"$ref": "#/$defs/S"}, "maxItems": 60}}}
    flat = asm.flat_schema(raw)
    assert "$defs" not in flat and flat["required"] == ["one", "many"] and flat["properties"]["many"]["items"] == {"type": "object", "properties": {"a": {"type": "string"}}}
    strict = asm.strict_schema(flat)
    assert strict["additionalProperties"] is False and strict["properties"]["one"]["required"] == ["a"] and strict["properties"]["many"]["maxItems"] == 60
    df = spark.createDataFrame([(1, "a", [1.5], {"k": True})], "id long, name string, xs array<double>, m map<string,boolean>")
    js = asm.json_schema(df.schema)
    assert js["properties"] == {"id": {"type": "integer"}, "name": {"type": "string"}, "xs": {"type": "array", "items": {"type": "number"}}, "m": {"type": "object", "additionalProperties": {"type": "boolean"}}}
    assert asm.report(df.select("id", "name"), "two columns").splitlines() == ["two columns", "id  name", "--  ----", "1   a"]
    rec.write_manifest(spark, str(tmp_path / "m"), [{"name": "x", "rows": 3}, {"name": "y", "rows": 4}])
    assert [json.loads(r.value)["rows"] for r in spark.read.text(str(tmp_path / "m")).orderBy("value").collect()] == [3, 4]
    (tmp_path / "f.bin").write_bytes(b"abc")
    r = registers.file_fingerprints(spark, str(tmp_path / "f.bin")).first()
    assert r.length == 3 and r.sha256 == hashlib.sha256(b"abc").hexdigest()
    with pytest.raises(ValueError):
        asm.sampled(df.select("id"), "id", None, only=[1, 2])
    assert asm.sampled(spark.range(100), "id", 10).count() == 10


def test_state_files_without_service_files(spark, tmp_path):
    for name, enc in (("7.json", 7), ("_registro.json", 9)):
        (tmp_path / name).write_text(json.dumps({"enc": enc, "conditions": [{"start": 1, "code": "I10"}, {"start": None, "code": "I11"}], "drugs": []}, indent=1))
    schema = "enc long, conditions array<struct<start:int,code:string>>, drugs array<struct<start:int,code:string>>"
    got = rec.flattened(rec.states(spark, str(tmp_path), "A", schema)).collect()
    assert [(r.enc, r.agent, r.kind, r.code) for r in got] == [(7, "A", "condition", "I10")]
    (tmp_path / "gold.json").write_text(json.dumps({"7": {"condition": [["FA", "affirmed", "patient"], ["FA", "negated", "patient", "2"]]}}))
    assert {(r.enc, r.text, r.state, r.nth) for r in rec.gold(spark, str(tmp_path / "gold.json")).collect()} == {(7, "FA", "affirmed", None), (7, "FA", "negated", 2)}


def test_stream(spark, tmp_path):
    from siftwell.streaming import records as sr

    (tmp_path / "in").mkdir()
    line = lambda i, a: json.dumps({"enc_oid": i, "arrived": "2024-01-01T00:00:00Z", "admission": a, "discharge": ""})
    (tmp_path / "in" / "a.json").write_text(line(1, "Lasix: 25 mg ;") + "\n" + line(1, "Lasix: 25 mg ;") + "\n" + line(2, "x, y 3 ;") + "\n")
    q = sr.drug_stream(sr.record_stream(spark, str(tmp_path / "in"))).writeStream.foreachBatch(sr.upsert(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.enc_oid, r.name, r.tier) for r in sr.latest(spark, str(tmp_path / "out")).collect()} == {(1, "Lasix", "1_name_and_dosage"), (2, None, "rejected")}
