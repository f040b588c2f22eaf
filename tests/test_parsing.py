"""Tiers, guards and normal forms on literal strings."""

import pytest
from pyspark.sql import functions as F

from siftwell.functions import text as tx
from siftwell.operators import parsing as pr


def one(spark, f, text):
    return f(spark.createDataFrame([(1, text)], "id int, text string")).orderBy("pos").collect()


@pytest.mark.parametrize(("text", "expected"), [
    ("Rosuvastatina teva: 10 mg cpr /die (ore 21) ; Nebilox: 2,5 mg cpr /die (ore 9) ;", [("Rosuvastatina teva", "1_name_and_dosage"), ("Nebilox", "1_name_and_dosage")]),
    ("Non assume farmaci al domicilio", [(None, "none_declared")]),
    ("250 mg di Aminofillina ratio*6fl 240mg/10ml in 250 ml Fisiologica ;", [("Aminofillina ratio", "2_infusion")]),
    ("Maschera Venturi 28 %, notte ;", [(None, "excluded_not_a_drug")]),
    ("plavix 75 mg, tapazole 5 mg, sivastin 20 mg ;", [(None, "rejected")]),
    ("Torvast 10,5 mg: mezza compressa ;", [("Torvast", "3_name_then_dose")]),
    ("torvast 10,5 mg, triatec 2 mg ;", [(None, "rejected")]),
    ("", []), (None, []),
])
def test_admission(spark, text, expected):
    assert [(r.name, r.tier) for r in one(spark, pr.admission_items, text)] == expected


@pytest.mark.parametrize(("text", "expected"), [
    ('"Torasemide (Diuresix cpr. 10 mg): 10 mg (ore 7)"', ("Torasemide", None, "Diuresix cpr. 10 mg", "1_full")),
    ('"Levotiroxina (tiroxina) (Eutirox cpr. 75 mcg): 75 mcg (ore 7)"', ("Levotiroxina", "tiroxina", "Eutirox cpr. 75 mcg", "2_with_synonym")),
    ('"Evolocumab (Repatha sol. iniett.)"', ("Evolocumab", None, "Repatha sol. iniett.", "4_no_dosage")),
    ('"Nebivololo 5 mg una cp alle 9"', ("Nebivololo", None, None, "6_name_and_dose")),
    ('"Colestiramina (Questran bustine (importato) 4 g): 4 g (ore 12)"', ("Colestiramina", None, "Questran bustine (importato) 4 g", "5_nested_brand")),
    ('"250 ml Glucosata"', (None, None, None, "rejected")),
    ('"Nessun principio attivo (Integratore): 1"', (None, None, None, "excluded_placeholder")),
])
def test_discharge(spark, text, expected):
    r = one(spark, pr.discharge_items, text)[0]
    assert (r.principle, r.synonym, r.brand, r.tier) == expected


def test_brand_root_and_normal_forms(spark):
    df = spark.createDataFrame([("Lasix cpr. 25 mg",), ("Cacit 1000",)], "t string")
    assert [r[0] for r in df.select(tx.brand_root(F.col("t"))).collect()] == ["lasix", "cacit 1000"]
    d = spark.createDataFrame([("  Però, È/là  ", "«Città»  nuova.")], "a string, b string")
    assert tuple(d.select(tx.normal_ascii(F.col("a")), tx.normal_unicode(F.col("b"))).first()) == ("per /l", "«città» nuova")


def test_allergies_have_three_states(spark):
    rows = [(1, "Anamnesi remota"), (2, "Allergie e intolleranze: Allergie e intolleranze non note"), (3, "Allergie e intolleranze: Allergie: Principi attivi (Xantolide, Beta) Alimenti (uova) Terapia: x"), (4, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    assert {r.id: r.state for r in pr.allergy_section(df).collect()} == {1: "section_absent", 2: "none_declared", 3: "present", 4: "section_absent"}
    known = spark.createDataFrame([("xantolide", "C01")], "form string, code string")
    assert {(r.allergen, r.code) for r in pr.allergy_values(df, known).collect()} == {("Xantolide", "C01"), ("Beta", None), ("uova", None)}


def test_echo(spark):
    got = one(spark, pr.questionnaire_echo, "Ipertensione arteriosa si. Obesita no.")
    assert [(r.term, r.polarity) for r in got] == [("ipertensione arteriosa", "si"), ("obesita", "no")]


def test_terminology(spark):
    lines = [
        "   Capitolo I - Malattie infettive", " A00         Colera (A09)", "             Incl.: colera:", "                    \u2022 asiatico               grave", "                    \u2022 (lieve)", "             forma senza punto",
        "             utilizzare un codice ulteriore", "             se noto", "             Escl.: altro morbo (A05.1)", "A00.1        Colera da vibrione\u2020", "             Incl.: tifo asiatico;", " A00         Colera di nuovo",
        "             Incl.: secondo elenco", "1 Centro Collaboratore", " A01         Febbre", "             Incl.: sotto:", "                    \u2022 nido:", "                    \u2022 uovo",
    ]
    rows = {r.code: r for r in pr.terminology_blocks(spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")).collect()}
    a = rows["A00"]
    assert (a.level, a.chapter, a.title) == ("category", "I - Malattie infettive", "Colera")
    assert a.included == ["colera asiatico grave", "colera (lieve) grave", "forma senza punto", "secondo elenco"] and a.excluded == ["altro morbo"]
    assert (rows["A00.1"].level, rows["A00.1"].title, rows["A00.1"].included) == ("subcategory", "Colera da vibrione", ["tifo asiatico"])
    assert rows["A01"].included == ["sotto nido uovo"]
