"""The clinical rules as data (fixed values): indications and contraindications by code prefix."""

from __future__ import annotations

# Fixed values: (target class, condition prefixes, strength, required therapy prefixes, fact that no text gives).
INDICATIONS = (
    ("C09A", ("I50",), "I", (), "ejection fraction"),
    ("C09DX04", ("I50",), "I", (), "symptoms under best therapy"),
    ("C07AB", ("I50",), "I", (), None),
    ("C03DA", ("I50",), "I", (), None),
    ("A10BK", ("I50",), "I", (), None),
    ("C03CA", ("I50",), "I", (), None),
    ("C09C", ("I50",), "IIa", (), None),
    ("B01AF", ("I48",), "I", (), "stroke risk score: age and sex"),
    ("B01AA", ("I48",), "IIa", (), None),
    ("C07AB", ("I48",), "I", (), None),
    ("C01AA", ("I48",), "IIa", (), None),
    ("C01BD", ("I48",), "IIa", (), None),
    ("C09AA", ("I10", "I11", "I12", "I13", "I15"), "I", (), None),
    ("C09CA", ("I10", "I11", "I12", "I13", "I15"), "I", (), None),
    ("C08CA", ("I10", "I11", "I12", "I13", "I15"), "I", (), None),
    ("C03AA", ("I10", "I11", "I12", "I13", "I15"), "I", (), None),
    ("C07AB", ("I10", "I11", "I12", "I13", "I15"), "IIa", (), None),
    ("C10AA", ("I20", "I21", "I22", "I23", "I24", "I25", "I63", "I65", "I66", "I67", "I70", "I73", "E78"), "I", (), None),
    ("C10BA", ("I20", "I21", "I22", "I23", "I24", "I25", "I70", "E78"), "IIa", (), "LDL cholesterol"),
    ("B01AC", ("I20", "I21", "I22", "I23", "I24", "I25", "I63", "I65", "I66", "I70", "I73"), "I", (), None),
    ("C07AB", ("I21", "I22", "I23", "I25.2"), "I", (), None),
    ("C09AA", ("I21", "I22", "I23", "I25.2"), "I", (), None),
    ("A10BK", ("E10", "E11", "E13", "E14"), "I", (), None),
    ("A10BJ", ("E10", "E11", "E13", "E14"), "I", (), None),
    ("A10BA", ("E10", "E11", "E13", "E14"), "IIa", (), None),
    ("A10BK", ("N18",), "I", (), None),
    ("A02BC", (), "IIa", ("B01A",), "bleeding risk"),
)
# Fixed values: (target, condition prefixes, verdict, revoked by, fact that no text gives).
CONTRAINDICATIONS = (
    ("C07", ("J45", "J44"), "to_verify", (), None),
    ("C07", ("I44.1", "I44.2", "I44.3"), "forbidden", ("Z95.0", "Z95"), "pacemaker"),
    ("C08D", ("I50",), "forbidden", (), None),
    ("M01A", ("I50",), "forbidden", (), None),
    ("M01A", ("N18.4", "N18.5"), "forbidden", (), None),
    ("C09", ("O00", "O09", "O10", "O11", "O12", "O13", "O14", "O15", "O16", "O20", "O21"), "forbidden", (), None),
    ("C09", ("I70.1",), "forbidden", (), None),
    ("A10BA02", ("N18.4", "N18.5"), "forbidden", (), None),
    ("B01A", ("I60", "I61", "I62"), "forbidden", (), "recent or remote bleeding"),
    ("C01BD01", ("E05", "E03"), "to_verify", (), None),
    ("C10AA", ("K70", "K71", "K72", "K74"), "to_verify", (), None),
    ("C03A", ("M10",), "to_verify", (), None),
)


def indications(spark):
    """Long form for ranking.by_rules: (rule_id, target, weight, kind, trigger)."""
    from .operators.ranking import WEIGHTS

    rows = [(i, t, WEIGHTS[s], kind, x) for i, (t, conds, s, needs, _) in enumerate(INDICATIONS, 1) for kind, xs in (("cond", conds), ("therapy", needs)) for x in xs]
    return spark.createDataFrame(rows, "rule_id int, target string, weight double, kind string, trigger string")


def contraindications(spark):
    """Long form for rules.contra_reasons: one row per trigger; the shortest revoking prefix."""
    rows = [(i, t, x, v, min(r, key=len) if r else None, m) for i, (t, conds, v, r, m) in enumerate(CONTRAINDICATIONS, 1) for x in conds]
    return spark.createDataFrame(rows, "rule_id int, target string, trigger string, verdict string, revoked string, missing string")


def indication_facts(spark):
    """(rule_id, strength, missing): an indication's class and the fact that no text gives."""
    return spark.createDataFrame([(i, s, m) for i, (_, _, s, _, m) in enumerate(INDICATIONS, 1)], "rule_id int, strength string, missing string")
