"""Documents are checked by every statement that they make."""

from __future__ import annotations

import pytest

from kgloom.plans import pipelines
from kgloom.providers import functions as pf
from kgloom.providers.offline import statements
from kgloom.providers.registry import get_provider

RULES = "rule_id string, subject_type string, object_type string, attribute string, operator string, value string, unit string, plain_english string"


def _stated(text, attribute="mass"):
    return [(x["thing"], x["value"]) for x in statements(text, attribute)]


def test_every_statement_of_a_document_has_a_verdict(spark, rows):
    r = spark.createDataFrame([("one", "Pump", None, "massKg", ">", "5", "kg", "not heavy"), ("two", "Rocket", "Battery", "charge", "<", "2", None, "full"), ("none", "Pump", None, "colour", "==", "red", None, "not red")], RULES)
    text = "Pump A has a mass kg of 3 and Pump B 9.\nPump_C: massKg is 7 [T-003].\nRocket X carries Battery P-1 whose charge is 1."
    texts = spark.createDataFrame([("d", text)], "doc_id string, text string")
    got = pipelines.check_rules(r, texts=texts, factory=get_provider)
    first, second, third = text.split(" [T-003].\n")[0].split("\n")[0], "Pump_C: massKg is 7 [T-003].", "Rocket X carries Battery P-1 whose charge is 1."
    assert set(rows(got, "rule_id", "subject", "object", "value", "violated", "doc_id", "quote")) == {
        ("one", "Pump A", None, "3", False, "d", first), ("one", "Pump B", None, "9", True, "d", first), ("one", "Pump_C", None, "7", True, "d", second),
        ("two", "Rocket X", "Battery P-1", "1", True, "d", third), ("none", None, None, None, False, "d", None),
    }


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("The mass is 1 kg. The mass is 9 kg.", [(None, "1"), (None, "9")]),
        ("The masses of Pump A, Pump B and Tank C are 3, 4 and 9 kg.", [("Pump A", "3"), ("Pump B", "4"), ("Tank C", "9")]),
        ("Pump A (3 kg mass) and Tank B (9 kg mass).", [("Pump A", "3"), ("Tank B", "9")]),
        ("The mass of Pump A at launch is 9 kg.", [("Pump A", "9")]),
        ("The mass is 3 kg and the pressure is 9 bar.", [(None, "3")]),
        ("Pump 2 has a mass of 1,200 kg, P-12 a mass of 3-5 kg.", [("Pump 2", "1200"), ("P-12", "3"), ("P-12", "5")]),
        ("The mass of Pump A is 3 kg; Pump B weighs 9 kg.", [("Pump A", "3"), ("Pump B", "9")]),
        ("3.5 kg is the mass of Pump A.", [("Pump A", "3.5")]),
        ("Nothing of mass.", []),
    ],
)
def test_statements_of_sentences(text, want):
    assert _stated(text) == want


def test_no_rule_is_dropped_however_many(spark):
    n = 100_001
    r = spark.range(n).selectExpr("concat('r', id) AS rule_id", "'Pump' AS subject_type", "CAST(NULL AS STRING) AS object_type", "'mass' AS attribute")
    docs = spark.createDataFrame([("d", "The mass is 3.5 kg.")], "doc_id string, text string")
    got = pf.check_documents(r, docs, get_provider)
    assert got.where("value = '3.5'").select("rule_id").distinct().count() == n
