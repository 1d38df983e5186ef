"""Whole workloads on small inputs."""

from __future__ import annotations

import pyspark.sql.functions as F
import pytest

from kgloom.functions import render
from kgloom.functions.lexical import OWL, RDF_TYPE
from kgloom.operators import graph
from kgloom.plans import pipelines
from kgloom.providers import get_provider

NS = "urn:k#"
RAW = "id string, source_path string, source_format string, source_sha256 string, markdown string, page_map array<struct<char_start:int,char_end:int,page:int>>"


def _raw(spark):
    return spark.createDataFrame([("d1", "/d1", "md", "s1", "# Pumps\nThe Main Pump has mass of 3.5 kg here.\n# More\nMain_Pump is near MainPump2, and mass of 4 kg.\n", None)], RAW)


def _source(spark):
    s = NS + "The_Main_Pump"
    rows = [(s, RDF_TYPE, OWL + "NamedIndividual", "iri"), (s, RDF_TYPE, NS + "Pump", "iri"), (s, NS + "the_main_pump_has_mass", "3.5", "literal"), (NS + "Pump", RDF_TYPE, OWL + "Class", "iri")]
    return spark.createDataFrame([(a, "iri", b, c, k, None, None) for a, b, c, k in rows], graph.TRIPLE)


def test_ingest_and_reconstruct(spark, rows):
    made = pipelines.ingest(_raw(spark), get_provider, NS, ["Pump"])
    assert made["chunks"].count() == 2 and made["entities"].count() == 2
    assert rows(made["entities"], "ord") == [(i,) for i in range(made["entities"].count())]
    got = pipelines.reconstruct(_source(spark), _raw(spark), get_provider, NS, ["Pump"])
    arms = {(r["arm"], r["level"]): r for r in got["arms"].collect()}
    assert arms["pipeline", "individuals"]["recovered"] == 1 and set(a for a, _ in arms) == {"pipeline", "direct"}
    assert {r["side"] for r in got["debug"].collect()} <= {"recovered", "missed", "extra"} and got["winner"].count() == 1


def test_review_and_working_graph(spark, rows):
    d = pipelines.sample_delta(spark).withColumn("status", F.lit("proposed"))
    ids = [r["id"] for r in d.orderBy("ord").collect()]
    reviews = spark.createDataFrame([(1, ids[0], "approve", None, None), (1, ids[1], "reject", None, "no"), (1, ids[2], "reject", None, None), (2, ids[2], "edit", "19", "typo"), (1, ids[3], "skip", None, None)], "ord int, id string, action string, new_object string, note string")
    got = {r["id"]: r for r in pipelines.review(d, reviews).collect()}
    assert [got[i]["status"] for i in ids] == ["approved", "rejected", "approved", "proposed", "proposed"] and got[ids[2]]["o"] == "19"
    g = pipelines.working_graph(_source(spark).where(F.col("o") == OWL + "Class"), pipelines.approve(d))
    assert g.count() == 6 and pipelines.working_graph(graph.empty_graph(spark), d).count() == 0
    assert pipelines.working_graph(g, d, g).count() == 6
    assert rows(pipelines.locals_under(_source(spark), NS)) == [("The_Main_Pump",)]


def test_graph_hash_is_that_of_the_set(spark):
    g = _source(spark)
    h = lambda x: pipelines.graph_hash(x).first()[0]
    assert h(g) == h(g.unionAll(g).orderBy(F.desc("o"))) != h(g.limit(2)) and h(g.limit(0))


def test_numbers_are_consecutive(spark, rows):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("x"))
    assert rows(pipelines.numbered(df, "x").where("x <> ord")) == [] and pipelines.numbered(df.limit(0), "x").count() == 0


def test_document_arm_and_agreement(spark, rows):
    schema = "rule_id string, subject_type string, object_type string, attribute string, operator string, value string, unit string, plain_english string"
    r = spark.createDataFrame([("r1", "Pump", None, "mass", ">", "3", "kg", "not too heavy"), ("r2", "Pump", None, "colour", "==", "red", None, "not red")], schema)
    texts = spark.createDataFrame([("d", "The mass is 3.5 kg.")], "doc_id string, text string")
    got = pipelines.check_rules(r, _source(spark), texts, get_provider)
    assert rows(got.where("arm = 'document'"), "rule_id", "value", "violated") == [("r1", "3.5", True), ("r2", None, False)]
    with pytest.raises(ValueError):
        pipelines.check_rules(r)
    with pytest.raises(ValueError):
        pipelines.check_document_rules(r.withColumn("plain_english", F.lit(" ")), texts, get_provider)
    changes = spark.createDataFrame([("s", NS + "The_Main_Pump", NS + "colour", "red")], "scenario_id string, s string, p string, new_value string")
    truth = spark.createDataFrame([("s", "r2")], "scenario_id string, rule_id string")
    out = pipelines.analyze_impact(r, _source(spark), changes, truth, texts, get_provider)
    assert rows(out["winners"]) == [("s", "ontology")] and rows(out["baseline"]) == [("document", "r1")]


def test_conflicts(spark, rows):
    found = spark.createDataFrame([("r", "A", "The_Main_Pump", "the_main_pump_has_mass", ">", "3"), ("q", "A", "Nobody", "x", ">", "1")], "rule_id string, subject string, object string, attribute string, operator string, value string")
    c = pipelines.detect_conflicts(_source(spark), NS, found)
    assert rows(c, "ix", "conflict_type") == [(0, "the_main_pump_has_mass_>_threshold")]
    r = spark.createDataFrame([("r", 0, "A", "Pump", "the_main_pump_has_mass", True)], "rule_id string, ord int, subject_type string, object_type string, attribute string, expected_violated boolean")
    out = pipelines.score_conflicts(c, r)
    assert rows(out["prf"], "tp", "fp", "fn") == [(1, 0, 0)] and out["unmatched"].count() == 0


def test_texts(spark):
    bags = spark.createDataFrame([("urn:k#B", {"m": "1", "rdf_type": "X", "a": "2"}), ("urn:k#A", {})], "s string, props map<string,string>")
    assert render.blocks_text(bags).first()[0] == "* A\n* B\n  - a: 2\n  - m: 1"
    s = spark.createDataFrame([("class", "C", None), ("datatype", "m", "decimal"), ("object", "on", None)], "kind string, local_name string, range_local string")
    assert render.tbox_block(s).first()[0] == "Classes: C\nObject properties: on\nDatatype properties: m (decimal)"
    assert spark.range(1).select(render.self_check_line(F.lit(1), F.lit(4), F.lit(0.25))).first()[0] == "1 of 4 facts found (25.0 %)"


def test_rules_are_discovered_in_bounded_batches(spark, rows):
    from kgloom.providers import functions as pf

    bags = [(f"{NS}P{i}", {"rdf_type": "Pump", "mass": str(10 + i % 3)}) for i in range(40)] + [(NS + "Odd", {"rdf_type": "Pump", "mass": "900"}), (NS + "None", {}), (NS + "Text", {"rdf_type": "Pump", "mass": "heavy"})]
    df = spark.createDataFrame(bags, "s string, props map<string,string>")
    got = rows(pf.discover_rules(df, get_provider), "subject", "attribute", "operator")
    assert got == [("Odd", "mass", ">")]
    assert rows(pf.discover_rules(df, get_provider, batch=3)) == []  # a batch is too small to say what is usual
    assert rows(pf.discover_rules(df.limit(0), get_provider)) == []


def test_conflicts_of_both_arms(spark, rows):
    texts = spark.createDataFrame([("d", "All is well. The Main Pump exceeded the mass limit of 3 kg."), ("e", ""), ("f", "Nothing here.")], "doc_id string, text string")
    found = spark.createDataFrame([("r", "A", "The_Main_Pump", "the_main_pump_has_mass", ">", "3")], "rule_id string, subject string, object string, attribute string, operator string, value string")
    got = pipelines.find_conflicts(get_provider, _source(spark), NS, texts, found)
    assert rows(got, "arm", "subject", "object", "conflict_type") == [("document", "Main Pump", "mass limit", "exceeded"), ("ontology", "A", "The_Main_Pump", "the_main_pump_has_mass_>_threshold")]
    assert pipelines.find_conflicts(get_provider, texts=texts).count() == 1
    with pytest.raises(ValueError):
        pipelines.find_conflicts(get_provider)


def _tbox(spark):
    from kgloom.functions.lexical import RDFS, XSD

    rows_ = [("Pump", RDF_TYPE, OWL + "Class"), ("level", RDF_TYPE, OWL + "DatatypeProperty"), ("level", RDFS + "range", XSD + "integer"), ("on", RDF_TYPE, OWL + "ObjectProperty")]
    return spark.createDataFrame([(NS + s, "iri", p, o, "iri", None, None) for s, p, o in rows_], graph.TRIPLE)


def test_entries_that_the_schema_contradicts(spark, rows):
    xsd = "http://www.w3.org/2001/XMLSchema#"
    data = [("1", "level", "3", xsd + "integer", "approved"), ("2", "level", "three", xsd + "integer", "approved"), ("3", "on", "x", xsd + "string", "approved"), ("4", "on", NS + "P", None, "approved"), ("5", "new", "x", None, "approved"), ("6", "level", "three", None, "rejected"), ("7", "level", "", None, "approved")]
    e = spark.createDataFrame([(i, NS + "P", NS + p, o, d, None, s) for i, p, o, d, s in data], "id string, s string, p string, o string, o_datatype string, o_lang string, status string")
    assert rows(pipelines.invalid(e, _tbox(spark)), "id") == [("2",), ("3",), ("7",)]
    assert rows(pipelines.invalid(e.limit(0), _tbox(spark))) == []


def test_the_whole_workload(spark, rows):
    schema = "rule_id string, subject_type string, object_type string, attribute string, operator string, value string, unit string"
    r = spark.createDataFrame([("r1", "Pump", None, "the_main_pump_has_mass", ">", "3", "kg")], schema)
    made = pipelines.run(_raw(spark), _tbox(spark), get_provider, NS, r)
    assert made["graph"].count() > 4 and made["rejected"].count() == 0 and {x[0] for x in rows(made["verdicts"], "violated")} <= {True, False}


def test_sections_by_a_provider(spark, rows):
    from kgloom.operators import synthesis

    d = pipelines.sample_delta(spark)
    anchors = synthesis.anchor_map(d.select("id"))
    got = synthesis.ask_sections(d, anchors, get_provider)
    assert {r["title"]: len(r["paragraphs"]) for r in got.collect()} == {"Orbiter": 2, "Tank A": 3}

    class Forgetful:
        name = "forgetful"

        def complete(self, request):
            from kgloom.providers.base import Response

            return Response({"title": "x", "paragraphs": ["nothing"]})

    with pytest.raises(Exception, match="other facts"):
        synthesis.ask_sections(d, anchors, Forgetful).collect()
