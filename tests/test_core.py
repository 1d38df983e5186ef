"""Graphs, rules, alignment, documents, conflicts, synthesis: our own small inputs."""

from __future__ import annotations

import itertools
import random

import pyspark.sql.functions as F
import pytest

from kgloom.functions import text as T
from kgloom.functions.lexical import OWL, RDF_TYPE, RDFS, XSD
from kgloom.operators import align, conflicts, documents, evaluate, generate, graph, rules, synthesis

NS = "urn:x#"


def g(spark, rows_):
    """Triples of (s, p, o[, datatype]); a leading < marks an IRI object, _: a blank node."""
    out = []
    for s, p, o, *dt in rows_:
        kind = "bnode" if o.startswith("_:") else "iri" if o.startswith("<") else "literal"
        p = {"a": RDF_TYPE}.get(p, p if ":" in p else NS + p)
        o = o[1:] if kind == "iri" else o
        full = lambda x: x if ":" in x else NS + x
        out.append((full(s), "bnode" if s.startswith("_:") else "iri", p, full(o) if kind == "iri" else o, kind, dt[0] if dt else None, None))
    return spark.createDataFrame(out, graph.TRIPLE)


NAMED = "<" + OWL + "NamedIndividual"
BASE = [("A", "a", NAMED), ("A", "a", "<Engine"), ("A", "mass", "5"), ("B", "a", "<Engine"), ("B", "mass", "7"), ("Engine", "a", "<" + OWL + "Class"), ("B", "part", "<A"), ("_:b", "a", "<Engine"), ("B", "see", "_:b")]


def test_individuals_and_their_triples(spark, rows):
    df = g(spark, BASE)
    assert rows(graph.individuals(df)) == [(NS + "A",), (NS + "B",)]
    got = rows(graph.subject_triples(df, graph.individuals(df)))
    assert (NS + "A", RDF_TYPE, OWL + "NamedIndividual") not in got and len(got) == 5
    assert rows(graph.individuals(df.limit(0))) == [] and graph.to_delta(df).count() == 6
    both = g(spark, [("C", "a", "<" + OWL + "Class"), ("C", "a", NAMED)])
    assert rows(graph.individuals(both)) == [(NS + "C",)] and rows(graph.individuals_in(both, NS)) == []


def test_bags_join_values_in_order(spark):
    df = g(spark, BASE + [("A", "mass", "11")])
    assert {r["s"]: r["props"] for r in graph.type_scan(df, NS + "Engine").collect()} == {NS + "A": {"mass": "11, 5"}, NS + "B": {"mass": "7", "part": NS + "A"}}
    bag = {r["s"]: r["props"] for r in graph.conflict_bags(df, NS).collect()}
    assert bag[NS + "B"] == {"mass": "7", "part": "A", "rdf_type": "Engine"}


def test_one_hop_keeps_a_self_loop_twice(spark):
    df = g(spark, [("A", "next", "<A"), ("B", "next", "<A"), ("B", "name", NS + "A")])
    assert graph.neighbors(df, NS + "A").count() == 3


def test_patterns(spark, rows):
    df = g(spark, [("A", "on", "<B"), ("B", "on", "<C"), ("C", "on", "<C")])
    assert rows(graph.match_patterns(df, [("?x", NS + "on", "?y"), ("?y", NS + "on", "?z")]), "x", "y", "z") == [(NS + a, NS + b, NS + c) for a, b, c in ("ABC", "BCC", "CCC")]
    assert rows(graph.match_patterns(df, [("?x", NS + "on", "?x")])) == [(NS + "C",)]
    with pytest.raises(ValueError):
        graph.match_patterns(df, [("?a", NS + "on", "?b"), ("?c", NS + "on", "?d")])


def test_tbox_copy_and_summary(spark, rows):
    df = g(spark, BASE + [("mass", "a", "<" + OWL + "DatatypeProperty"), ("mass", RDFS + "range", "<" + XSD + "decimal")])
    assert graph.copy_tbox(df, df.limit(0)).count() == 4  # the blank node's row stays
    assert rows(graph.tbox_summary(df, NS)) == [("class", "Engine", None), ("datatype", "mass", "decimal")]
    assert rows(graph.tbox_namespace(df)) == [(NS, 1)] and rows(graph.individual_namespace(df)) == [(NS, 1)]
    assert rows(graph.graph_namespace(df)) == [(NS, 10)]
    assert rows(graph.graph_namespace(df.limit(0))) == []


def test_evaluation(spark, rows):
    two = g(spark, [("A", "a", "<E"), ("A", "mass", "1"), ("B", "a", "<E"), ("B", "mass", "2")])
    one = two.where(F.col("s") == NS + "A")
    wrong = g(spark, [("A", "a", "<E"), ("A", "mass", "9"), ("B", "a", "<E"), ("B", "mass", "2")])
    get = lambda a, b: {r["level"]: r for r in evaluate.evaluate(a, b).collect()}
    same = get(two, two)
    assert all(same[k]["f1"] == 1.0 and same[k]["missed"] == same[k]["extra"] == 0 for k in same)
    r = get(two, one)["individuals"]
    assert (r["recall"], r["precision"]) == (0.5, 1.0) and abs(r["f1"] - 2 / 3) < 1e-12
    r = get(one, two)["individuals"]
    assert (r["recall"], r["precision"]) == (1.0, 0.5)
    r = get(two.limit(0), one)["triples"]
    assert (r["n_source"], r["recall"], r["precision"], r["f1"]) == (0, 0.0, 0.0, 0.0)
    r = get(two, wrong)["triples"]
    assert (r["recovered"], r["missed"], r["extra"]) == (3, 1, 1)


def test_diff_set_operations_and_changes(spark, rows):
    a, b = g(spark, [("A", "m", "1"), ("A", "n", "2")]), g(spark, [("A", "m", "1"), ("A", "n", "3")])
    assert rows(graph.difference(b, a), "o", "side") == [("2", "removed"), ("3", "added")]
    assert graph.add(a, b).count() == 3 and rows(graph.remove(a, b), "o") == [("2",)]
    known = graph.difference(b, a).where("side = 'added'").select(graph.triple_id().alias("id"))
    assert graph.manual_entries(a, b, a.limit(0).select(F.col("s").alias("id"))).count() == 1 and graph.manual_entries(a, b, known).count() == 0
    typed = g(spark, [("A", "m", "1", XSD + "integer"), ("A", "m", "2", XSD + "integer"), ("A", "n", "2")])
    ch = spark.createDataFrame([("s1", NS + "A", NS + "m", "9"), ("s2", NS + "Z", NS + "m", "4")], "scenario_id string, s string, p string, new_value string")
    got = rows(graph.apply_changes(typed, ch), "scenario_id", "s", "o", "o_datatype")
    assert [x for x in got if x[0] == "s1"] == [("s1", NS + "A", "2", None), ("s1", NS + "A", "9", XSD + "integer")]
    assert ("s2", NS + "Z", "4", XSD + "decimal") in got and len(got) == 6


def test_remap_keeps_literals_and_foreign_names(spark, rows):
    df = g(spark, [("A", "on", "<B"), ("A", "name", NS + "B"), ("A", "on", "<urn:y#B"), ("B2", "on", "<B")])
    m = spark.createDataFrame([("B", "C"), ("B2", "A")], "old string, new string")
    assert rows(graph.remap_iris(df, m, NS), "s", "o") == [(NS + "A", "urn:x#B"), (NS + "A", NS + "C"), (NS + "A", "urn:y#B")]
    assert rows(graph.remap_iris(df, m.limit(0), NS)) == rows(df.distinct())


# Rules

RULES = "rule_id string, subject_type string, object_type string, attribute string, operator string, value string, unit string, severity string, aggregate string, expected_violated boolean"


def _rules(spark):
    data = [
        ("pair", "Rail", "Tank", "mass", ">", "6", "kg", "critical", "each", True), ("one", "Tank", None, "mass", "<=", "5", "kg", "warning", "each", True), ("any", None, "Tank", "mass", "!=", "5", None, "info", "each", True),
        ("none", "Rail", "Ghost", "mass", ">", "0", None, "info", "each", False), ("sum", "Rail", "Tank", "mass", ">", "11", "kg", "critical", "sum", True), ("text", "Tank", None, "colour", "==", "red", None, "info", None, True),
    ]
    return spark.createDataFrame(data, RULES).withColumn("ord", F.ascii("rule_id") * 1000 + F.length("rule_id"))


def _facts(spark):
    df = g(spark, [("R1", "a", "<Rail"), ("R2", "a", "<Rail"), ("T1", "a", "<Tank"), ("T1", "mass", "5"), ("T2", "a", "<Tank"), ("T2", "mass", "7"), ("T3", "a", "<Tank"), ("T1", "colour", "red")])
    return df, rules.typed_subjects(df), rules.typed_facts(df)


def test_rule_pairs_and_counts(spark, rows):
    df, subjects, facts = _facts(spark)
    each = _rules(spark).where("coalesce(aggregate, 'each') = 'each'")
    got = rules.check_pairs(each, subjects, facts)
    by = {r["rule_id"]: r for r in rules.rule_summary(got).collect()}
    assert {k: (v["n"], v["n_violated"]) for k, v in by.items()} == {"pair": (6, 2), "one": (3, 1), "any": (3, 1), "text": (3, 1)}
    assert rows(rules.pair_counts(each, subjects, facts)) == [("any", 3, 1), ("none", 0, 0), ("one", 3, 1), ("pair", 6, 2), ("text", 3, 1)]
    refs = {r["source_ref"] for r in rules.source_refs(got.where("violated"), _rules(spark)).collect()}
    assert refs == {"T2 · mass = 7 kg", "T1 · mass = 5 kg", "T2 · mass = 7", "T1 · colour = red"}
    assert rows(rules.check_aggregates(_rules(spark), facts)) == [("sum", 12.0, True)]


def test_scenarios_equal_a_recheck_of_the_changed_graph(spark, rows):
    df, *_ = _facts(spark)
    each = _rules(spark).where("coalesce(aggregate, 'each') = 'each'")
    ch = spark.createDataFrame([("s1", NS + "T2", NS + "mass", "1"), ("s2", NS + "T1", NS + "mass", "99"), ("s2", NS + "T3", NS + "mass", "5"), ("s3", NS + "R1", NS + "mass", "1")], "scenario_id string, s string, p string, new_value string")
    got = rows(rules.violated_under(each, df, ch))
    want = []
    for sid in ("s1", "s2", "s3"):
        changed = graph.apply_changes(df, ch.where(F.col("scenario_id") == sid)).withColumn("o_kind", F.lit("iri"))
        v = rules.object_verdicts(each, rules.typed_subjects(changed), rules.typed_facts(changed)).where("violated").select("rule_id").distinct()
        want += [(sid, r["rule_id"]) for r in v.collect()]
    assert got == sorted(want, key=repr)


def test_scores_winners_agreement(spark, rows):
    p = spark.createDataFrame([("s", "a", "R1"), ("s", "a", "r2"), ("s", "b", "r1"), ("t", "a", None)], "scenario_id string, arm string, rule_id string")
    t = spark.createDataFrame([("s", "r1"), ("s", "R3")], "scenario_id string, rule_id string")
    got = rows(evaluate.rule_set_score(p, t, ["scenario_id", "arm"]), "scenario_id", "arm", "precision", "recall", "f1")
    assert got == [("s", "a", 0.5, 0.5, 0.5), ("s", "b", 1.0, 0.5, 0.6667)] or got[:2] == [("s", "a", 0.5, 0.5, 0.5), ("s", "b", 1.0, 0.5, 0.6667)]
    s = spark.createDataFrame([("x", "a", 0.5), ("x", "b", 0.7), ("y", "a", 0.5), ("y", "b", 0.5), ("z", "a", 0.1)], "k string, arm string, score double")
    assert rows(evaluate.winner(s, ["k"], "arm", "score")) == [("x", "b"), ("y", None), ("z", "a")]
    assert rows(evaluate.winner(s, ["k"], "arm", "score", "pair")) == [("x", "b"), ("y", None), ("z", None)]
    c = spark.createDataFrame([("d", True), ("d", False), ("e", None)], "doc string, match boolean")
    assert rows(evaluate.coverage(c, ["doc"]), "doc", "coverage") == [("d", 0.5), ("e", 1.0)]


# Alignment


def test_acronyms_separators_and_shared_words(spark):
    cases = [("FAA", "Federal Aviation Administration", 1.0, "acronym"), ("NASA", "National Aeronautics and Space Administration", 1.0, "acronym"), ("X_1", "x 1", 1.0, "string_sim"), ("A", "Alpha", 0.0, "string_sim"), ("thermal control unit", "thermal control system", 0.5, "string_sim"), ("", "", 1.0, "string_sim"), ("NA", "National Aeronautics Space", 0.0, "string_sim")]
    df = spark.createDataFrame(cases, "a string, b string, score double, method string")
    for r in df.select("*", T.similarity(F.col("a"), F.col("b")).alias("m")).collect():
        assert (r["m"]["score"], r["m"]["method"]) == (r["score"], r["method"]), r


def test_blocked_join_finds_what_all_pairs_find(spark, rows):
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "X1", "pump", "unit", "PU"]
    names = sorted({r.choice([" ", "_", "-"]).join(r.sample(words, r.randint(1, 4))) for _ in range(90)} | {"pu", "Alpha Beta", "ABG", "__", "--"})
    df = spark.createDataFrame([(n,) for n in names], "surface string")
    pairs = spark.createDataFrame([(a, b) for a, b in itertools.combinations(names, 2)], "a string, b string")
    want = rows(pairs.select("a", "b", T.similarity(F.col("a"), F.col("b")).alias("m")).where("m.score >= 0.4").select("a", "b", "m.score", "m.method"))
    assert rows(align.similar_surfaces(df)) == want


def test_candidates_decisions_and_rewrite(spark, rows):
    e = spark.createDataFrame([(0, "e1", "Main Pump"), (1, "e2", "Main_Pump 1"), (2, "e1", "Main Pump"), (3, "e3", "main pump"), (4, "e4", None)], "ord long, id string, text_span string")
    c = align.candidates(e)
    assert rows(c, "entity_id_a", "entity_id_b") == [("e1", "e1"), ("e1", "e2"), ("e1", "e3"), ("e2", "e3")]
    d = {(r["canonical_entity_id"], r["merged_entity_ids"][0]): r["status"] for r in align.decide(c).collect()}
    assert d[("e1", "e3")] == "approved" and d[("e2", "e1")] == "proposed"
    delta = spark.createDataFrame([(0, "i1", "urn:a", "p", "1", "e1"), (1, "i2", "urn:b", "p", "1", "e2"), (2, "i3", "urn:c", "p", "2", "e3"), (3, "i3", "urn:c", "p", "2", "e3")], "ord long, id string, s string, p string, o string, source_entity_id string")
    dec = spark.createDataFrame([(0, "e1", ["e2"], "approved"), (1, "e2", ["e3"], "approved"), (2, "nobody", ["e1"], "approved"), (3, "e3", ["e1"], "rejected")], "ord long, canonical_entity_id string, merged_entity_ids array<string>, status string")
    m = align.rewrite_map(dec, align.entity_iris(delta))
    assert rows(m) == [("urn:b", "urn:a"), ("urn:c", "urn:b")]  # one hop only
    assert rows(align.rewrite(delta, m), "s", "o") == [("urn:a", "1"), ("urn:a", "1"), ("urn:b", "2")]


def _above_the_join(df):
    """Nodes of the optimised plan that the joined pairs pass through."""
    return df._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]


def test_similar_pairs_are_not_shuffled(spark):
    df = spark.createDataFrame([("Main Pump",), ("Main Pump 1",), ("MP",)], "surface string")
    assert "Aggregate" not in _above_the_join(align.similar_surfaces(df))


def test_blocks_of_hot_words_keep_every_pair_once(spark, rows, monkeypatch):
    monkeypatch.setattr(align, "BLOCK_SURFACES", 7)
    r = random.Random(8)
    names = sorted({" ".join([r.choice("abcdefgh"), *r.sample(["Star", "Tracker", "Head", "ST", "x"], r.randint(1, 4))]) for _ in range(70)} | {"STH", "star_tracker_head"})
    pairs = spark.createDataFrame([(a, b) for a, b in itertools.combinations(names, 2)], "a string, b string")
    want = rows(pairs.select("a", "b", T.similarity(F.col("a"), F.col("b")).alias("m")).where("m.score >= 0.4").select("a", "b", "m.score", "m.method"))
    assert rows(align.similar_surfaces(spark.createDataFrame([(n,) for n in names], "surface string"))) == want


def _all_candidates(spark, e):
    """The first pair by ord of every unordered pair of ids, by comparing all rows."""
    texts = sorted({t for _, _, t in e if t is not None})
    both = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string").select("a", "b", T.similarity(F.col("a"), F.col("b")).alias("m"))
    score = {(x["a"], x["b"]): x["m"] for x in both.collect()}
    first = {}
    for a, b in itertools.combinations(sorted({x for x in e if x[2] is not None}, key=lambda x: x[0]), 2):
        m = score[a[2], b[2]]
        if a[0] < b[0] and m["score"] >= 0.4:
            ids = sorted(x for x in (a[1], b[1]) if x is not None)
            first.setdefault((ids[0], ids[-1]) if ids else None, (a[0], b[0], a[1], b[1], a[2], b[2], m["score"], m["method"]))
    return sorted(first.values(), key=repr)


@pytest.mark.parametrize("repeated", [False, True])
def test_candidates_are_all_pairs_of_entities(spark, rows, monkeypatch, repeated):
    monkeypatch.setattr(align, "BLOCK_ENTITIES", 6)
    monkeypatch.setattr(align, "CHUNK", 2)
    r = random.Random(9)
    words = ["alpha", "beta", "gamma", "X1", "pump", "unit", "PU"]
    names = [r.choice([" ", "_"]).join(r.sample(words, r.randint(1, 4))) for _ in range(25)] + ["pu", "__", "--", None]
    e = [(i, f"e{i}", r.choice(names)) for i in range(70)]
    if repeated:  # ids of several rows, in the same and in other spellings, and rows without an id
        e = [(i, r.choice([f"e{i}", f"e{i % 20}", f"e{i % 20}", None]), t) for i, _, t in e]
    e += e[:9]
    columns = ["ord_a", "ord_b", "entity_id_a", "entity_id_b", "surface_a", "surface_b", "score", "method"]
    c = align.candidates(spark.createDataFrame(e, "ord long, id string, text_span string"))
    assert rows(c, *columns) == _all_candidates(spark, e)
    assert repeated or "Aggregate" not in _above_the_join(c)


def test_candidates_of_ids_with_the_separator_stay_apart(spark, rows):
    e = spark.createDataFrame([(0, "a|b", "Main Pump"), (1, "c", "main pump"), (2, "a", "Valve"), (3, "b|c", "valve")], "ord long, id string, text_span string")
    assert rows(align.candidates(e), "entity_id_a", "entity_id_b") == [("a", "b|c"), ("a|b", "c")]


def test_best_match(spark, rows):
    w = spark.createDataFrame([("OBC",), ("ThermalControlUnit",), ("Same",), ("Nothing",)], "name string")
    s = spark.createDataFrame([("OutboardBusController",), ("ThermalControlSystem",), ("Same",), ("ThermalControlSuite",)], "name string")
    assert rows(align.best_match(w, s), "working", "source", "band") == [("OBC", "OutboardBusController", "auto"), ("ThermalControlUnit", "ThermalControlSuite", "judge")]


def _greedy(scored):
    out, l, r = [], set(), set()
    for g_, a, b, s in sorted(scored, key=lambda x: (-x[3], x[1], x[2])):
        if (g_, a) not in l and (g_, b) not in r:
            out.append((g_, a, b, s))
            l.add((g_, a))
            r.add((g_, b))
    return sorted(out, key=repr)


def test_rounds_of_mutual_best_equal_the_greedy_order(spark, rows):
    r = random.Random(9)
    scored = [(g_, a, b, r.choice([0.4, 0.5, 0.6, 0.9])) for g_ in ("x", "y") for a in range(8) for b in range(8) if r.random() < 0.6]
    df = spark.createDataFrame(scored, "arm string, l int, r int, s double")
    assert rows(align.greedy_matches(df, "arm", "l", "r", "s")) == _greedy(scored)
    assert rows(align.greedy_matches(df.limit(0), "arm", "l", "r", "s")) == []


def test_conflicts_score_rules(spark, rows):
    c = spark.createDataFrame([("a", 0, "RailA", "Tank2", "mass_>_threshold"), ("a", 1, "Ghost1", "Rail", "mass"), ("a", 2, "Cat", "Dog", "fur")], "arm string, ix int, subject string, object string, conflict_type string")
    s = conflicts.score_rules(c, _rules(spark).where("rule_id in ('pair', 'none')"))
    assert rows(s, "rule_id", "outcome", "matched_ix") == [("none", "FP", 1), ("pair", "TP", 0)]
    assert rows(conflicts.unmatched(c, s), "ix") == [(2,)]


# Documents


def test_text_headings(spark):
    cases = [("1 Alpha", 1), ("1.2 Beta", 2), ("1.2.3.4 Gamma", 3), ("3 engines", 1), ("ALL CAPS", 2), ("CAPS.", None), ("AB", None), ("A1 B", None), ("x" * 81, None), ("", None), ("  ÜBER ALLES ", 2)]
    df = spark.createDataFrame(cases, "line string, level int")
    assert all(r["got"] == r["level"] for r in df.select("*", documents.text_heading_level(F.col("line")).alias("got")).collect())
    got = spark.createDataFrame([("1 Alpha\nbody\nALL CAPS\n",)], "t string").select(documents.text_to_markdown(F.col("t"))).first()[0]
    assert got == "# 1 Alpha\nbody\n## ALL CAPS"
    assert spark.createDataFrame([("\n\n# A\n\n\n\nb \t\n",)], "t string").select(documents.markdown(F.col("t"))).first()[0] == "# A\n\nb\n"


def test_heading_paths(spark, rows):
    d = spark.createDataFrame([("d", "# A\n## B\nx\n## C\n### D\n# E\n### F\n## G"), ("e", None), ("f", "no heading")], "id string, markdown string")
    got = rows(documents.heading_paths(documents.heading_lines(d)).orderBy("line_no"), "line_no", "path")
    assert [p for _, p in sorted(got)] == [["A"], ["A", "B"], ["A", "C"], ["A", "C", "D"], ["E"], ["E", "F"], ["E", "G"]]


def _chunks(text, n=512):
    return list(documents.scan_chunks(text, n))


def test_chunking():
    assert _chunks("") == [] and _chunks("\n \n") == [] and _chunks("# only\n## headings\n") == []
    a, b, c = _chunks("intro\n# A\none\n\ntwo\n## B\nthree\n")
    assert [x[2] for x in (a, b, c)] == ["intro", "one\n\ntwo", "three"] and [[p[1] for p in x[3]] for x in (a, b, c)] == [[], ["A"], ["A", "B"]]
    text = "\n\n".join("w" * 39 + f" {i}" for i in range(20))
    many = _chunks(text, 20)
    assert len(many) > 1 and all(p[1] <= q[0] for p, q in zip(many, many[1:])) and all(text[a:b].strip() == t for a, b, t, _ in many)
    long = _chunks("word " * 600, 100)
    assert len(long) == 2 and len(long[0][2]) <= 400 < len(long[1][2])  # one cut per line
    assert len(_chunks("x" * 5000, 100)[0][2]) == 400


def test_chunk_table(spark, rows):
    schema = "id string, source_path string, source_format string, source_sha256 string, markdown string, page_map array<struct<char_start:int,char_end:int,page:int>>"
    d = spark.createDataFrame([("d", "/p", "md", "s", "# A\none\n# B\ntwo\n", None), ("q", "/q", "pdf", "t", "abc\n# H\ndef", [(0, 4, 1), (4, 99, 2)]), ("n", "/n", "md", "u", None, None)], schema)
    got = {(r["locator"]["source_id"], r["chunk_ix"]): r for r in documents.chunk_documents(d).collect()}
    assert got["d", 1]["text"] == "two" and got["d", 1]["locator"]["line_start"] == 4 and got["d", 0]["section_path"][0]["anchor"] == "a"
    assert [got["q", i]["locator"]["page"] for i in (0, 1)] == [1, 2] and got["q", 0]["locator"]["line_start"] is None and len(got) == 4
    many = spark.createDataFrame([("a", i, "x" * (20 + 10 * i)) for i in range(4)], "artifact_id string, chunk_ix int, text string")
    assert documents.eligible(many).count() == 3 and documents.eligible(many, first=2).count() == 1


# Synthesis


def test_anchors_count_repeated_ids(spark, rows):
    df = spark.createDataFrame([(f"i{i:04d}",) for i in range(1001)] + [("i0000",)], "id string")
    got = dict(rows(synthesis.anchor_map(df)))
    assert got["i0000"] == "[T-002]" and got["i0001"] == "[T-003]" and got["i1000"] == "[T-1002]"


def test_provenance_and_check(spark, rows):
    drafts = spark.createDataFrame([("d", 1, ["x [T-001] [T-009]", "none"]), ("d", 0, ["y [T-002]"])], "doc_id string, section_ix int, paragraphs array<string>")
    anchors = spark.createDataFrame([("a", "[T-001]"), ("b", "[T-002]")], "id string, anchor string")
    got = rows(synthesis.provenance(synthesis.paragraphs(drafts), anchors), "paragraph_index", "citation_anchors", "triple_ids")
    assert got == [(0, ["[T-002]"], ["b"]), (1, ["[T-001]", "[T-009]"], ["a"]), (2, [], [])]
    entries = [("d", "1", "x#mass", "5.0", XSD + "decimal"), ("d", "2", "x#name", "ALPHA", None), ("d", "3", "x#n", "0", None), ("d", "4", "x#n", "17", None), ("d", "5", RDF_TYPE, "E", None), ("d", "6", "x#on", "http://b", None), ("d", "7", "x#t", "12:30", None)]
    e = spark.createDataFrame(entries, "doc_id string, id string, p string, o string, o_datatype string")
    docs = spark.createDataFrame([("d", "alpha weighs 5.04 kg, not 16.7 or 0.5")], "doc_id string, text string")
    assert rows(synthesis.self_check(e, docs), "triple_id", "match") == [("1", True), ("2", True), ("3", True), ("4", False)]


def test_labels_slugs_and_ids(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(T.label_from_iri(F.lit("http://x/y#mainBusVoltage_2"))) == "main Bus Voltage 2"
    assert get(T.slugify(F.lit(" Äber, die  Brücke! "))) == "äber-die-brücke" and get(T.slugify(F.lit("!!"))) == "section"
    assert get(T.make_iri(F.lit("a b/c"), NS)) == NS + "a_b_c" and get(T.make_iri(F.lit("http://q"), NS)) == "http://q"
    assert [get(T.expand_datatype(F.lit(x))) for x in ("xsd:float", XSD + "int", "float")] == [XSD + "float", XSD + "int", None]
    aliases = F.create_map(F.lit("al"), F.lit("urn:al"))
    assert [get(T.resolve_iri(F.lit(x), NS, aliases)) for x in ("http://q", "al", "a:b", "bare")] == ["http://q", "urn:al", "a:b", NS + "bare"]
    assert get(T.strip_citations(F.lit("One [T-001].  Two [T-1000]"))) == "One. Two [T-1000]"
    assert [get(T.normalize_instance(F.lit(x))) for x in ("Radio1", "EngineA", "JobyS4", "7")] == ["Radio", "Engine", "Joby", "7"]


def test_taxonomy_and_generated_graph(spark, rows):
    t = generate.taxonomy(spark)
    assert ("ColdGasPropulsion", "Subsystem", 2) in rows(generate.class_closure(t))
    assert rows(generate.concrete(t, "Component", "ground")) and ("Component",) not in rows(generate.concrete(t, "Component"))
    gg = graph.tree_to_graph(generate.systems_table(spark, "orbit", 2, seed=4), NS)
    assert gg.where(F.col("p") == NS + "hasComponent").count() == 2 * gg.where(F.col("p") == NS + "hasSubsystem").count() > 0
    assert rows(gg) == rows(graph.tree_to_graph(generate.systems_table(spark, "orbit", 2, seed=4), NS))
    d = graph.direct_graph(spark.createDataFrame([("A", "E", "on", "B"), ("A", None, "m", None)], "subject string, cls string, property string, value string"), NS)
    assert rows(d.where("o_kind = 'literal'"), "o") == [("B",)] and d.count() == 3


def test_joins_on_a_hot_key(spark, rows):
    from kgloom import session

    left = spark.createDataFrame([("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(50)] + [(None, 1), ("lost", 2)], "k string, x int")
    right = spark.createDataFrame([("hot", "H")] + [(f"k{i}", str(i)) for i in range(50)], "k string, y string")
    for how in ("inner", "left"):
        want = rows(left.join(right, "k", how))
        assert rows(session.hot_split_join(left, right, "k", how, hot_keys=10, least=5)) == want
        assert rows(session.skew_safe_join(left, right, "k", how)) == want
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert rows(session.skew_safe_join(left, right, "k")) == rows(left.join(right, "k"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert session.is_small(right, 51) and not session.is_small(right, 50)


def test_cut_forgets_the_plan_and_keeps_the_rows(spark, rows):
    from kgloom import session

    df = spark.range(100).selectExpr("id", "IF(id % 2 = 0, NULL, id) AS x", "array(id) AS a")
    again = session.cut(df)
    assert rows(again) == rows(df) and again.schema.names == df.schema.names and session.cut(df.limit(0)).isEmpty()


def test_class_closure_of_any_depth(spark):
    from kgloom.operators import generate

    chain = [(f"c{i}", f"c{i + 1}") for i in range(120)]
    df = spark.createDataFrame(chain + [("c120", None), ("x", "y"), ("y", "x")], "local string, parent string")
    got = {(r[0], r[1]): r[2] for r in generate.class_closure(df).collect()}
    assert sum(a.startswith("c") for a, _ in got) == 121 * 120 // 2 and got["c0", "c120"] == 120
    assert got["x", "y"] == 1 and got["x", "x"] == 2
