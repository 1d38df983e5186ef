"""Operators of the llm subpackage: brute force, invariants and the awkward cases."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

pytest.importorskip("kgloom.llm")
from kgloom.llm import groups, leakage, names, packing, queries, splitting, subjects, survivors  # noqa: E402


def _t(i):
    return dt.datetime(2025, 1, 1) + dt.timedelta(hours=i)


# Names

BUSINESS = ("aerospace", "avionics", "composites", "dynamics", "energy", "engineering", "instruments", "laboratories", "navigation", "orbital", "propulsion", "research", "robotics", "systems")


@pytest.mark.parametrize(
    ("text", "parsed"),
    [
        ("Talarivan GCU-2497 Gimbal Control Unit", ("component", "talarivan", "gcu2497")),
        ("trx 2237 by Lefavuben", ("component", "lefavuben", "trx2237")),
        ("Diraliler OBC347", ("component", "diraliler", "obc347")),
        ("Benapomex_OBC_2580", ("component", "benapomex", "obc2580")),
        ("Talarivan GCU GCU-2497", ("component", "talarivan", "gcu2497")),
        ("PR-2772 Pressure Regulator (Kupamukan)", ("component", "kupamukan", "pr2772")),
        ("Masaleresas Aerospace Systmes", ("organisation", "masaleresas", "aerospace systems")),
        ("DefabunenarRoboticsPropulsionSystems", ("organisation", "defabunenar", "propulsion robotics systems")),
        ("Laboratories Research, Kenadedipin", ("organisation", "kenadedipin", "laboratories research")),
        ("Motalutugar Instruments Orbital G.m.b.H.", ("organisation", "motalutugar", "instruments orbital")),
        ("Babatutefir LDA", ("organisation", "babatutefir", None)),
        ("Dr. Christopher N. Vabavirater", ("person", "vabavirater", "christopher")),
        ("Vabavirater, Chris", ("person", "vabavirater", "christopher")),
        ("gabriella ruganobitel", ("person", "ruganobitel", "gabriella")),
        ("S KODAMEFADUN", ("person", "kodamefadun", None)),
        ("Lirakopason, A.G.", ("person", "lirakopason", None)),
        ("Rob Podabopusor", ("person", "podabopusor", "robert")),
        ("Bupasutivur ELE", ("organisation", "bupasutivur", None)),
        ("Vupanenaman Naviation", ("organisation", "vupanenaman", "navigation")),
        ("", None), ("  ", None), ("!?", ("other", "!?", "")),
    ],
)
def test_name_profiles(text, parsed):
    # The business words and given names are learned from a column; here they are given.
    column = names.Vocabulary(learned_business=dict.fromkeys(BUSINESS, 100), learned_givens=dict.fromkeys(("gabriella", "christopher", "robert"), 100))
    got = names.parse(text, column)
    assert (got[:3] if got else None) == parsed


def _pairs(spark, rows, surfaces):
    c = spark.createDataFrame([(a, b) for a, b in zip(surfaces, surfaces[1:] + [None])], "surface_a string, surface_b string").selectExpr("*", "1 AS record", "2 AS name_id")
    return rows(names.variant_pairs(c))


def test_variants_of_one_thing_are_linked_and_near_misses_are_not(spark, rows):
    same = [
        ["Katherine Vabaferavun", "Vabaferavun Katherine", "Kate Vabaferavun", "K. C. Vabaferavun", "VABAFERAVUN, K.", "Katherine Vabaferavnu"],
        ["Margaret Vabaferavun", "Meg Vabaferavun"],
        ["Sotatisan MTQ-7848 Magnetic Torque Rod", "mtq 7848 by Sotatisan", "Sotatsan MTQ-7848", "SOTATISAN MTQ-7848 Magnetci Torque Rod"],
        ["Sotatisan MTQ-7858 Magnetic Torque Rod"], ["Sotatisan TH-7848 Cold Gas Thruster"],
        ["Masaleresas Aerospace Systems Inc.", "Masaleresas AS", "Aerospace Systems, Masaleresas", "Masaleresas Aero Sys. incorporated"],
        ["Masaleresas Research Dynamics Inc."],
    ]
    want = sorted((min(a, b), max(a, b)) for g in same for i, a in enumerate(g) for b in g[:i])
    surfaces = [s for g in same for s in g]
    random.Random(2).shuffle(surfaces)
    assert _pairs(spark, rows, surfaces + [None, surfaces[0]]) == sorted(want, key=repr)


def test_initials_that_fit_two_people_link_neither(spark, rows):
    assert _pairs(spark, rows, ["Samantha Fotadokamun", "Stella Fotadokamun", "S. Fotadokamun"]) == []


def test_a_richer_record_blocks_again(spark, rows):
    # The last spelling is two edits from the first and one from the second, which has initials only.
    got = _pairs(spark, rows, ["Samantha Kodamefadun", "S KODAMFADUN", "Samantha Kodamfaun"])
    assert len(got) == 3


def test_names_of_an_empty_table(spark, rows):
    assert _pairs(spark, rows, [None]) == []
    assert rows(names.resolve(spark.createDataFrame([("",), (None,), ("x" * 100_000,)], "surface string")), "surface") == [("x" * 100_000,)]


# Groups


def _components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return sorted(((x, find(x)) for x in parent), key=repr)


@pytest.mark.parametrize("kind", ["path", "star", "random", "cycle", "empty"])
def test_components_against_union_find(spark, rows, kind):
    r = random.Random(kind)
    n = [f"{i:04d}" for i in range(120)]
    shuffled = r.sample(n, len(n))
    edges = {
        "path": list(zip(shuffled, shuffled[1:])), "star": [("0119", x) for x in n[:-1]], "random": [(r.choice(n), r.choice(n)) for _ in range(90)] + [(None, "0001"), ("0002", None), ("0003", "0003")],
        "cycle": list(zip(shuffled, shuffled[1:] + shuffled[:1])), "empty": [],
    }[kind]
    df = spark.createDataFrame(edges * 2, "a string, b string").selectExpr("*", "1 AS node", "2 AS group")
    assert rows(groups.connected_components(df)) == _components(edges)


DECISIONS = "ord long, candidate_id string, canonical_entity_id string, merged_entity_ids array<string>, aliases array<string>, status string, decided_at timestamp"
CANDIDATES = "id string, entity_id_a string, entity_id_b string, surface_a string, surface_b string"
JUDGMENTS = "candidate_id string, judged_by string, same_entity boolean, canonical_surface string, judged_at timestamp"


def _tables(spark):
    d = [
        (0, "c1", "e2", ["e1"], ["One", " One ", "", None, "Two"], "approved", _t(1)),
        (1, "c1", "e2", ["e1"], ["One", " One ", "", None, "Two"], "approved", _t(1)),  # repeated
        (2, "c2", None, [], None, "approved", _t(2)),  # its ids are in the candidate's row
        (3, "c3", "e5", ["e6"], None, "approved", _t(3)),
        (4, "c3", "e5", ["e6"], None, "rejected", _t(4)),  # revised
        (5, "c4", "e8", None, None, "approved", _t(5)),  # alone
        (6, "c9", "e9", [None, "e9"], None, "approved", _t(6)),  # itself
        (7, None, "e10", ["e11"], None, "approved", None), (8, None, "e12", ["e13"], None, "approved", None),
        (9, "c5", "e20", ["e21"], ["x"], "approved", _t(1)), (10, "c5", "e21", ["e20"], ["x"], "approved", _t(1)),  # a tie: recorded last
        (11, "c6", "e21", ["e20"], ["y"], "proposed", _t(9)),
    ]
    c = [("c1", "e2", "e1", "A", "B"), ("c1", "e2", "e1", "A", "B"), ("c2", "e1", "e3", "C", None), ("c5", None, None, "D", "E"), (None, "e30", "e31", "F", "G"), ("c77", "e40", "e41", "H", "I")]
    j = [
        ("c1", "llm", True, "A", _t(9)), ("c1", "rule", True, "B", _t(1)), ("c1", "rule", True, "B", _t(1)), ("c1", "rule", True, "A", _t(0)), ("c1", "reviewer", False, "A", _t(9)), ("c1", "reviewer", True, "foreign", _t(9)), ("c1", "reviewer", True, None, _t(9)),
        ("c5", "oracle", True, "D", None), ("c5", "oracle", True, "E", None), ("c5", None, True, " ", _t(9)),
    ]
    return spark.createDataFrame(d, DECISIONS).selectExpr("*", "1 AS key", "2 AS ids"), spark.createDataFrame(j, JUDGMENTS).selectExpr("*", "3 AS group_id"), spark.createDataFrame(c, CANDIDATES).selectExpr("*", "4 AS first")


def test_mention_groups(spark, rows):
    d, _, c = _tables(spark)
    want = [("e1", x) for x in ("e1", "e2", "e3")] + [("e10", "e10"), ("e10", "e11"), ("e12", "e12"), ("e12", "e13"), ("e20", "e20"), ("e20", "e21")]
    assert rows(groups.mention_groups(d, c)) == sorted(want, key=repr)
    assert rows(groups.mention_groups(d.limit(0), c)) == []


def test_survivors(spark, rows):
    d, j, c = _tables(spark)
    assert rows(survivors.surviving_mentions(d, j, c)) == [("e1", "e2", "B", 2), ("e20", "e21", "D", 1)]
    assert rows(survivors.surviving_mentions(d, j.limit(0), c)) == []
    assert rows(survivors.surviving_mentions(d.limit(0), j, c.limit(0))) == []


def test_surviving_records_are_the_most_complete(spark, rows):
    d, j, c = _tables(spark)
    got = rows(survivors.surviving_records(d, j, c), "group_id", "candidate_id", "canonical_entity_id", "n_aliases", "n_filled")
    assert got == sorted([("e1", "c1", "e2", 2, 3), ("e10", None, "e10", 0, 2), ("e12", None, "e12", 0, 2), ("e20", "c5", "e21", 1, 3)], key=repr)
    stored = groups.mention_groups(d, c)
    assert rows(survivors.surviving_records(d, j, c, stored), "group_id", "candidate_id", "canonical_entity_id", "n_aliases", "n_filled") == got
    assert rows(survivors.surviving_records(d.limit(0), j, c)) == []


def test_completeness_ranks_filled_fields(spark, rows):
    import pyspark.sql.functions as F

    df = spark.createDataFrame([("g", "1", "a", None, "llm"), ("g", "2", "a", "b", "llm"), ("g", "3", " ", "b", "reviewer"), (None, "4", "a", "b", "rule")], "g string, id string, x string, y string, who string")
    got = survivors.top_record(df, "g", [F.desc(survivors.completeness(["x", "y"])), survivors.trust("who"), F.col("id")])
    assert rows(got, "g", "id") == [("g", "2")]


# Splitting

TEXTS = st.text(alphabet=st.sampled_from("ab .!?\n\r\t x"), max_size=400)


@given(TEXTS, st.integers(1, 60), st.integers(0, 20))
@settings(max_examples=200, deadline=None)
def test_pieces_fit_and_lose_nothing(text, room, overlap):
    got = splitting.pieces(text, room, overlap)
    assert all(0 < len(p) <= room for p in got)
    plain = splitting.pieces(text, room, 0)
    assert "".join("".join(plain).split()) == "".join(text.split())
    assert all(p in text for p in got)


@given(TEXTS, st.integers(1, 60))
@example("?\r\n?", 1)
@settings(max_examples=200, deadline=None)
def test_boundary_is_the_coarsest_that_serves(text, room):
    import re

    eol = r"(?:\r\n|\r(?!\n)|\n)"
    cuts = [rf"{eol}(?:[ \t]*{eol})+", eol, r"(?<=[.!?])\s+", r"\s+"]
    parts, want = [text], "character"
    for name, cut in zip(splitting.BOUNDARIES, cuts):
        parts = [q.strip() for p in parts for q in re.split(cut, p)]
        if all(len(p) <= room for p in parts):
            want = name
            break
    assert splitting.boundary(text, room) == want


def test_units_within_the_room_are_not_cut_for_the_overlap():
    text = "\n\n".join(c * 1985 for c in "abc")
    kind, got = splitting.cut_up(text, 2020, 100)
    assert kind == "paragraph" and [p.lstrip("abc"[i - 1] if i else "").strip() for i, p in enumerate(got)] == [c * 1985 for c in "abc"]
    assert all(len(p) <= 2020 for p in got)


def test_sections_end_before_paragraphs_do():
    sections = [f"# Part {i}\n\n" + "\n\n".join([f"{i} " * 20] * 2) for i in range(4)]
    kind, got = splitting.cut_up("\n\n".join(sections), 120)
    assert kind == "paragraph" and [p.strip() for p in got] == [s.strip() for s in sections]


@given(TEXTS, st.integers(1, 60), st.integers(0, 20))
@settings(max_examples=200, deadline=None)
def test_boundary_is_what_the_cutting_used(text, room, overlap):
    kind, got = splitting.cut_up(text, room, overlap)
    assert kind == splitting.boundary(text, room)
    if kind != "character":
        # No word is cut in a piece of whole words, and only an overlap begins inside what came before.
        words = set(text.split())
        assert all(set(p.split()) <= words for p in splitting.pieces(text, room))


def test_chunks_with_context(spark, rows):
    path = "array<struct<level:int,title:string,anchor:string>>"
    word = "w" * 100
    data = [
        ("fits", "x" * 2000, None), ("para", "\n\n".join(["y" * 1000] * 3), [(1, "T1", "t"), (2, "T2", "t")]), ("long", "z" * 30_000, []), ("words", " ".join([word] * 60), None),
        ("lines", "\r\n".join(["l" * 900] * 4), None), ("sents", ". ".join(["s" * 700] * 5), None), ("head", "q" * 10, [(1, "t" * 3000, "t")]), (None, "x" * 9000, None), ("null", None, None), ("empty", "", None),
        ("blank", " " * 5000, None),
    ]
    df = spark.createDataFrame(data + data[:3], f"id string, text string, section_path {path}").selectExpr("*", "1 AS item", "2 AS piece")
    want = {("para", "paragraph"), ("long", "character"), ("words", "word"), ("lines", "line"), ("sents", "sentence"), ("head", "character")}
    got = set(rows(splitting.chunk_boundaries(df)))
    assert got - {("blank", "paragraph")} == want
    pieces = splitting.chunk_pieces(df).collect()
    assert all(len(p["piece"]) <= 2048 for p in pieces)
    assert all(p["piece"].startswith("[Section: T1 > T2]\n\n") for p in pieces if p["item"] == "para")
    assert all(p["piece"].startswith("[Section: (no section)]\n\n") for p in pieces if p["item"] == "words")
    assert rows(splitting.chunk_boundaries(df.limit(0))) == []


# Packing


@given(st.lists(st.integers(1, 50), max_size=120), st.integers(50, 60))
@settings(max_examples=150, deadline=None)
def test_containers_hold_everything_once(sizes, capacity):
    got = packing.best_two_fit(sizes, capacity)
    assert sorted(i for c in got for i in c) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in c) <= capacity for c in got)
    half = [sum(sizes[i] for i in c) * 2 <= capacity for c in got]
    assert sum(half) <= 1  # two half-empty containers would be one


def test_two_fit_better_than_the_smallest():
    # Greedy takes 6 and then 3; 2 + 2 fill the gap of 4 that its smallest leaves.
    assert sorted(sorted([6, 3, 2, 2, 3][i] for i in c) for c in packing.best_two_fit([6, 3, 2, 2, 3], 10)) == [[2, 2, 6], [3, 3]]


def test_pack_table(spark):
    data = [(i, (i * 37) % 300 + 1) for i in range(500)] + [(900, 5000), (901, 2048), (902, 0), (903, None), (None, 7)]
    df = spark.createDataFrame(data, "doc_id long, n_tokens int").selectExpr("*", "1 AS container", "2 AS shard")
    got = packing.pack(df, shard_items=200).toPandas()
    assert got.groupby("container")["n_tokens"].sum().max() <= 2048
    totals = got.groupby("doc_id")["n_tokens"].sum().to_dict()
    assert totals == {k: n for k, n in data if k is not None and n}
    assert (got.groupby("doc_id").size() > 1).sum() == 1 and sorted(got[got.doc_id == 900]["n_tokens"]) == [904, 2048, 2048]
    assert packing.pack(df.limit(0)).count() == 0


@given(st.text(max_size=80), st.text(alphabet=st.sampled_from("ab '\u00a0\n\t1\u00bd\u0301.-sé\u4e2d\U0001F600<|endoftext|>"), max_size=80))
@settings(max_examples=150, deadline=None)
def test_lengths_by_parts_are_those_of_whole_texts(a, b):
    lengths = packing._lengths(packing.TOKENIZER)
    assert lengths.by_parts
    assert lengths.of([a, b, a + b]) == [len(lengths.tokenizer.encode(t, add_special_tokens=False)) for t in (a, b, a + b)]


def test_tokenizers_of_other_kinds_encode_whole_texts():
    other = packing.Lengths("/opt/tokenizers/word_bpe_49k.json")
    assert not other.by_parts and other.of(["Hello  World", ""]) == [2, 0]


def test_token_counts(spark, rows):
    df = spark.createDataFrame([(1, "hello world"), (1, "hello world"), (2, ""), (3, None), (None, "x"), (4, "<|endoftext|> " * 3)], "doc_id long, text string")
    got = dict(rows(packing.token_counts(df)))
    assert got[1] == 2 and got[2] == 0 and set(got) == {1, 2, 4} and got[4] > 3


# Leakage

ITEM = "Suppose a lunar relay named Vusonitan anchored under an abandoned harbour, that trades away fifty-six ballast bags after two failed attempts. Curiously Lotesolan swaps eleven ballast bags without waking anyone."


def _leaks(spark, docs, items=((1, ITEM),)):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS at", "2 AS t")
    i = spark.createDataFrame(list(items), "item_id long, text string").selectExpr("*", "'s' AS suite")
    return d, i


def test_leaks_in_disguise(spark, rows):
    w = ITEM.split()
    docs = [
        (1, "note. " + ITEM.upper() + " end"), (2, "x " + " ".join(w[3:16]).replace("-", "‑") + " y"), (3, "*" + "*  *".join(w[4:18]) + "*"), (4, "​".join(" ".join(w[2:15]))), (5, " ".join(w[:11])),
        (6, " ".join(w[:6] + ["no"] + w[6:14])), (7, ITEM.replace("harbour, that", "har<b>bour</b>;\r\n> [that](http://x/y)&nbsp;")), (8, None), (9, ""), (None, ITEM), (1, "note. " + ITEM.upper() + " end"), (10, "word " * 50_000 + ITEM),
    ]
    d, i = _leaks(spark, docs, ((1, ITEM), (1, ITEM), (2, "short one"), (3, None), (None, ITEM)))
    assert rows(leakage.leaked(d, i)) == [(1, 1), (10, 1), (2, 1), (3, 1), (4, 1), (7, 1)] or rows(leakage.leaked(d, i)) == sorted([(x, 1) for x in (1, 2, 3, 4, 7, 10)], key=repr)
    assert rows(leakage.leaked(d.limit(0), i)) == [] and rows(leakage.leaked(d, i.limit(0))) == []


def test_leaks_by_a_shuffled_join(spark, rows, monkeypatch):
    d, i = _leaks(spark, [(1, ITEM), (2, "other words " * 20)])
    monkeypatch.setattr(leakage, "MAX_BROADCAST", 0)
    assert rows(leakage.leaked(d, i)) == [(1, 1)]


def test_reparameterised_items(spark, rows):
    other = ITEM.replace("Vusonitan", "Kalemuris").replace("Lotesolan", "Bodiferan").replace("fifty-six", "ninety-five").replace("eleven", "four")
    mixed = ITEM.replace("Vusonitan", "Lotesolan").replace("fifty-six ballast", "two ballast")
    d, i = _leaks(spark, [(1, ITEM), (2, other), (3, "nothing of it " * 9)])
    assert rows(leakage.leaked_templates(d, i), "doc_id", "item_id", "verdict") == [(1, 1, "exact"), (2, 1, "reparameterised")]
    assert mixed != ITEM and rows(leakage.leaked_templates(d.limit(0), i)) == []


def test_planted_items_with_other_slots(spark):
    r = random.Random(4)
    name = lambda: "".join(r.choice(["ka", "lo", "ri", "ve", "su", "ben"]) for _ in range(4)).title()
    number = lambda: r.choice(["twelve", "forty-two", "90", "seven", "315"])
    scenes = ["a lighthouse keeper", "the night ferry", "an orchard wall", "the second quarry", "a mill pond", "the old signal box"]
    deeds = ["counts", "hides", "borrows", "paints", "weighs", "returns"]
    things = ["oak barrels", "tin whistles", "copper kettles", "wool blankets", "glass floats"]

    def frame():
        parts = [(r.choice(scenes), r.choice(deeds), r.choice(things), r.choice(scenes)) for _ in range(4)]
        return lambda names_, numbers: " ".join(f"Near {a} the warden {n} {b} {k} {c} beside {e}." for (a, b, c, e), n, k in zip(parts, names_, numbers))

    frames = [frame() for _ in range(30)]
    slots = lambda: (r.sample(sorted({name() for _ in range(40)}), 4), r.sample(["twelve", "90", "seven", "315", "eleven"], 4))
    items = [(i, f(*slots())) for i, f in enumerate(frames)]
    filler = "The log of the week has no further remark and the clerk went home early again. "
    docs, want = [], set()
    for i, f in enumerate(frames):
        if i % 2:
            docs.append((i, filler + f(*slots()) + " " + filler))
            want.add((i, i))
        else:
            docs.append((i, filler + frame()(*slots()) + " " + filler))  # another text of the same words
    d, i = _leaks(spark, docs, items)
    got = {(x["doc_id"], x["item_id"]) for x in leakage.leaked_templates(d, i).where("verdict = 'reparameterised'").collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)


def test_verdicts_need_the_whole_vocabulary(spark):
    d, i = _leaks(spark, [(1, ITEM)])
    with pytest.raises(ValueError):
        leakage.ordinary_words(i, limit=3, whole=True)
    assert len(leakage.ordinary_words(i, limit=3)) == 3


# Subjects

TERMS = {"thermal": ["radiator panel", "heat pipe", "survival heater"], "sport": ["race heat", "podium finish", "relay leg"], "law": ["type certificate", "export permit", "liability clause"]}
FILLER = ["The numbering follows the previous issue.", "A copy is kept in folder 9.", "No further remark was made."]


def _corpus(n, seed):
    r = random.Random(seed)
    docs = []
    for _ in range(n):
        labels = frozenset(r.sample(sorted(TERMS), r.choice([0, 1, 1, 2])))
        sents = [f"{r.choice(['Later', 'At first', 'As noted'])}, the {r.choice(['first', 'old', 'spare'])} {r.choice(TERMS[s])} was {r.choice(['checked', 'compared', 'kept'])} in week {r.randrange(400)}." for s in labels for _ in range(r.randint(2, 4))]
        other = sorted(set(TERMS) - labels)
        if other and r.random() < 0.3:
            sents.append(f"Later, the {r.choice(TERMS[other[0]])} was kept in week 3.")  # a passing sentence
        sents += r.choices(FILLER, k=3)
        r.shuffle(sents)
        docs.append((" ".join(sents), labels))
    return docs


def test_subjects_of_held_out_documents():
    model = subjects.train(_corpus(400, 1), list(TERMS), [ITEM])
    right = sum({model.subjects[k] for k in np.flatnonzero(model.counts([t])[0] >= 2)} == set(labels) for t, labels in _corpus(200, 2))
    assert right >= 190
    assert not (model.counts([ITEM + " " + ITEM]) >= 2).any() and not model.counts([""]).any() and model.counts([]).shape == (0, 3)


def test_headings_and_clutter_are_no_sentences():
    body, heads = subjects.sentences("# The heat pipe\n\nOne is here. [3/4] Two is\nthere.\n— 12 —\n- 1 -\n## 2 The race heat\r\nThree!")
    assert heads == ["The heat pipe", "2 The race heat"] and body == ["One is here.", "Two is there.", "Three!"]


def test_document_subjects_awkward_rows(spark, rows):
    docs = _corpus(200, 3)
    table = [(i, t) for i, (t, _) in enumerate(docs)] + [(500, None), (501, ""), (None, docs[0][0]), (0, docs[0][0])]
    labels = [(i, s) for i, (_, ls) in enumerate(docs) for s in (ls or [None])] + [(7777, "law"), (None, "law"), (1, "unknown")]
    areas = [(1, s, "") for s in TERMS] + [(9, None, None)]
    d = spark.createDataFrame(table, "doc_id long, text string").selectExpr("*", "'x' AS subject")
    ls, a = spark.createDataFrame(labels, "doc_id long, subject string"), spark.createDataFrame(areas, "area_id int, subject string, description string")
    got = rows(subjects.document_subjects(d, ls, a), "doc_id", "subject")
    want = sorted(((i, s) for i, (_, x) in enumerate(docs) for s in x), key=repr)
    assert len(set(got) ^ set(want)) <= 0.05 * len(want) and len(got) == len(set(got))
    assert rows(subjects.document_subjects(d, ls.limit(0), a)) == []
    assert rows(subjects.document_subjects(d.limit(0), ls, a)) == []


def test_every_query_has_a_name_of_a_problem():
    assert {"p1_found", "p4_found", "p5_found", "p7_found", "p9_found", "p10_found"} <= set(queries.queries())
    assert set(queries.oracle_sql()) <= set(queries.queries())
