"""Names of vocabularies that no list of the operator holds: recall and precision of what is learned."""

from __future__ import annotations

import random

import pytest

pytest.importorskip("kgloom.llm")
from kgloom.llm import names  # noqa: E402


def _pairs(spark, rows, surfaces):
    c = spark.createDataFrame([(a, b) for a, b in zip(surfaces, surfaces[1:] + [None])], "surface_a string, surface_b string")
    return set(rows(names.variant_pairs(c)))


GROUPS = [
    ["Michael Smith", "Mike Smith"], ["Hanover Cable Works", "Works, Hanover Cable"], ["Toyota Motor", "Toyota Motors Corp."], ["Thomas Anderson", "Tom Anderson", "T. Anderson"],
    ["Norvik Foods", "Norvik Foods Inc"], ["Peterson, Andrew", "Andrew Petersson"], ["Susan Achterberg", "Sue Achtreberg"],
    # Nothing says that these are one organisation in two orders: without its legal form a name may be a person's.
    ["Ulvang Brekstad Oyj"], ["Brekstad Ulvang"],
]


def test_one_name_without_a_column_to_learn_from(spark, rows):
    want = {(min(a, b), max(a, b)) for g in GROUPS for i, a in enumerate(g) for b in g[:i]}
    assert _pairs(spark, rows, [x for g in GROUPS for x in g]) == want


def test_short_and_different_names_stay_apart(spark, rows):
    apart = ["Robert Hall", "Rob Hill", "Robert Ball", "Robert Bell", "Robert Li", "Bob Lu", "Maria Hall", "Hanover Pipe Works", "Hanover Cable Works"]
    assert _pairs(spark, rows, apart) == set()


def test_established_spellings_are_no_typos_of_each_other(spark, rows):
    given = ["Anna", "Bruno", "Clara", "Dieter", "Edda"]
    surfaces = [f"{g} {s}" for g in given for s in ("Petersen", "Peterson")]
    assert _pairs(spark, rows, surfaces) == set()
    assert _pairs(spark, rows, ["Anna Petersen", "Anna Peterson"]) == {("Anna Petersen", "Anna Peterson")}


def test_near_by_length():
    assert names.near("hall", "hall") and not names.near("hall", "hill") and names.near("marlow", "marlwo") and not names.near("abcdef", "abdecg")
    assert names.near("fotaspion", "fotasiopn") and names.near("kaapelli", "kapelli")


def _typo(word, r):
    i = r.randrange(1, len(word) - 1)
    return r.choice([word[:i] + word[i + 1 :], word[:i] + word[i + 1] + word[i] + word[i + 2 :], word[:i] + word[i] + word[i:], word[:i] + r.choice("aeiou") + word[i + 1 :]])


def _held_out(r, n):
    """Groups of spellings of people and firms in words of no known language."""
    syllables = ["zor", "quen", "thi", "bral", "wex", "dru", "fyl", "noq", "jas", "hux", "olm", "yev", "skri", "gwy", "plat", "tchu"]
    word = lambda k: "".join(r.choice(syllables) for _ in range(k))
    givens = {g: (s,) for g, s in zip([word(3).title() for _ in range(12)], [word(1).title() + "o" for _ in range(12)])}
    trades = list({word(3).title() for _ in range(10)})
    out, houses = [], set()
    while len(out) < n:
        house = word(4).title()
        if any(names.near(house.lower(), h) for h in houses):
            continue
        houses.add(house.lower())
        if len(out) % 2:
            g = r.choice(sorted(givens))
            out.append([f"{g} {house}", f"{house}, {g}", f"{g[0]}. {house}", f"{g} {_typo(house, r)}", f"{givens[g][0]} {house}", f"{g} {house}".upper()])
        else:
            a, b = r.sample(trades, 2)
            out.append([f"{house} {a} {b} Inc", f"{house} {a} {b}", f"{b} {a}, {house}", f"{_typo(house, r)} {a} {b} Ltd", f"{house} {a[0]}{b[0]}", f"{house} {_typo(a, r)} {b}"])
            if len(out) % 3 == 0:
                c, d = r.sample([t for t in trades if t not in (a, b)], 2)
                out.append([f"{house} {c} {d} Inc"])
    return out


def test_recall_and_precision_on_other_vocabularies(spark):
    r = random.Random(11)
    groups = _held_out(r, 400)
    want = {(min(a, b), max(a, b)) for g in groups for i, a in enumerate(g) for b in g[:i] if a != b}
    rows_ = [(r.choice(g), r.choice(g)) for g in groups for _ in range(4)] + [(x, g[0]) for g in groups for x in g]
    r.shuffle(rows_)
    got = {tuple(p) for p in names.variant_pairs(spark.createDataFrame(rows_, "surface_a string, surface_b string")).collect()}
    recall, precision = len(got & want) / len(want), len(got & want) / len(got)
    assert recall >= 0.9 and precision >= 0.9, (recall, precision)


def test_what_is_learned(spark):
    groups = _held_out(random.Random(5), 300)
    texts = spark.createDataFrame([(x,) for g in groups for x in g], "surface string").distinct()
    v = names.learn(texts)
    assert len(v.learned_business) == 10 and len(v.learned_givens) >= 12 and not v.learned_kinds
    empty = names.learn(texts.limit(0))
    assert not empty.learned_business and not empty.learned_short
