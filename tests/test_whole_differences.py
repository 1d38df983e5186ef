"""Keys of several versions are compared whole, as the SQL of the query does."""

from __future__ import annotations

import duckdb

from kgloom.operators import reconcile
from kgloom.plans.problems import P3_SQL

SCHEMA = "triple_id string, s string, p string, o string"


def test_every_version_of_a_key_is_compared(spark, rows):
    live = [("k", "s", "p", "1"), ("k", "s", "p", "2"), ("m", "s", "p", "1"), ("m", "s", "q", "3"), ("l", "a", "p", "1"), ("l", "b", "p", "1"), ("same", "s", "p", "1"), ("e", "s", "p", "1"), ("e", "s", None, "1"), (None, "x", "y", "z")]
    copy = [("k", "s", "p", "1"), ("m", "s", "p", "1"), ("m", "t", "p", "1"), ("same", "s", "p", "1"), ("e", "s", "p", "1"), ("e", "s", None, "1"), ("n", "x", "y", "z"), ("n", "x", "y", "w")]
    a, b = (spark.createDataFrame(r, SCHEMA) for r in (live, copy))
    got = rows(reconcile.differences(a, b, "triple_id", ["s", "p", "o"], ("only_live", "only_copy")))
    assert [d for k, d in got if k == "k"] == ["o"]
    with duckdb.connect() as c:
        for name, data in (("triples", live), ("triples_copy", copy)):
            c.execute(f"CREATE TABLE {name} (triple_id VARCHAR, s VARCHAR, p VARCHAR, o VARCHAR)")
            c.executemany(f"INSERT INTO {name} VALUES (?, ?, ?, ?)", data)
        want = c.execute(P3_SQL).fetchall()
    assert got == sorted(want, key=repr)
