"""Pairwise matches consolidated into groups: connected components.

Every round propagates the minimum label across all edges, flattens the resulting forest by
pointer jumping, and replaces the edges by those between different labels. What is left shrinks
with every round; the loop ends when no edge joins two labels, that is when no label can change.
Each step is cut by a table written to the shared folder (``session.cut``; not ``checkpoint()``, whose
plan keeps the constraints of all rounds), so lineage stays short and a lost executor costs one step;
a table is dropped once nothing reads it any more.

Minima are aggregated before the shuffle, so a node that holds a third of all edges arrives as one
row per task; the joins that relabel edges have one row per node on the other side and are split
where a key is hot (``session.skew_safe_join``). Nothing is collected but two counts per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.session import cut, drop, rename_cut, skew_safe_join


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, group: every node of an edge with the smallest node that it is linked to.

    Edges with a null end and from a node to itself are ignored, as are repeated edges, their
    direction, and other columns. A node without any other has no row. Empty edges give no rows.
    """
    left, right = F.col(a), F.col(b)
    links = cut(edges.where(left != right).select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b")).distinct())
    labels = None
    while not links.isEmpty():
        parent = _flat(cut(_smallest_neighbours(links)))
        if labels is None:
            relabelled = parent
        else:
            up = parent.select(F.col("node").alias("group"), F.col("group").alias("__g"))
            relabelled = cut(skew_safe_join(labels, up, "group", "left").select("node", F.coalesce("__g", "group").alias("group")))
        shorter = cut(_between_labels(links, parent))
        drop(links, labels, None if parent is relabelled else parent)
        labels, links = relabelled, shorter
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("group"))
    return labels


def _smallest_neighbours(links: DataFrame) -> DataFrame:
    """For every node the smaller of itself and its smallest neighbour."""
    both = links.select(F.col("a").alias("node"), F.col("a").alias("x")).unionAll(links.select(F.col("b").alias("node"), F.col("a").alias("x")))
    return both.groupBy("node").agg(F.min("x").alias("group"))


def _flat(parent: DataFrame) -> DataFrame:
    """Pointer jumping: every label replaced by the label's own, until none changes."""
    while True:
        up = parent.select(F.col("node").alias("group"), F.col("group").alias("__g"))
        jumped = cut(skew_safe_join(parent, up, "group", "left").select("node", F.coalesce("__g", "group").alias("group"), (F.col("__g") != F.col("group")).alias("moved")))
        if jumped.where("moved").isEmpty():
            drop(jumped)
            return parent
        drop(parent)
        parent = rename_cut(jumped, jumped.drop("moved"))


def _between_labels(links: DataFrame, parent: DataFrame) -> DataFrame:
    """The edges between the labels of their ends, without those inside one label."""
    x = parent.select(F.col("node").alias("a"), F.col("group").alias("x"))
    y = parent.select(F.col("node").alias("b"), F.col("group").alias("y"))
    joined = skew_safe_join(skew_safe_join(links, x, "a"), y, "b").where(F.col("x") != F.col("y"))
    return joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def decisions_in_force(decisions: DataFrame) -> DataFrame:
    """Per candidate the decision decided last; of equal times the one recorded last.

    A null time is before any other. Decisions without candidate stand each for themselves.
    ``key`` identifies the decision, ``ids`` are the entity ids it names itself, without nulls.
    """
    named = decisions.select(
        F.coalesce(F.col("candidate_id"), F.concat(F.lit("\u0000"), F.col("ord").cast("string"))).alias("key"),
        F.struct("decided_at", "ord", "status", "canonical_entity_id", "merged_entity_ids", "aliases", "candidate_id").alias("d"),
    )
    last = named.groupBy("key").agg(F.max("d").alias("d")).select("key", "d.*")
    own = F.concat(F.array("canonical_entity_id"), F.coalesce("merged_entity_ids", F.array().cast("array<string>")))
    return last.withColumn("ids", F.array_distinct(F.array_compact(own)))


def approved_decisions(decisions: DataFrame) -> DataFrame:
    """The approved among the decisions in force."""
    return decisions_in_force(decisions).where(F.col("status") == "approved")


def decision_links(approved: DataFrame, candidates: DataFrame) -> DataFrame:
    """a, b: what approved decisions and the rows of their candidates say belongs together."""
    first = F.array_min("ids")
    own = approved.select(first.alias("a"), F.explode("ids").alias("b"))
    pairs = candidates.select(F.col("id").alias("candidate_id"), "entity_id_a", "entity_id_b").where(F.col("candidate_id").isNotNull()).distinct()
    named = pairs.join(approved.where(F.col("candidate_id").isNotNull()).select("candidate_id", first.alias("first")), "candidate_id")
    ends = named.select(F.array_distinct(F.array_compact(F.array("first", "entity_id_a", "entity_id_b"))).alias("ids"))
    return own.unionAll(ends.select(F.array_min("ids").alias("a"), F.explode("ids").alias("b")))


def mention_groups(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """group_id, entity_id: every linked mention with the smallest id of its whole group."""
    links = decision_links(cut(approved_decisions(decisions)), candidates)
    return connected_components(links).select(F.col("group").alias("group_id"), F.col("node").alias("entity_id"))
