"""The best representative of each duplicate group, chosen field by field.

Records are ranked within their group by completeness, trust and recency with a deterministic
tie-break, and the top record is kept. :func:`surviving_mentions` ranks field by field: first the
records that have the field, then by trust (for the surface) and recency; :func:`surviving_records`
keeps one whole record, the one with most of its fields filled. The rank is a window ordering filtered to its first row, of
which Spark keeps only the first row per group already before the shuffle; a group that holds a
third of all records therefore arrives as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.lexical import strip
from kgloom.llm.groups import approved_decisions, connected_components, decision_links
from kgloom.session import cut

# Who is trusted before whom; anyone else comes last.
TRUST = ("reviewer", "rule", "llm")


def completeness(columns: Sequence[str]) -> Column:
    """How many of the columns are filled; blank strings are not."""
    return sum((F.when(F.col(c).isNotNull() & (strip(F.col(c).cast("string")) != ""), 1).otherwise(0) for c in columns), F.lit(0))


def trust(who: str, order: Sequence[str] = TRUST) -> Column:
    """0 for the most trusted; an unknown or null judge is trusted least."""
    rank = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        rank = F.when(F.col(who) == name, i).otherwise(rank)
    return rank


def top_record(records: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """The first record of each group in the given order, which must tell all records apart.

    Nulls sort as the order's columns say. Records with a null group are left out; groups without
    records have no row.
    """
    w = Window.partitionBy(group).orderBy(*order)
    return records.where(F.col(group).isNotNull()).withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") == 1).drop("__rank")


def placed_decisions(decisions: DataFrame, candidates: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The approved decisions in force with their ``group_id``.

    ``groups`` (group_id, entity_id) are those of :func:`groups.mention_groups`, where they are stored
    already; else they are made. A decision outside every group is left out.
    """
    approved = cut(approved_decisions(decisions))
    if groups is None:
        node = connected_components(decision_links(approved, candidates))
    else:
        node = groups.select(F.col("entity_id").alias("node"), F.col("group_id").alias("group"))
    # One id of the decision finds its group: an own one, else one of its candidate's row.
    ends = candidates.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("candidate_id")).agg(F.min(F.least("entity_id_a", "entity_id_b")).alias("__end"))
    placed = approved.join(ends, "candidate_id", "left").withColumn("node", F.coalesce(F.array_min("ids"), "__end"))
    placed = placed.join(node, "node").select(F.col("group").alias("group_id"), "candidate_id", "decided_at", "ord", "canonical_entity_id", "merged_entity_ids", "aliases")
    return cut(placed)


def aliases(column: Column) -> Column:
    """The different aliases after trimming, without blank ones; null gives none."""
    trimmed = F.transform(F.coalesce(column, F.array().cast("array<string>")), strip)
    return F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != "")))


def surviving_records(decisions: DataFrame, judgments: DataFrame, candidates: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """group_id, candidate_id, canonical_entity_id, n_aliases, n_filled: the best decision of each group as it is.

    Most complete first (canonical entity, merged ids and aliases, each filled or not), then the one
    whose pair the most trusted judge calls the same, then the latest, then the one recorded last.
    """
    placed = placed_decisions(decisions, candidates, groups).withColumn("n_aliases", F.size(aliases(F.col("aliases"))))
    filled = F.col("canonical_entity_id").isNotNull().cast("int") + F.coalesce((F.size(F.array_compact("merged_entity_ids")) > 0).cast("int"), F.lit(0)) + (F.col("n_aliases") > 0).cast("int")
    judged = judgments.where(F.col("same_entity") & F.col("candidate_id").isNotNull()).groupBy("candidate_id").agg(F.min(trust("judged_by")).alias("__trust"))
    ranked = placed.withColumn("n_filled", filled).join(judged, "candidate_id", "left")
    best = top_record(ranked, "group_id", [F.desc("n_filled"), F.asc_nulls_last("__trust"), F.desc_nulls_last("decided_at"), F.desc("ord"), F.col("canonical_entity_id")])
    return best.select("group_id", "candidate_id", "canonical_entity_id", "n_aliases", "n_filled")


def surviving_mentions(decisions: DataFrame, judgments: DataFrame, candidates: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """group_id, canonical_entity_id, canonical_surface, n_aliases of every group that has both.

    canonical_entity_id: the non-null one decided last; of equal times the one recorded last.
    canonical_surface: the text judged by the most trusted, then latest, among judgments that call
    the pair the same and name one of its two surfaces; of equal ones the smaller text; blank
    texts are none. n_aliases: different aliases after trimming, blank ones apart.
    """
    placed = placed_decisions(decisions, candidates, groups)
    surfaces = candidates.where(F.col("id").isNotNull()).select(F.col("id").alias("candidate_id"), F.explode(F.array("surface_a", "surface_b")).alias("canonical_surface")).distinct()
    # Completeness comes first: a record without the field is ranked behind all that have it.
    entity = top_record(placed, "group_id", [F.desc(completeness(["canonical_entity_id"])), F.desc_nulls_last("decided_at"), F.desc("ord"), F.col("canonical_entity_id")]).where(F.col("canonical_entity_id").isNotNull())
    same = judgments.where(F.col("same_entity")).select("candidate_id", "judged_by", "judged_at", "canonical_surface")
    members = placed.where(F.col("candidate_id").isNotNull()).select("candidate_id", "group_id")
    named = same.join(surfaces, ["candidate_id", "canonical_surface"], "left_semi").join(members, "candidate_id")
    surface = top_record(named, "group_id", [F.desc(completeness(["canonical_surface"])), trust("judged_by"), F.desc_nulls_last("judged_at"), F.col("canonical_surface")]).where(strip(F.col("canonical_surface")) != "")
    alias = placed.select("group_id", F.explode(aliases(F.col("aliases"))).alias("x")).distinct()
    counts = alias.groupBy("group_id").agg(F.count(F.lit(1)).cast("int").alias("n_aliases"))
    return (
        entity.select("group_id", "canonical_entity_id")
        .join(surface.select("group_id", "canonical_surface"), "group_id")
        .join(counts, "group_id", "left")
        .select("group_id", "canonical_entity_id", "canonical_surface", F.coalesce("n_aliases", F.lit(0)).alias("n_aliases"))
    )
