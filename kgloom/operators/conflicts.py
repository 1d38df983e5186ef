"""Conflicts matched with rules one to one, and scored against the expected verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.functions.text import BAND, conflict_similarity
from kgloom.operators.align import greedy_matches
from kgloom.session import small_side


def conflict_scores(conflicts: DataFrame, rules: DataFrame, threshold: float = BAND) -> DataFrame:
    """arm, ix, rule_id, score of all conflicts and rules that fit at least by ``threshold``.

    Every conflict is held against every rule by meaning; the rules are few and broadcast if so.
    """
    r = rules.select("rule_id", "ord", "subject_type", "object_type", "attribute", "expected_violated")
    c = conflicts.select("arm", "ix", "subject", "object", "conflict_type")
    s = c.join(small_side(r), F.lit(True)).withColumn("score", conflict_similarity(*[F.col(x) for x in ("subject", "object", "conflict_type", "subject_type", "object_type", "attribute")]))
    return s.where(F.col("score") >= threshold).select("arm", "ix", "rule_id", "ord", "expected_violated", "score")


def score_rules(conflicts: DataFrame, rules: DataFrame, threshold: float = BAND) -> DataFrame:
    """arm, rule_id, outcome, match_score, matched_ix of every rule and arm.

    Violated rules take their conflicts first (TP, else FN); compliant ones match what is left (FP,
    else TN). A conflict that fits no rule counts nowhere; see :func:`unmatched`.
    """
    scored = conflict_scores(conflicts, rules, threshold)
    hits = greedy_matches(scored.where("expected_violated"), "arm", "ord", "ix", "score")
    rest = scored.where(~F.col("expected_violated")).join(hits.select("arm", "ix"), ["arm", "ix"], "left_anti")
    false = greedy_matches(rest, "arm", "ord", "ix", "score")
    every = rules.select("rule_id", "ord", "expected_violated").join(conflicts.select("arm").distinct(), F.lit(True))
    m = hits.unionAll(false)
    j = every.join(m, ["arm", "ord"], "left")
    hit = F.col("ix").isNotNull()
    outcome = F.when(F.col("expected_violated"), F.when(hit, "TP").otherwise("FN")).otherwise(F.when(hit, "FP").otherwise("TN"))
    return j.select("arm", "rule_id", outcome.alias("outcome"), F.coalesce("score", F.lit(0.0)).alias("match_score"), F.col("ix").alias("matched_ix"))


def unmatched(conflicts: DataFrame, scores: DataFrame) -> DataFrame:
    """Conflicts that no rule was matched with."""
    return conflicts.join(scores.where(F.col("matched_ix").isNotNull()).select("arm", F.col("matched_ix").alias("ix")), ["arm", "ix"], "left_anti")
