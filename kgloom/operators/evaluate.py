"""Precision, recall and F1 of one graph against another, of rule sets, and arms compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.operators.graph import individuals, subject_triples
from kgloom.session import small_side


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def prf(hits: Column, expected: Column, predicted: Column) -> list[Column]:
    p, r = ratio(hits, predicted), ratio(hits, expected)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1")]


def sides(source: DataFrame, working: DataFrame, keys: list[str]) -> DataFrame:
    """keys, in_source, in_working: both sets in one aggregation."""
    both = source.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(working.select(*keys, F.lit(0), F.lit(1)))
    return both.groupBy(*keys).agg((F.max("a") == 1).alias("in_source"), (F.max("b") == 1).alias("in_working"))


def compare_sets(source: DataFrame, working: DataFrame, keys: list[str]) -> DataFrame:
    """One row: n_source, n_working, recovered, missed, extra, precision, recall, f1."""
    c = sides(source, working, keys).agg(
        F.count_if("in_source").alias("n_source"), F.count_if("in_working").alias("n_working"), F.count_if(F.col("in_source") & F.col("in_working")).alias("recovered"),
        F.count_if(F.col("in_source") & ~F.col("in_working")).alias("missed"), F.count_if(~F.col("in_source") & F.col("in_working")).alias("extra"),
    )
    return c.select("*", *prf(F.col("recovered"), F.col("n_source"), F.col("n_working")))


def classify(source: DataFrame, working: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side: ``recovered``, ``missed`` or ``extra``."""
    side = F.when(F.col("in_source") & F.col("in_working"), "recovered").when(F.col("in_source"), "missed").otherwise("extra")
    return sides(source, working, keys).select(*keys, side.alias("side"))


def evaluate(source: DataFrame, working: DataFrame) -> DataFrame:
    """Two rows, for individuals and for their triples."""
    a, b = individuals(source), individuals(working)
    one = compare_sets(a, b, ["s"]).withColumn("level", F.lit("individuals"))
    return one.unionByName(compare_sets(subject_triples(source, a), subject_triples(working, b), ["s", "p", "o"]).withColumn("level", F.lit("triples")))


def outcome_prf(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn and P/R/F1 of scored rules (column ``outcome``)."""
    counts = [F.count_if(F.col("outcome") == x.upper()).alias(x) for x in ("tp", "fp", "fn", "tn")]
    c = scores.groupBy(*(by or [])).agg(*counts)
    return c.select("*", *prf(F.col("tp"), F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp")))


def rule_set_score(predicted: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    """Per scenario and arm: P/R/F1 of rule ids, case apart, to four places; 0 for empty sets.

    ``predicted`` and ``truth`` have ``by`` and ``rule_id``; truth may have fewer of the ``by`` columns.
    """
    a = predicted.select(*by, F.lower("rule_id").alias("rule_id")).distinct()
    shared = [c for c in by if c in truth.columns]
    b = truth.select(*shared, F.lower("rule_id").alias("rule_id")).where(F.col("rule_id").isNotNull()).distinct()
    groups = predicted.select(*by).distinct()
    want = groups.join(b, shared) if shared else groups.join(small_side(b), F.lit(True))
    hits = sides(want, a.where(F.col("rule_id").isNotNull()), [*by, "rule_id"]).groupBy(*by).agg(F.count_if(F.col("in_source") & F.col("in_working")).alias("h"), F.count_if("in_source").alias("t"), F.count_if("in_working").alias("p"))
    full = groups.join(hits, by, "left").select(*by, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("h", "t", "p")])
    return full.select(*by, F.col("p").alias("n_predicted"), F.col("t").alias("n_truth"), *[F.round(c, 4).alias(n) for c, n in zip(prf(F.col("h"), F.col("t"), F.col("p")), ("precision", "recall", "f1"))])


def winner(scores: DataFrame, by: list[str], arm: str, score: str, single: str = "arm") -> DataFrame:
    """by, winner: the arm with the best score, null on a tie.

    ``single``: what a lone arm gives, ``arm`` itself or ``none``; ``pair`` asks for exactly two arms.
    """
    g = scores.groupBy(*by).agg(F.max(score).alias("best"), F.count(F.lit(1)).alias("n"), F.max_by(arm, score).alias("top"), F.sort_array(F.collect_list(score), asc=False).alias("all"))
    tie = (F.size("all") > 1) & (F.element_at("all", 1) == F.try_element_at("all", F.lit(2)))
    enough = {"arm": F.lit(True), "none": F.col("n") >= 2, "pair": F.col("n") == 2}[single]
    return g.select(*by, F.when(enough & ~tie, F.col("top")).alias("winner"))


def agreement(rules: DataFrame, violations: DataFrame, arm_a: str, arm_b: str) -> DataFrame:
    """rule_id, agreement: whether both arms, one or neither found the rule violated."""
    hit = violations.groupBy("rule_id").agg(F.bool_or((F.col("arm") == arm_a) & F.col("violated")).alias("a"), F.bool_or((F.col("arm") == arm_b) & F.col("violated")).alias("b"))
    j = rules.select("rule_id").distinct().join(hit, "rule_id", "left")
    a, b = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    return j.select("rule_id", F.when(a & b, "agree-both").when(a, f"{arm_a}-only").when(b, f"{arm_b}-only").otherwise("agree-neither").alias("agreement"))


def overlap(conflicts: DataFrame, arm_a: str, arm_b: str) -> DataFrame:
    """n_shared, n_a, n_b of different (subject, object) pairs; no row unless both arms found some."""
    pairs = conflicts.select("arm", "subject", F.coalesce("object", F.lit("")).alias("object"))
    m = sides(pairs.where(F.col("arm") == arm_a), pairs.where(F.col("arm") == arm_b), ["subject", "object"])
    c = m.agg(F.count_if(F.col("in_source") & F.col("in_working")).alias("n_shared"), F.count_if(F.col("in_source") & ~F.col("in_working")).alias("n_a"), F.count_if(~F.col("in_source") & F.col("in_working")).alias("n_b"))
    return c.where((F.col("n_shared") + F.col("n_a") > 0) & (F.col("n_shared") + F.col("n_b") > 0))


def coverage(checks: DataFrame, by: list[str]) -> DataFrame:
    """by, n_matched, n_total, coverage; 1 where nothing is to be checked (given as a null match)."""
    c = checks.groupBy(*by).agg(F.count_if("match").alias("n_matched"), F.count("match").alias("n_total"))
    return c.select("*", F.coalesce(F.try_divide(F.col("n_matched"), F.col("n_total")), F.lit(1.0)).alias("coverage"))
