"""Rules over typed individuals: pairing, thresholds, class aggregates, changes and their impact.

A rule compares one attribute of its objects (of its subjects, if it has no object type) with a
threshold. Verdicts are per subject and object. The threshold is evaluated on the object side, per
rule and object, before any pairing, so what is paired are verdicts, and counts per rule need no
pairs at all (:func:`pair_counts`).

Rules are a table: rule_id, subject_type, object_type, attribute, operator, value, unit, severity,
aggregate (each, sum, min, max, avg, count; null is each). Facts are typed attributes: cls, s,
attribute, value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions.lexical import RDF_TYPE
from kgloom.functions.text import compare, local_hash_slash
from kgloom.session import small_side


def typed_facts(triples: DataFrame) -> DataFrame:
    """cls, s, attribute, value: every attribute value of every subject under each of its types."""
    types = triples.where(F.col("p") == RDF_TYPE).select("s", local_hash_slash(F.col("o")).alias("cls"))
    values = triples.where((F.col("p") != RDF_TYPE) & (F.coalesce(F.col("o_kind"), F.lit("iri")) != "bnode")).select("s", local_hash_slash(F.col("p")).alias("attribute"), F.col("o").alias("value"))
    return types.join(values, "s").select("cls", "s", "attribute", "value").distinct()


def typed_subjects(triples: DataFrame) -> DataFrame:
    return triples.where(F.col("p") == RDF_TYPE).select("s", local_hash_slash(F.col("o")).alias("cls")).distinct()


def object_verdicts(rules: DataFrame, subjects: DataFrame, facts: DataFrame) -> DataFrame:
    """rule_id, object, value, violated: the threshold on the side that carries the attribute.

    One row per object of the rule's class (of its subjects for a rule without object type). An
    object of several values has the first by text; of none, a null value and no violation.
    """
    on = F.coalesce(F.col("object_type"), F.col("subject_type"))
    r = small_side(rules.select("rule_id", on.alias("cls"), "attribute", "operator", F.col("value").alias("threshold")))
    targets = subjects.join(r, "cls")
    one = facts.groupBy("cls", "s", "attribute").agg(F.min("value").alias("value"))
    j = targets.join(one, ["cls", "s", "attribute"], "left")
    return j.select("rule_id", F.col("s").alias("object"), "value", F.coalesce(compare(F.col("value"), F.col("operator"), F.col("threshold")), F.lit(False)).alias("violated"))


def check_pairs(rules: DataFrame, subjects: DataFrame, facts: DataFrame) -> DataFrame:
    """rule_id, subject, object, value, violated: a row per pair that the rule speaks of.

    A rule without object type has its subjects as ``subject``; one without subject type has one row
    per object with a null subject. The pairs of a rule are the product of two classes by meaning.
    """
    verdicts = object_verdicts(rules, subjects, facts)
    kinds = small_side(rules.select("rule_id", "subject_type", "object_type"))
    v = verdicts.join(kinds, "rule_id")
    single = v.where(F.col("object_type").isNull()).select("rule_id", F.col("object").alias("subject"), F.lit(None).cast("string").alias("object"), "value", "violated")
    anyone = v.where(F.col("object_type").isNotNull() & F.col("subject_type").isNull()).select("rule_id", F.lit(None).cast("string").alias("subject"), "object", "value", "violated")
    pairs = v.where(F.col("object_type").isNotNull() & F.col("subject_type").isNotNull())
    s = subjects.select(F.col("cls").alias("subject_type"), F.col("s").alias("subject"))
    return pairs.join(s, "subject_type").select("rule_id", "subject", "object", "value", "violated").unionAll(single).unionAll(anyone)


def pair_counts(rules: DataFrame, subjects: DataFrame, facts: DataFrame) -> DataFrame:
    """rule_id, n_pairs, n_violated: as counting :func:`check_pairs`, without forming a pair."""
    verdicts = object_verdicts(rules, subjects, facts).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("violated").alias("v"))
    sizes = subjects.groupBy(F.col("cls").alias("subject_type")).agg(F.count(F.lit(1)).alias("m"))
    r = rules.select("rule_id", "subject_type", "object_type").join(verdicts, "rule_id", "left").join(sizes, "subject_type", "left")
    times = F.when(F.col("object_type").isNull() | F.col("subject_type").isNull(), F.lit(1)).otherwise(F.coalesce("m", F.lit(0)))
    return r.select("rule_id", (F.coalesce("n", F.lit(0)) * times).alias("n_pairs"), (F.coalesce("v", F.lit(0)) * times).alias("n_violated"))


def check_aggregates(rules: DataFrame, facts: DataFrame) -> DataFrame:
    """rule_id, value, violated of rules on a class as a whole: sum, min, max, avg or count."""
    r = small_side(rules.where(F.coalesce("aggregate", F.lit("each")) != "each").select("rule_id", F.coalesce("object_type", "subject_type").alias("cls"), "attribute", "aggregate", "operator", F.col("value").alias("threshold")))
    x = F.col("value").try_cast("double")
    g = r.join(facts.select("cls", "attribute", "s", "value").distinct(), ["cls", "attribute"], "left").groupBy("rule_id", "aggregate", "operator", "threshold").agg(
        F.sum(x).alias("sum"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("avg"), F.count(x).cast("double").alias("count")
    )
    value = F.when(F.col("aggregate") == "sum", F.col("sum")).when(F.col("aggregate") == "min", F.col("min")).when(F.col("aggregate") == "max", F.col("max")).when(F.col("aggregate") == "avg", F.col("avg")).otherwise(F.col("count"))
    return g.select("rule_id", value.alias("value"), F.coalesce(compare(value.cast("string"), F.col("operator"), F.col("threshold")), F.lit(False)).alias("violated"))


def source_refs(verdicts: DataFrame, rules: DataFrame) -> DataFrame:
    """Verdicts with ``source_ref``: whose attribute has what value and unit; null without a value."""
    r = small_side(rules.select("rule_id", "attribute", "unit"))
    name = local_hash_slash(F.coalesce("object", "subject"))
    text = F.concat(name, F.lit(" · "), F.col("attribute"), F.lit(" = "), F.col("value"), F.coalesce(F.concat(F.lit(" "), F.col("unit")), F.lit("")))
    return verdicts.join(r, "rule_id").withColumn("source_ref", text).drop("attribute", "unit")


def rule_summary(verdicts: DataFrame) -> DataFrame:
    """rule_id, n, n_violated, any_violated."""
    return verdicts.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("violated").alias("n_violated"), F.bool_or("violated").alias("any_violated"))


def condition_text(attribute: Column, operator: Column, value: Column, unit: Column) -> Column:
    return F.concat_ws(" ", attribute, operator, value, unit)


def violated_under(rules: DataFrame, triples: DataFrame, changes: DataFrame) -> DataFrame:
    """scenario_id, rule_id: rules violated under each scenario's changes, all scenarios in one pass.

    A change touches one attribute of one subject, so only the verdict of that object can differ
    from the unchanged graph: the baseline is evaluated once, and per scenario only the touched
    objects anew. ``changes``: scenario_id, s, p, new_value with full IRIs.
    """
    subjects, facts = typed_subjects(triples), typed_facts(triples)
    base = object_verdicts(rules, subjects, facts)
    r = small_side(rules.select("rule_id", F.coalesce("object_type", "subject_type").alias("cls"), "attribute", "operator", F.col("value").alias("threshold")))
    new = changes.select("scenario_id", "s", local_hash_slash(F.col("p")).alias("attribute"), "new_value").join(subjects, "s").join(r, ["cls", "attribute"])
    new = new.groupBy("scenario_id", "rule_id", F.col("s").alias("object"), "operator", "threshold").agg(F.min("new_value").alias("v"))
    new = new.select("scenario_id", "rule_id", "object", F.coalesce(compare(F.col("v"), F.col("operator"), F.col("threshold")), F.lit(False)).alias("now"))
    before = base.where("violated").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    scenarios = changes.select("scenario_id").distinct()
    every = rules.select("rule_id").join(before, "rule_id", "left").crossJoin(scenarios)
    delta = new.join(base.select("rule_id", "object", "violated"), ["rule_id", "object"]).groupBy("scenario_id", "rule_id").agg(F.sum(F.col("now").cast("int") - F.col("violated").cast("int")).alias("d"))
    left = F.coalesce("n", F.lit(0)) + F.coalesce("d", F.lit(0))
    return every.join(delta, ["scenario_id", "rule_id"], "left").where(left > 0).select("scenario_id", "rule_id")
