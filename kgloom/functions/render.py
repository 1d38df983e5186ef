"""Deterministic texts: prompts and report lines, rendered as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions.text import local_hash_slash


def individual_block(s: Column, props: Column) -> Column:
    """A name and its properties, one per line in order, types left out."""
    entries = F.filter(F.map_entries(props), lambda e: e["key"] != "rdf_type")
    lines = F.transform(F.array_sort(entries), lambda e: F.concat(F.lit("  - "), e["key"], F.lit(": "), e["value"]))
    return F.concat(F.lit("* "), local_hash_slash(s), F.when(F.size(lines) > 0, F.concat(F.lit("\n"), F.array_join(lines, "\n"))).otherwise(""))


def blocks_text(bags: DataFrame) -> DataFrame:
    """text: the blocks of all individuals (s, props), in order of their names."""
    return bags.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", individual_block(F.col("s"), F.col("props")).alias("b")))), lambda x: x["b"]), "\n").alias("text"))


def condition(attribute: Column, operator: Column, value: Column, unit: Column) -> Column:
    return F.concat_ws(" ", attribute, operator, value, unit)


def rule_question(subject_type: Column, object_type: Column, attribute: Column, operator: Column, value: Column, unit: Column) -> Column:
    """What a rule asks of its pairs, in words."""
    whom = F.when(object_type.isNull(), F.concat(F.lit("each "), subject_type)).when(subject_type.isNull(), F.concat(F.lit("each "), object_type)).otherwise(F.concat(F.lit("each pair of "), subject_type, F.lit(" and "), object_type))
    return F.concat(F.lit("For "), whom, F.lit(": is "), condition(attribute, operator, value, unit), F.lit("?"))


def tbox_block(summary: DataFrame) -> DataFrame:
    """text: classes, object and datatype properties of a schema summary, each kind on one line."""
    ranged = F.concat("local_name", F.coalesce(F.concat(F.lit(" ("), F.col("range_local"), F.lit(")")), F.lit("")))
    kinds = summary.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_set(ranged)), ", ").alias("names"))
    place = F.when(F.col("kind") == "class", 1).when(F.col("kind") == "object", 2).otherwise(3)
    label = F.when(F.col("kind") == "class", "Classes: ").when(F.col("kind") == "object", "Object properties: ").otherwise("Datatype properties: ")
    return kinds.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("k"), F.concat(label, "names").alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def self_check_line(matched: Column, total: Column, coverage: Column) -> Column:
    return F.format_string("%d of %d facts found (%.1f %%)", matched, total, coverage * 100)
