"""Documents written from triples: anchors, provenance, and a check of the text against the facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.text import citations, first_number, found_in_text, label_from_iri, local_any, local_hash_slash, looks_like_iri
from kgloom.providers.base import Provider
from kgloom.providers.functions import ask, raise_errors
from kgloom.session import cut


def anchor_map(entries: DataFrame, key: str = "id") -> DataFrame:
    """id, anchor: ``[T-001]`` and on by the order of ids; a repeated id has its last place.

    Places follow from counts per id over a range-partitioned sort, not from one global window.
    """
    n = entries.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # Written once: the sizes and the places must come from the same ranges.
    ranged = cut(n.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.sum("n").alias("size"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    w = Window.partitionBy("part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.join(F.broadcast(before), "part").select(key, (F.sum("n").over(w) + F.col("offset")).alias("place"))
    return placed.select(key, F.format_string("[T-%03d]", F.col("place")).alias("anchor"))


def paragraphs(drafts: DataFrame) -> DataFrame:
    """doc_id, paragraph_index, text, anchors of section drafts (doc_id, section_ix, paragraphs)."""
    p = drafts.select("doc_id", "section_ix", F.posexplode("paragraphs").alias("ix", "text"))
    w = Window.partitionBy("doc_id").orderBy("section_ix", "ix")
    return p.select("doc_id", (F.row_number().over(w) - 1).alias("paragraph_index"), "text", citations(F.col("text")).alias("anchors"))


def provenance(paras: DataFrame, anchors: DataFrame) -> DataFrame:
    """doc_id, paragraph_index, citation_anchors, triple_ids: unknown anchors name no triple."""
    rows = paras.select("doc_id", "paragraph_index", "anchors", F.posexplode_outer("anchors").alias("at", "anchor"))
    named = rows.join(anchors, "anchor", "left")
    ids = F.transform(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("at", "id")))), lambda x: x["id"])
    return named.groupBy("doc_id", "paragraph_index").agg(F.first("anchors").alias("citation_anchors"), ids.alias("triple_ids"))


def checkable(entries: DataFrame) -> DataFrame:
    """Entries whose object can stand in a text: no types, no IRIs without a datatype."""
    return entries.where((local_any(F.col("p")) != "type") & (F.col("o_datatype").isNotNull() | ~looks_like_iri(F.col("o"), F.col("o_datatype"))))


def self_check(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, triple_id, expected_object, found_number, match for each checkable entry of the document.

    ``entries``: doc_id, id, p, o, o_datatype; ``documents``: doc_id, text.
    """
    j = checkable(entries).join(documents.select("doc_id", "text"), "doc_id")
    return j.select("doc_id", F.col("id").alias("triple_id"), F.col("o").alias("expected_object"), first_number(F.col("o")).isNotNull().alias("numeric"), found_in_text(F.col("o"), F.col("text")).alias("match"))


def subject_groups(entries: DataFrame) -> DataFrame:
    """s, first, facts: entries grouped by subject in order of their first appearance."""
    return entries.groupBy("s").agg(F.min("ord").alias("first"), F.array_sort(F.collect_list(F.struct("ord", "p", "o", "id"))).alias("facts"))


def template_sections(entries: DataFrame, anchors: DataFrame) -> DataFrame:
    """s, section_ix, title, paragraph: a sentence per fact with its anchor, the offline synthesizer."""
    groups = subject_groups(entries.join(anchors, "id").withColumn("id", F.col("anchor")))
    sentence = F.transform("facts", lambda x: F.concat(label_from_iri(F.col("s")), F.lit(": "), label_from_iri(x["p"]), F.lit(" is "), F.when(x["o"].startswith("http"), local_hash_slash(x["o"])).otherwise(x["o"]), F.lit(" "), x["id"], F.lit(".")))
    return groups.select("s", F.col("first").alias("section_ix"), label_from_iri(F.col("s")).alias("title"), F.array_join(sentence, " ").alias("paragraph"))


def ask_sections(entries: DataFrame, anchors: DataFrame, factory: Callable[[], Provider]) -> DataFrame:
    """s, title, paragraphs: a section per subject as a provider writes it from its facts with anchors.

    An answer that leaves out an anchor, or makes one up, is an error of its row, which fails the query.
    """
    fact = F.struct(label_from_iri(F.col("p")).alias("predicate"), F.when(F.col("o").startswith("http"), local_hash_slash(F.col("o"))).otherwise(F.col("o")).alias("object"), "anchor")
    grouped = entries.join(anchors, "id").groupBy("s").agg(F.array_sort(F.collect_list(F.struct("ord", "p", "o", fact.alias("fact")))).alias("f"))
    asked = grouped.select("s", label_from_iri(F.col("s")).alias("label"), F.transform("f", lambda x: x["fact"]).alias("facts"))
    got = raise_errors(ask(asked, "synthesize", {"label": "label", "facts": "facts"}, factory))
    read = got.withColumn("a", F.from_json("answer", "title string, paragraphs array<string>"))
    cited = F.array_sort(F.array_distinct(F.flatten(F.transform("a.paragraphs", citations))))
    asked_for = F.array_sort(F.array_distinct(F.transform("facts", lambda x: x["anchor"])))
    whole = F.when(cited == asked_for, F.col("a.paragraphs")).otherwise(F.raise_error(F.concat(F.lit("other facts than asked for: "), F.col("s"))).cast("array<string>"))
    return read.select("s", F.col("a.title").alias("title"), whole.alias("paragraphs"))


def assemble(sections: DataFrame, doc_id: str, title: str) -> DataFrame:
    """doc_id, title, markdown of one document, sections in order."""
    body = F.array_sort(F.collect_list(F.struct("section_ix", F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.col("paragraph")).alias("t"))))
    return sections.agg(body.alias("b")).select(F.lit(doc_id).alias("doc_id"), F.lit(title).alias("title"), F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform("b", lambda x: x["t"]), "\n\n"), F.lit("\n")).alias("markdown"))
