"""Table functions over a provider: extraction, mapping, judging, checking.

Each filters before it asks, asks once per row inside ``mapInArrow`` with a provider made in the
task, and gives results and errors as columns. Extraction, mapping and judging leave out rows that
failed and keep the error in ``error``; the others raise, with :func:`raise_errors`.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from kgloom.functions.lexical import RDF_TYPE, RDFS
from kgloom.functions.text import expand_datatype, make_iri, short_hash
from kgloom.operators.documents import eligible
from kgloom.providers.base import Provider, Request
from kgloom.session import small_side

ENTITIES = "array<struct<text_span:string,entity_type:string,confidence:double,attributes:array<struct<name:string,raw_text:string,value:string,unit:string>>,relationships:array<struct<predicate:string,target:string,raw_text:string>>>>"
MAPPED = "struct<subject:string,cls:string,description:string,triples:array<struct<predicate:string,object:string,datatype:string>>>"
RULES = "array<struct<subject:string,object:string,attribute:string,operator:string,value:string,reason:string>>"
CONFLICTS = "array<struct<subject:string,object:string,conflict_type:string,evidence:string>>"
STATEMENTS = "array<struct<subject:string,object:string,value:string,quote:string>>"
SYSTEM = {
    "extract": "List the things that the text names, with their measured attributes and relations, as JSON.",
    "map": "Give the subject name, class, description and statements for this thing, as JSON.",
    "same_entity": "Say whether the two names mean the same thing, as JSON.",
    "synthesize": "Write paragraphs that state every fact, each with its anchor, as JSON.",
    "plain_english": "State the rule in everyday words without its numbers, as JSON.",
    "check_document": "List every value that the text states for this attribute, with the names of the subject and, if it has a type, the object, and the sentence, as JSON.",
    "extract_direct": "List all statements of the text as subject, class, property and value, as JSON.",
    "discover_rules": "Propose rules that the individuals should obey, each with subject, object, attribute, operator, value and reason, as JSON.",
    "direct_conflicts": "List every conflict that the text states or shows, with subject, object, type and the sentence, as JSON.",
}


def ask(rows: DataFrame, task: str, payload: dict[str, str], factory: Callable[[], Provider], temperature: float = 0.0, max_tokens: int = 4096) -> DataFrame:
    """All columns of ``rows``, with ``answer`` (JSON or null), ``error``, ``input_tokens``, ``output_tokens``.

    ``payload``: name in the request -> column, given to the provider as JSON.
    """
    packed = rows.withColumn("__payload", F.to_json(F.struct(*[F.col(c).alias(k) for k, c in payload.items()]), {"ignoreNullFields": "false"}))
    answered = StructType([*rows.schema.fields, StructField("answer", StringType()), StructField("error", StringType()), StructField("input_tokens", LongType()), StructField("output_tokens", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        provider = factory()
        for b in batches:
            got: list[tuple[Any, ...]] = []
            for text in b.column(b.num_columns - 1).to_pylist():
                try:
                    r = provider.complete(Request(task, SYSTEM[task], text, json.loads(text), temperature, max_tokens))
                    got.append((json.dumps(r.value, ensure_ascii=False), None, r.usage.input_tokens, r.usage.output_tokens))
                except Exception as e:  # one row's failure is that row's
                    got.append((None, f"{type(e).__name__}: {e}", 0, 0))
            # The rows' own columns pass as they are.
            made = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=answered.names)

    return packed.mapInArrow(run, answered)


def raise_errors(answers: DataFrame) -> DataFrame:
    """Fail where a row has an error."""
    return answers.where(F.coalesce(F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).cast("boolean"), F.lit(True)))


def extract_entities(chunks: DataFrame, factory: Callable[[], Provider], classes: list[str] | None = None, least: int = 30) -> DataFrame:
    """Entities of all chunks of at least ``least`` characters, one row each; chunks that fail are left out."""
    rows = eligible(chunks, least).select(F.col("id").alias("chunk_id"), "text", F.array(*[F.lit(c) for c in classes or []]).cast("array<string>").alias("classes"))
    got = ask(rows, "extract", {"text": "text", "classes": "classes"}, factory).where(F.col("error").isNull())
    e = got.select("chunk_id", F.explode(F.from_json(F.get_json_object("answer", "$.entities"), ENTITIES)).alias("e"))
    return e.select(short_hash(F.col("chunk_id"), F.left(F.col("e.text_span"), F.lit(32)), sep=":").alias("id"), "chunk_id", "e.*", F.lit("llm").alias("extraction_method"))


def map_entities(entities: DataFrame, factory: Callable[[], Provider], namespace: str) -> DataFrame:
    """Proposed delta entries: the type, a comment where there is one, then the statements."""
    cols = ["id", "chunk_id", "text_span", "entity_type", "confidence", "attributes", "relationships"]
    rows = entities.select(*cols)
    got = ask(rows, "map", {c: c for c in cols if c != "chunk_id"}, factory, max_tokens=2048).where(F.col("error").isNull())
    m = got.withColumn("m", F.from_json("answer", MAPPED)).withColumn("s", make_iri(F.col("m.subject"), namespace))
    empty = F.lit(None).cast("string")
    typ = F.struct(F.lit(RDF_TYPE).alias("p"), make_iri(F.col("m.cls"), namespace).alias("o"), empty.alias("o_datatype"), empty.alias("o_lang"))
    comment = F.struct(F.lit(RDFS + "comment").alias("p"), F.col("m.description").alias("o"), empty.alias("o_datatype"), F.lit("en").alias("o_lang"))
    plain = F.filter("m.triples", lambda t: ~t["predicate"].isin("rdf:type", "type") & t["object"].isNotNull())

    def one(t):
        dt = expand_datatype(t["datatype"])
        obj = F.when(dt.isNotNull(), t["object"]).when(t["object"].rlike(r"(?U)^[\w_]+$"), make_iri(t["object"], namespace)).otherwise(t["object"])
        return F.struct(make_iri(t["predicate"], namespace).alias("p"), obj.alias("o"), dt.alias("o_datatype"), empty.alias("o_lang"))

    every = F.concat(F.array(typ), F.when(F.trim("m.description") != "", F.array(comment)).otherwise(F.slice(F.array(comment), 1, 0)), F.transform(plain, one))
    out = m.select(F.col("id").alias("source_entity_id"), F.col("chunk_id").alias("source_chunk_id"), "confidence", "s", F.posexplode(every).alias("ord", "t"))
    return out.select(short_hash(F.col("s"), F.col("t.p"), F.col("t.o")).alias("id"), "s", "t.*", "ord", "confidence", "source_entity_id", "source_chunk_id", F.lit("EXTRACTION").alias("change_source"), F.lit("proposed").alias("status"))


def judge_pairs(pairs: DataFrame, factory: Callable[[], Provider], low: float = 0.40, high: float = 0.85) -> DataFrame:
    """candidate_id, same_entity, confidence, canonical for pairs in the band; failures have no row."""
    band = pairs.where((F.col("score") >= low) & (F.col("score") < high)).select(F.col("id").alias("candidate_id"), F.col("surface_a").alias("a"), F.col("surface_b").alias("b"))
    got = ask(band, "same_entity", {"a": "a", "b": "b"}, factory, max_tokens=256).where(F.col("error").isNull())
    return got.select("candidate_id", F.from_json("answer", "same_entity boolean, confidence double, canonical string").alias("j")).select("candidate_id", "j.*")


def plain_english(rules: DataFrame, factory: Callable[[], Provider]) -> DataFrame:
    """Rules with ``plain_english`` filled where it was blank; others are not asked about."""
    blank = F.coalesce(F.trim("plain_english"), F.lit("")) == ""
    asked = raise_errors(ask(rules.where(blank).drop("plain_english"), "plain_english", {c: c for c in ("subject_type", "object_type", "attribute")}, factory))
    done = asked.withColumn("plain_english", F.get_json_object("answer", "$.text")).select(*rules.columns)
    return rules.where(~blank).unionByName(done)


def check_documents(rules: DataFrame, documents: DataFrame, factory: Callable[[], Provider]) -> DataFrame:
    """doc_id, rule_id, subject, object, value, quote: each statement of a document on a rule's attribute.

    The attribute is the object's, or the subject's for a rule without object type. A document that
    states nothing on a rule has one row of nulls for it.
    """
    asked = rules.select("rule_id", "subject_type", "object_type", "attribute")
    every = documents.select("doc_id", "text").join(small_side(asked), F.lit(True))
    got = raise_errors(ask(every, "check_document", {c: c for c in ("text", "subject_type", "object_type", "attribute")}, factory))
    stated = F.from_json(F.get_json_object("answer", "$.statements"), STATEMENTS)
    whole = F.coalesce(stated, F.raise_error(F.lit("an answer without statements")).cast(STATEMENTS))
    return got.select("doc_id", "rule_id", F.explode_outer(whole).alias("x")).select("doc_id", "rule_id", "x.*")


def extract_direct(documents: DataFrame, factory: Callable[[], Provider], classes: list[str] | None = None) -> DataFrame:
    """doc_id, subject, cls, property, value in one step, without chunks, mapping or alignment."""
    rows = documents.select("doc_id", "text", F.array(*[F.lit(c) for c in classes or []]).cast("array<string>").alias("classes"))
    got = raise_errors(ask(rows, "extract_direct", {"text": "text", "classes": "classes"}, factory, max_tokens=8192))
    return got.select("doc_id", F.inline(F.from_json(F.get_json_object("answer", "$.triples"), "array<struct<subject:string,cls:string,property:string,value:string>>")))


def discover_rules(bags: DataFrame, factory: Callable[[], Provider], batch: int = 500) -> DataFrame:
    """rule_id, subject, object, attribute, operator, value, reason: rules that a provider proposes for individuals.

    ``bags``: s and props (a map of texts), as of ``graph.conflict_bags``. Individuals are asked about in
    batches of about ``batch``, by a hash of their name, so a request is bounded and batches are asked in
    parallel. Rules without attribute, operator or value are left out; the same rule counts once.
    """
    n = bags.count()
    who = F.regexp_extract("s", r"[^#/]*\z", 0)
    known = bags.groupBy(F.pmod(F.xxhash64("s"), F.lit(max(1, -(-n // batch)))).alias("part")).agg(F.array_sort(F.collect_list(F.struct(who.alias("name"), F.to_json("props").alias("facts")))).alias("individuals"))
    got = raise_errors(ask(known, "discover_rules", {"individuals": "individuals"}, factory, max_tokens=8192))
    rules = got.select(F.explode(F.from_json(F.get_json_object("answer", "$.rules"), RULES)).alias("r")).select("r.*")
    whole = rules.where(F.col("attribute").isNotNull() & F.col("operator").isin(">", "<", ">=", "<=", "==", "!=") & F.col("value").isNotNull() & F.coalesce("object", "subject").isNotNull())
    names = ("subject", "object", "attribute", "operator", "value")
    return whole.groupBy(*names).agg(F.min("reason").alias("reason")).select(short_hash(*[F.col(c) for c in names]).alias("rule_id"), *names, "reason")


def direct_conflicts(documents: DataFrame, factory: Callable[[], Provider]) -> DataFrame:
    """doc_id, subject, object, conflict_type, evidence: conflicts read from whole documents, without a graph."""
    got = raise_errors(ask(documents.select("doc_id", "text"), "direct_conflicts", {"text": "text"}, factory, max_tokens=8192))
    return got.select("doc_id", F.inline(F.from_json(F.get_json_object("answer", "$.conflicts"), CONFLICTS))).where(F.col("subject").isNotNull()).distinct()


def token_usage(answers: DataFrame, by: list[str]) -> DataFrame:
    return answers.groupBy(*by).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
