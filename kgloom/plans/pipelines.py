"""Whole workloads as lazy plans: ingest, rules and impact, conflicts, reconstruction.

Each function gives named DataFrames. What several of them use is cut once, so that no provider is
asked twice for the same row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.functions.lexical import OWL, RDF_TYPE, RDFS, XSD, local_name, with_canonical
from kgloom.functions.text import compare, looks_like_iri, object_kind
from kgloom.operators import align, conflicts, documents, evaluate, graph, rules
from kgloom.operators.graph import FIELDS
from kgloom.providers import functions as llm_functions
from kgloom.providers.base import Provider
from kgloom.session import cut, small_side

Factory = Callable[[], Provider]


def approve(delta: DataFrame) -> DataFrame:
    """Proposed entries approved; others keep their status."""
    return delta.withColumn("status", F.when(F.col("status") == "proposed", "approved").otherwise(F.col("status")))


def review(delta: DataFrame, reviews: DataFrame) -> DataFrame:
    """Entries with a reviewer's last word (id, action, new_object, note): approve, reject or edit.

    An edited entry is approved with its new object and keeps its id; skipped ones stay as they are.
    """
    last = reviews.groupBy("id").agg(F.max_by(F.struct("action", "new_object", "note"), "ord").alias("r"))
    j = delta.join(last, "id", "left")
    action = F.col("r.action")
    status = F.when(action.isin("approve", "edit"), "approved").when(action == "reject", "rejected").otherwise(F.col("status"))
    obj = F.when((action == "edit") & F.col("r.new_object").isNotNull(), F.col("r.new_object")).otherwise(F.col("o"))
    return j.withColumns({"status": status, "o": obj, "reviewer_note": F.col("r.note")}).drop("r")


def entries_to_graph(entries: DataFrame) -> DataFrame:
    """Triples of the approved entries; edited ones are approved, others are not."""
    ok = entries.where(F.col("status") == "approved")
    kind = F.when(F.col("p") == RDF_TYPE, "iri").otherwise(object_kind(F.col("o"), F.col("o_datatype"), F.col("o_lang")))
    return ok.select("s", F.lit("iri").alias("s_kind"), "p", "o", kind.alias("o_kind"), "o_datatype", "o_lang").distinct()


def working_graph(tbox: DataFrame, entries: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The schema and the approved entries, added to what exists unless started afresh."""
    g = graph.add(tbox, entries_to_graph(entries))
    return g if existing is None else graph.add(existing, g)


def alt_labels(delta: DataFrame, mapping: DataFrame) -> DataFrame:
    """s, p, o: the name of every merged subject as another label of the one it became."""
    label = "http://www.w3.org/2004/02/skos/core#altLabel"
    merged = mapping.join(delta.select(F.col("s").alias("old")).distinct(), "old", "left_semi")
    return merged.select(F.col("new").alias("s"), F.lit(label).alias("p"), F.regexp_extract("old", r"[^#/]*\z", 0).alias("o")).distinct()


def locals_under(triples: DataFrame, namespace: str) -> DataFrame:
    """name: local names of the individuals of a namespace."""
    own = graph.individuals(triples).where(F.col("s").startswith(namespace))
    return own.select(F.substring(F.col("s"), F.lit(len(namespace) + 1), F.length("s")).alias("name"))


def graph_hash(triples: DataFrame) -> DataFrame:
    """sha256: of the graph as a set, whatever the order of its rows.

    Hashes of rows are summed before they are hashed, so nothing is gathered or sorted.
    """
    h = F.sha2(F.to_json(F.struct(*FIELDS)), 256)
    parts = [F.sum(F.conv(F.substring(h, i * 12 + 1, 12), 16, 10).cast("decimal(38,0)")).alias(f"h{i}") for i in range(5)]
    return triples.select(*FIELDS).distinct().agg(*parts, F.count(F.lit(1)).alias("n")).select(F.sha2(F.concat_ws("/", *[F.coalesce(F.col(f"h{i}").cast("string"), F.lit("0")) for i in range(5)], F.col("n").cast("string")), 256).alias("sha256"))


def numbered(df: DataFrame, *columns: str) -> DataFrame:
    """df with ``ord``: consecutive numbers from 0 in the order of the columns.

    Ranges of rows are sorted in parallel; a count per range, one row each, gives every range its start.
    """
    from pyspark.sql import Window

    ranged = cut(df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    starts = sizes.select("__part", "__first", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    return ranged.join(F.broadcast(starts), "__part").withColumn("ord", F.col("__at") - F.col("__first") + F.col("__start")).drop("__part", "__at", "__first", "__start")


def ingest(raw: DataFrame, factory: Factory, namespace: str, classes: list[str] | None = None, max_tokens: int = documents.MAX_TOKENS, first: int | None = None) -> dict[str, DataFrame]:
    """chunks, entities, candidates, decisions, delta: documents to an aligned, proposed delta."""
    chunks = cut(documents.chunk_documents(raw, max_tokens))
    found = cut(llm_functions.extract_entities(documents.eligible(chunks, first=first), factory, classes))
    entities = cut(numbered(found, "chunk_id", "id").withColumn("section_context", F.lit(None).cast("string")))
    delta = llm_functions.map_entities(entities, factory, namespace)
    delta = cut(numbered(delta.withColumnRenamed("ord", "at"), "source_chunk_id", "source_entity_id", "at", "id").drop("at"))
    pairs = cut(align.candidates(entities))
    decisions = (align.decide(pairs, llm_functions.judge_pairs(pairs.select("id", "surface_a", "surface_b", "score"), factory)))
    decisions = cut(numbered(decisions, "candidate_id"))
    mapping = align.rewrite_map(decisions, align.entity_iris(delta))
    return {"chunks": chunks, "entities": entities, "candidates": pairs, "decisions": decisions, "delta": align.rewrite(delta, mapping), "alt_labels": alt_labels(delta, mapping)}


def check_document_rules(rule_table: DataFrame, texts: DataFrame, factory: Factory) -> DataFrame:
    """rule_id, subject, object, value, violated, doc_id, quote: a verdict per statement of each document."""
    blank = rule_table.where(F.coalesce(F.trim("plain_english"), F.lit("")) == "")
    if not blank.isEmpty():
        raise ValueError("a rule without plain_english cannot be checked against documents")
    stated = llm_functions.check_documents(rule_table, texts, factory)
    j = stated.join(small_side(rule_table.select("rule_id", "operator", F.col("value").alias("threshold"))), "rule_id")
    return j.select("rule_id", "subject", "object", "value", F.coalesce(compare(F.col("value"), F.col("operator"), F.col("threshold")), F.lit(False)).alias("violated"), F.col("doc_id").cast("string").alias("doc_id"), "quote")


def check_rules(rule_table: DataFrame, triples: DataFrame | None = None, texts: DataFrame | None = None, factory: Factory | None = None) -> DataFrame:
    """arm, rule_id, subject, object, value, violated, doc_id, quote of the ontology arm, the document arm or both.

    Verdicts of documents name their document and the sentence; both are null in the ontology arm.
    """
    arms = []
    if triples is not None:
        arms.append(rules.check_pairs(rule_table, rules.typed_subjects(triples), rules.typed_facts(triples)).withColumns({"arm": F.lit("ontology"), "doc_id": F.lit(None).cast("string"), "quote": F.lit(None).cast("string")}))
    if texts is not None and factory is not None:
        arms.append(check_document_rules(rule_table, texts, factory).withColumn("arm", F.lit("document")))
    if not arms:
        raise ValueError("a graph, or documents and a provider, are needed")
    out = arms[0] if len(arms) == 1 else arms[0].unionByName(arms[1])
    return out.select("arm", "rule_id", "subject", "object", "value", "violated", "doc_id", "quote")


def analyze_impact(rule_table: DataFrame, triples: DataFrame, changes: DataFrame, truth: DataFrame, texts: DataFrame | None = None, factory: Factory | None = None) -> dict[str, DataFrame]:
    """baseline, after, scores, winners of change scenarios; documents stay as they are in every scenario."""
    baseline = check_rules(rule_table, triples, texts, factory).where("violated").select("arm", "rule_id").distinct()
    after = rules.violated_under(rule_table, triples, changes).withColumn("arm", F.lit("ontology"))
    if texts is not None and factory is not None:
        same = baseline.where(F.col("arm") == "document").join(changes.select("scenario_id").distinct(), F.lit(True))
        after = after.unionByName(same.select("scenario_id", "rule_id", "arm"))
    scores = evaluate.rule_set_score(after, truth, ["scenario_id", "arm"])
    return {"baseline": baseline, "after": after, "scores": scores, "winners": evaluate.winner(scores, ["scenario_id"], "arm", "f1")}


def detect_conflicts(triples: DataFrame, namespace: str, discovered: DataFrame) -> DataFrame:
    """arm, ix, subject, object, conflict_type, evidence of discovered rules that individuals break.

    ``discovered``: rule_id, subject, object, attribute, operator, value; the attribute is the
    object's (the subject's without object). Unknown individuals break nothing.
    """
    bags = graph.conflict_bags(triples, namespace).select(F.regexp_extract("s", r"[^#/]*\z", 0).alias("who"), "props")
    j = discovered.withColumn("who", F.coalesce("object", "subject")).join(bags, "who", "left")
    value = F.try_element_at("props", F.col("attribute"))
    hit = j.withColumn("stated", value).where(F.coalesce(compare(F.col("stated"), F.col("operator"), F.col("value")), F.lit(False)))
    placed = numbered(hit, "rule_id", "subject", "object")
    return placed.select(F.lit("ontology").alias("arm"), F.col("ord").cast("int").alias("ix"), "subject", "object", F.concat_ws("_", "attribute", "operator", F.lit("threshold")).alias("conflict_type"), F.concat("attribute", F.lit(" = "), "stated").alias("evidence"))


def document_conflicts(texts: DataFrame, factory: Factory) -> DataFrame:
    """arm, ix, subject, object, conflict_type, evidence of conflicts that documents state, in one step."""
    placed = numbered(llm_functions.direct_conflicts(texts, factory), "doc_id", "subject", "object", "conflict_type", "evidence")
    return placed.select(F.lit("document").alias("arm"), F.col("ord").cast("int").alias("ix"), "subject", "object", "conflict_type", "evidence")


def find_conflicts(factory: Factory, triples: DataFrame | None = None, namespace: str = "", texts: DataFrame | None = None, proposed: DataFrame | None = None) -> DataFrame:
    """Conflicts of the ontology arm (rules proposed for the graph, or given ones, and who breaks them), the document arm, or both."""
    arms = []
    if triples is not None:
        rules_ = llm_functions.discover_rules(graph.conflict_bags(triples, namespace), factory) if proposed is None else proposed
        arms.append(detect_conflicts(triples, namespace, cut(rules_)))
    if texts is not None:
        arms.append(document_conflicts(texts, factory))
    if not arms:
        raise ValueError("a graph or documents are needed")
    return arms[0] if len(arms) == 1 else arms[0].unionByName(arms[1])


def run(raw: DataFrame, tbox: DataFrame, factory: Factory, namespace: str, rule_table: DataFrame | None = None, changes: DataFrame | None = None, truth: DataFrame | None = None, reviews: DataFrame | None = None, rounds: int = 2) -> dict[str, DataFrame]:
    """Documents to a working graph under a schema, with rules and impact: the end-to-end workload.

    The delta is reviewed (all proposals are approved without reviews), validated against the schema, and what
    breaks it is rejected and validated again, ``rounds`` times at most. Gives what :func:`ingest` gives and
    ``reviewed``, ``rejected``, ``graph``, and with rules ``verdicts``, with changes ``scores`` and ``winners``.
    """
    made = ingest(raw, factory, namespace, [r[0] for r in graph.tbox_summary(tbox, namespace).where(F.col("kind") == "class").select("local_name").orderBy("local_name").collect()])
    reviewed = cut(approve(made["delta"]) if reviews is None else review(made["delta"], reviews))
    rejected = None
    for _ in range(rounds):
        wrong = cut(invalid(reviewed, tbox))
        if wrong.isEmpty():
            break
        rejected = wrong if rejected is None else rejected.unionByName(wrong)
        bad = wrong.select("id", F.lit("rejected").alias("__s")).distinct()
        reviewed = cut(reviewed.join(small_side(bad), "id", "left").withColumn("status", F.coalesce("__s", "status")).drop("__s"))
    out = {**made, "reviewed": reviewed, "rejected": invalid(reviewed, tbox).limit(0) if rejected is None else rejected, "graph": cut(working_graph(tbox, reviewed))}
    if rule_table is not None:
        out["verdicts"] = check_rules(rule_table, out["graph"])
        if changes is not None and truth is not None:
            out |= {k: v for k, v in analyze_impact(rule_table, out["graph"], changes, truth).items() if k in ("scores", "winners")}
    return out


def invalid(entries: DataFrame, tbox: DataFrame) -> DataFrame:
    """id, s, p, o, reason: approved entries that the schema contradicts.

    A literal of a datatype property that is not valid for its range; an object property with a literal. Properties that the schema lacks are new, not wrong.
    """
    kinds = tbox.where((F.col("p") == RDF_TYPE) & F.col("o").isin(OWL + "DatatypeProperty", OWL + "ObjectProperty")).groupBy(F.col("s").alias("p")).agg(F.max(F.col("o") == OWL + "DatatypeProperty").alias("is_data"))
    ranges = tbox.where(F.col("p") == RDFS + "range").groupBy(F.col("s").alias("p")).agg(F.min(local_name(F.col("o"))).alias("range_local"))
    known = kinds.join(ranges, "p", "left")
    ok = entries.where(F.col("status") == "approved").select("id", "s", "p", "o", "o_datatype", "o_lang").join(small_side(known), "p")
    read = with_canonical(ok.withColumn("__r", F.coalesce("range_local", F.lit("string"))), "o", "__r", "__x")
    kind = object_kind(F.col("o"), F.col("o_datatype"), F.col("o_lang"))
    reason = F.when(F.col("is_data") & F.col("__x").isNull(), F.concat(F.lit("not valid for "), F.col("__r"))).when(~F.col("is_data") & F.col("o_datatype").isNotNull() & (kind == "literal"), "a literal for an object property")
    return read.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("id", "s", "p", "o", "reason")


def score_conflicts(found: DataFrame, rule_table: DataFrame) -> dict[str, DataFrame]:
    """scores per rule, prf per arm, and the conflicts that no rule explains."""
    scores = cut(conflicts.score_rules(found, rule_table))
    return {"scores": scores, "prf": evaluate.outcome_prf(scores, ["arm"]), "unmatched": conflicts.unmatched(found, scores)}


def align_names(working: DataFrame, source: DataFrame, namespace: str, factory: Factory) -> DataFrame:
    """The working graph under the source's names: the best matches, judged where they are in the band."""
    best = cut(align.best_match(locals_under(working, namespace), locals_under(source, namespace)))
    asked = best.where(F.col("band") == "judge").select(F.concat_ws("|", "working", "source").alias("id"), F.col("working").alias("surface_a"), F.col("source").alias("surface_b"), "score")
    judged = llm_functions.judge_pairs(asked, factory, 0.0, 1.1).where(F.col("same_entity") & (F.col("confidence") >= align.AUTO)).select(F.col("candidate_id").alias("id"))
    kept = best.withColumn("id", F.concat_ws("|", "working", "source")).join(judged.withColumn("yes", F.lit(True)), "id", "left").where((F.col("band") == "auto") | F.col("yes"))
    return graph.remap_iris(working, kept.select(F.col("working").alias("old"), F.col("source").alias("new")), namespace)


def reconstruct(source: DataFrame, raw: DataFrame, factory: Factory, namespace: str, classes: list[str] | None = None) -> dict[str, DataFrame]:
    """arms, debug, winner: a graph rebuilt from documents by the pipeline and in one step, against the source.

    The pipeline's names are aligned with the source's before the comparison, the direct arm's are not,
    and its values are plain literals.
    """
    made = ingest(raw, factory, namespace, classes)
    tbox = graph.copy_tbox(source, graph.empty_graph(source.sparkSession))
    pipeline = cut(align_names(working_graph(tbox, approve(made["delta"])), source, namespace, factory))
    texts = raw.select(F.col("id").alias("doc_id"), F.col("markdown").alias("text"))
    direct = cut(graph.direct_graph(llm_functions.extract_direct(texts, factory, classes), namespace))
    arms = evaluate.evaluate(source, pipeline).withColumn("arm", F.lit("pipeline")).unionByName(evaluate.evaluate(source, direct).withColumn("arm", F.lit("direct")))
    arms = cut(arms)
    debug = [evaluate.classify(graph.subject_triples(source, graph.individuals(source)), graph.subject_triples(g, graph.individuals(g)), ["s", "p", "o"]).withColumn("arm", F.lit(n)) for n, g in (("pipeline", pipeline), ("direct", direct))]
    winner = evaluate.winner(arms.where(F.col("level") == "triples").withColumn("k", F.lit(1)), ["k"], "arm", "f1", "pair").select("winner")
    return {"arms": arms, "debug": debug[0].unionByName(debug[1]), "winner": winner, "graph": pipeline}


def sample_delta(spark, namespace: str = "urn:sample#") -> DataFrame:
    """A small approved delta for demonstrations."""
    facts = [("Orbiter", "massKg", "412.5", XSD + "decimal"), ("Orbiter", "hasTank", namespace + "TankA", None), ("TankA", "massKg", "18", XSD + "integer"), ("TankA", "maker", "Norvik", XSD + "string"), ("TankA", "pressure", "2.1", XSD + "decimal")]
    rows = [(i, namespace + s, namespace + p, o, d, None) for i, (s, p, o, d) in enumerate(facts)]
    df = spark.createDataFrame(rows, "ord int, s string, p string, o string, o_datatype string, o_lang string")
    return df.select(graph.triple_id().alias("id"), "*", F.lit("approved").alias("status"), looks_like_iri(F.col("o"), F.col("o_datatype")).alias("is_iri"))
