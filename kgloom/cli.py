"""Commands over files: ingest, review, evaluate, rules, impact, conflicts, reconstruction, diff, align, knowledge, generate."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions import render
from kgloom.operators import align, documents, evaluate, generate, graph, rules, synthesis
from kgloom.plans import pipelines
from kgloom.providers import functions as llm_functions
from kgloom.providers import get_provider, list_providers
from kgloom.session import build_session, cut
from kgloom.sources import files, rdf


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kgloom")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, *arguments: tuple[str, dict]) -> None:
        c = sub.add_parser(name, help=text)
        for flag, options in arguments:
            c.add_argument(flag, **options)

    need, opt = {"required": True}, {"default": None}
    provider = ("--provider", {"default": "rule", "choices": list_providers()})
    add("ingest", "documents to chunks, entities and a delta", ("--input", need), ("--output", need), ("--namespace", need), ("--max-tokens", {"type": int, "default": documents.MAX_TOKENS}), ("--max-chunks", {"type": int, "default": None}), provider)
    add("evaluate", "precision, recall and F1 of one graph against another", ("--source", need), ("--working", need))
    mode = ("--mode", {"default": "ontology", "choices": ("ontology", "document", "both")})
    save = ("--save", opt)
    add("run", "documents to a graph under a schema, with rules and impact", ("--input", need), ("--tbox", need), ("--output", need), ("--namespace", need), ("--rules", opt), ("--scenarios", opt), ("--reviews", opt), provider)
    add("check-rules", "verdicts of rules on a graph, on documents, or both", ("--rules", need), ("--owl", opt), ("--doc", opt), mode, save, provider)
    add("impact", "rules violated under change scenarios, by the graph, by documents, or both", ("--rules", need), ("--scenarios", need), ("--owl", need), ("--doc", opt), mode, save, provider)
    add("diff", "triples added and removed", ("--old", need), ("--new", need), ("--save", opt))
    add("align", "similar entities of an entity table; with a delta, their merge applied to it", ("--entities", need), ("--delta", opt), ("--apply", {"action": "store_true"}), save, provider)
    add("apply-knowledge", "add entries of a YAML file to a graph", ("--yaml", need), ("--owl", need), ("--save", need), ("--dry-run", {"action": "store_true"}))
    add("review", "a delta with a reviewer's decisions (CSV: ord,id,action,new_object,note)", ("--delta", need), ("--reviews", need), ("--save", need), ("--auto-approve", {"action": "store_true"}))
    add("detect-conflicts", "individuals that break proposed rules (JSON lines, else the provider's), and conflicts that documents state, scored against a rule file", ("--owl", opt), ("--doc", opt), ("--namespace", need), ("--proposed", opt), ("--rules", opt), mode, save, provider)
    add("reconstruct", "a graph rebuilt from documents by the pipeline and in one step", ("--owl", need), ("--docs", need), ("--namespace", need), provider)
    add("demo", "the sample delta as a document with anchors, checked against its facts", provider)
    add("generate", "a graph of generated systems", ("--domain", {"required": True, "choices": generate.ALL_DOMAINS}), ("--count", {"type": int, "default": 1}), ("--namespace", need), ("--save", need), ("--seed", {"type": int, "default": 0}))
    return p


_REVIEWS = "ord int, id string, action string, new_object string, note string"


def _each(rule_table: DataFrame) -> DataFrame:
    return rule_table.where(F.coalesce("aggregate", F.lit("each")) == "each")


def _scenarios(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The changes and the expected rules of a scenario file."""
    ns, scenarios = files.load_scenarios(spark, path)
    c = scenarios.select("scenario_id", F.concat(F.lit(ns), "component_local").alias("s"), F.inline("changes"))
    changes = c.select("scenario_id", "s", F.concat(F.lit(ns), "property_local").alias("p"), "new_value")
    return changes, scenarios.select("scenario_id", F.explode("ground_truth").alias("rule_id"))


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = build_session("kgloom-cli")
    if a.command == "ingest":
        chunks = documents.chunk_documents(files.load_documents(spark, a.input), a.max_tokens)
        chunks.write.mode("overwrite").parquet(f"{a.output}/chunks")
        chunks = documents.eligible(spark.read.parquet(f"{a.output}/chunks"), first=a.max_chunks)
        entities = llm_functions.extract_entities(chunks, lambda: get_provider(a.provider))
        entities.withColumn("section_context", F.lit(None).cast("string")).write.mode("overwrite").parquet(f"{a.output}/entities")
        llm_functions.map_entities(spark.read.parquet(f"{a.output}/entities"), lambda: get_provider(a.provider), a.namespace).write.mode("overwrite").parquet(f"{a.output}/delta")
        for t in ("chunks", "entities", "delta"):
            print(t, spark.read.parquet(f"{a.output}/{t}").count())
    elif a.command == "evaluate":
        evaluate.evaluate(rdf.load_graph(spark, a.source), rdf.load_graph(spark, a.working)).show(truncate=False)
    elif a.command == "run":
        r = files.load_rules(spark, a.rules) if a.rules else None
        changes, truth = _scenarios(spark, a.scenarios) if a.scenarios else (None, None)
        reviews = spark.read.csv(a.reviews, header=True, schema=_REVIEWS) if a.reviews else None
        made = pipelines.run(files.load_documents(spark, a.input), rdf.load_graph(spark, a.tbox), lambda: get_provider(a.provider), a.namespace, r if r is None else _each(r), changes, truth, reviews)
        for name, df in made.items():
            df.write.mode("overwrite").parquet(f"{a.output}/{name}")
            print(name, spark.read.parquet(f"{a.output}/{name}").count())
        rdf.save_graph(spark.read.parquet(f"{a.output}/graph"), f"{a.output}/graph.owl", "xml", parts=1)
    elif a.command in ("check-rules", "impact"):
        r = files.load_rules(spark, a.rules)
        triples = rdf.load_graph(spark, a.owl) if a.owl and (a.mode != "document" or a.command == "impact") else None
        texts = files.load_documents(spark, a.doc).select(F.col("id").alias("doc_id"), F.col("markdown").alias("text")) if a.doc and a.mode != "ontology" else None
        factory = (lambda: get_provider(a.provider)) if texts is not None else None
        each = _each(r) if texts is None else llm_functions.plain_english(_each(r), lambda: get_provider(a.provider))
        if a.command == "check-rules":
            verdicts = pipelines.check_rules(each, triples, texts, factory)
            verdicts.groupBy("arm", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("violated").alias("n_violated")).orderBy("arm", "rule_id").show(1000, truncate=False)
            if triples is not None:
                rules.check_aggregates(r, rules.typed_facts(triples)).show(1000, truncate=False)
            if a.save:
                rules.source_refs(verdicts, r).write.mode("overwrite").json(a.save)
        else:
            changes, truth = _scenarios(spark, a.scenarios)
            got = pipelines.analyze_impact(each, triples, changes, truth, texts, factory)
            got["scores"].show(1000, truncate=False)
            got["winners"].show(1000, truncate=False)
            if a.save:
                for name in ("baseline", "after", "scores", "winners"):
                    got[name].write.mode("overwrite").json(f"{a.save}/{name}")
    elif a.command == "diff":
        d = graph.difference(rdf.load_graph(spark, a.new), rdf.load_graph(spark, a.old))
        d.groupBy("side").count().show()
        if a.save:
            d.write.mode("overwrite").json(a.save)
    elif a.command == "align":
        entities = spark.read.parquet(a.entities)
        c = cut(align.candidates(entities))
        c.groupBy("method").count().show()
        decisions = cut(pipelines.numbered(align.decide(c, llm_functions.judge_pairs(c.select("id", "surface_a", "surface_b", "score"), lambda: get_provider(a.provider))), "candidate_id"))
        align.status_counts(decisions).show()
        if a.apply:
            if not (a.delta and a.save):
                raise SystemExit("--apply needs --delta and --save")
            delta = spark.read.parquet(a.delta)
            align.rewrite(delta, align.rewrite_map(decisions, align.entity_iris(delta))).write.mode("overwrite").parquet(a.save)
        elif a.save:
            decisions.write.mode("overwrite").parquet(a.save)
    elif a.command == "apply-knowledge":
        triples, k = rdf.load_graph(spark, a.owl), files.load_org_knowledge(spark, a.yaml)
        new = k.select("s", F.lit("iri").alias("s_kind"), "p", "o", "o_kind", "o_datatype", F.lit(None).cast("string").alias("o_lang"))
        merged = graph.add(triples, new)
        print(triples.count(), "->", merged.count())
        if not a.dry_run:
            rdf.save_graph(merged, a.save, "nt")
    elif a.command == "review":
        reviews = spark.read.csv(a.reviews, header=True, schema=_REVIEWS)
        done = pipelines.review(spark.read.parquet(a.delta), reviews)
        (pipelines.approve(done) if a.auto_approve else done).write.mode("overwrite").parquet(a.save)
        spark.read.parquet(a.save).groupBy("status").count().orderBy("status").show()
    elif a.command == "detect-conflicts":
        proposed = spark.read.schema("rule_id string, subject string, object string, attribute string, operator string, value string").json(a.proposed) if a.proposed else None
        triples = rdf.load_graph(spark, a.owl) if a.owl and a.mode != "document" else None
        texts = files.load_documents(spark, a.doc).select(F.col("id").alias("doc_id"), F.col("markdown").alias("text")) if a.doc and a.mode != "ontology" else None
        found = cut(pipelines.find_conflicts(lambda: get_provider(a.provider), triples, a.namespace, texts, proposed))
        found.show(1000, truncate=False)
        if a.rules:
            scored = pipelines.score_conflicts(found, files.load_rules(spark, a.rules))
            scored["scores"].show(1000, truncate=False)
            scored["prf"].show(truncate=False)
            if triples is not None and texts is not None:
                evaluate.overlap(found, "ontology", "document").show()
        if a.save:
            found.write.mode("overwrite").json(a.save)
    elif a.command == "reconstruct":
        got = pipelines.reconstruct(rdf.load_graph(spark, a.owl), files.load_documents(spark, a.docs), lambda: get_provider(a.provider), a.namespace)
        got["arms"].show(truncate=False)
        got["winner"].show()
    elif a.command == "demo":
        d = cut(pipelines.sample_delta(spark))
        sections = synthesis.ask_sections(d, synthesis.anchor_map(d.select("id")), lambda: get_provider(a.provider))
        parts = sections.select(F.lit("demo").alias("doc_id"), F.xxhash64("s").alias("section_ix"), "title", F.array_join("paragraphs", " ").alias("paragraph"))
        made = cut(synthesis.assemble(parts, "demo", "Sample"))
        print(made.first()["markdown"])
        checks = synthesis.self_check(d.select(F.lit("demo").alias("doc_id"), "id", "p", "o", "o_datatype"), made.select("doc_id", F.col("markdown").alias("text")))
        line = evaluate.coverage(checks, ["doc_id"]).select(render.self_check_line(F.col("n_matched"), F.col("n_total"), F.col("coverage")))
        print(line.first()[0])
    elif a.command == "generate":
        rdf.save_graph(graph.tree_to_graph(generate.systems_table(spark, a.domain, a.count, a.seed), a.namespace), a.save, "nt")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
