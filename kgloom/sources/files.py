"""Documents, rule and scenario files, organisation knowledge, artifacts and changelogs."""

from __future__ import annotations

import posixpath
from typing import Any
from urllib.parse import unquote

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions.text import expand_datatype, object_kind, resolve_iri, short_hash
from kgloom.operators.documents import markdown, text_to_markdown
from kgloom.session import children, hadoop_path

SUFFIXES = (".pdf", ".txt", ".text", ".md", ".markdown")
RULES = "ord int, rule_id string, name string, namespace string, subject_type string, object_type string, attribute string, operator string, value string, unit string, consequence string, severity string, note string, plain_english string, expected_violated boolean, aggregate string"
SCENARIOS = "scenario_id string, description string, component_local string, changes array<struct<property_local:string,old_value:string,new_value:string,unit:string>>, ground_truth array<string>"
_PAGES = "array<struct<char_start:int,char_end:int,page:int>>"


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def with_markdown(raw: DataFrame) -> DataFrame:
    """Raw documents of ``binaryFile`` rows (path, content): text and markdown files.

    UTF-8 with replacement. PDF files need a table of spans; see ``operators.documents``.
    """
    text = F.decode("content", "UTF-8")
    sha = F.sha2("content", 256)
    kind = F.when(_suffix(F.col("path")).isin(".md", ".markdown"), "md").otherwise("txt")
    body = F.when(kind == "md", markdown(text)).otherwise(text_to_markdown(text))
    return raw.select(short_hash(F.col("path"), sha, sep=":").alias("id"), F.col("path").alias("source_path"), kind.alias("source_format"), sha.alias("source_sha256"), body.alias("markdown"), F.lit(None).cast(_PAGES).alias("page_map"))


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """Raw documents of a file or folder on any storage. A missing path, an unknown suffix and a PDF are errors."""
    target, fs = hadoop_path(spark, path)
    if not fs.exists(target):
        raise FileNotFoundError(path)
    files = [target.getName()] if fs.getFileStatus(target).isFile() else children(spark, path)
    bad = [f for f in files if posixpath.splitext(f)[1].lower() not in SUFFIXES]
    if bad:
        raise ValueError(f"unsupported suffix: {bad[0]}")
    pdf = [f for f in files if f.lower().endswith(".pdf")]
    if pdf:
        raise ValueError(f"{pdf[0]} is a PDF: give its table of spans to operators.documents.spans_to_blocks")
    return with_markdown(spark.read.format("binaryFile").load(path))


def _yaml(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a YAML file; ``id``, ``name`` and ``when`` are required; an empty file has none."""
    data = _yaml(path)
    rows = []
    for i, r in enumerate(data.get("rules") or []):
        when = r["when"]
        rows.append((i, r["id"], r["name"], data.get("namespace", ""), r.get("subject_type"), r.get("object_type"), when["attribute"], when["operator"], str(when["value"]), when.get("unit"), r.get("consequence", ""), r.get("severity", "warning"), r.get("note"), r.get("plain_english"), r.get("expected_violated"), when.get("aggregate", "each")))
    return spark.createDataFrame(rows, RULES)


def load_scenarios(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """The namespace and the change scenarios of a YAML file."""
    data = _yaml(path)
    rows = []
    for s in data.get("scenarios") or []:
        changes = [(c["property_local"], None if c.get("old_value") is None else str(c["old_value"]), str(c["new_value"]), c.get("unit")) for c in s.get("changes") or []]
        rows.append((s["id"], s["description"], s["component_local"], changes, list(s.get("ground_truth") or [])))
    return data.get("namespace", ""), spark.createDataFrame(rows, SCENARIOS)


def load_org_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """Approved manual entries of a YAML file, under the ids given there."""
    data = _yaml(path)
    rows = [(i, r["id"], r["subject"], r["predicate"], str(r["object"]), r.get("datatype"), r.get("note")) for i, r in enumerate(data.get("rules") or [])]
    raw = spark.createDataFrame(rows, "ord int, id string, s string, p string, o string, dt string, rationale string")
    ns = data.get("namespace", "")
    pairs = [F.lit(x) for kv in (data.get("predicates") or {}).items() for x in kv]
    aliases = F.create_map(*pairs).cast("map<string,string>")
    dt = expand_datatype(F.col("dt"))
    obj = F.when(F.col("dt").isNotNull(), F.col("o")).otherwise(resolve_iri(F.col("o"), ns, aliases))
    return raw.select("ord", "id", resolve_iri(F.col("s"), ns, aliases).alias("s"), resolve_iri(F.col("p"), ns, aliases).alias("p"), obj.alias("o"), dt.alias("o_datatype"), object_kind(obj, F.col("dt")).alias("o_kind"), "rationale", F.lit("MANUAL").alias("change_source"), F.lit("approved").alias("status"), F.lit(1.0).alias("confidence"))


def save_artifacts(df: DataFrame, path: str, key: str = "id", kind: str | None = None) -> None:
    """One folder per artifact id; saving an id again replaces it only. Without an id, the row's hash is one."""
    keyed = df if key in df.columns else df.withColumn(key, short_hash(F.to_json(F.struct(*df.columns))))
    target = posixpath.join(path, kind) if kind else path
    keyed.withColumn("artifact", F.col(key)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("artifact").json(target)


def load_artifacts(spark: SparkSession, path: str, schema: str, ids: list[str] | None = None) -> DataFrame:
    """Artifacts under a schema; a missing folder has none. Ids prune to their folders."""
    if not children(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(f"{schema}, artifact string").option("mode", "FAILFAST").json(path)
    return (df.where(F.col("artifact").isin(*ids)) if ids is not None else df).drop("artifact")


def list_artifacts(spark: SparkSession, path: str) -> list[str]:
    """Ids of the artifacts in a folder of any storage."""
    return [unquote(d.split("=", 1)[1]) for d in children(spark, path) if d.startswith("artifact=")]


def newest_artifact(spark: SparkSession, path: str) -> str | None:
    """The artifact with the newest file."""
    if not list_artifacts(spark, path):
        return None
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime")
    row = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("p")).first()
    return row["p"].split("artifact=", 1)[1].split("/")[0] if row and row["p"] else None


CHANGELOG = "ord bigint, version string, summary string, n_added bigint, n_removed bigint"


def record_change(spark: SparkSession, path: str, version: str, summary: str, added: int, removed: int) -> None:
    """Append one record to a changelog."""
    last = load_changelog(spark, path).agg(F.max("ord")).first()[0]
    spark.createDataFrame([((last or 0) + 1, version, summary, added, removed)], CHANGELOG).write.mode("append").parquet(path)


def load_changelog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHANGELOG).parquet(path) if children(spark, path) else spark.createDataFrame([], CHANGELOG)


def latest_version(changelog: DataFrame) -> DataFrame:
    return changelog.agg(F.max_by("version", "ord").alias("version"))
