"""Attribute–value rows into wide tables, as log-structured upserts.

A batch of (subject, property, value, version) rows becomes a sparse wide *delta*: one row per
subject with one versioned cell per property. A store keeps deltas as runs, bucketed and sorted by
subject; compaction merges the runs bucket by bucket, without any shuffle, and keeps the latest
version of every cell. Both steps are the same associative fold (the larger of two versioned cells),
so map tasks build their run before anything is shuffled and a subject that holds a third of all
rows arrives as one row per task.

Cases: null or blank subject, property or value, a property that the schema lacks, and a value not
valid for its type give no cell; a null version is older than any other; of equal versions the
larger canonical text wins; repeated rows change nothing; an empty table gives an empty table.
Columns beyond the named ones are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions.lexical import local_name, with_canonical
from kgloom.session import children, hadoop_path

#: A wide table has at most so many property columns; a larger schema is refused aloud.
MAX_COLUMNS = 5000

# The Spark type of a column by the local name of its XSD range.
SPARK_TYPES = {"integer": "decimal(38,0)", "int": "int", "long": "bigint", "decimal": "decimal(38,12)", "double": "double", "float": "float", "boolean": "boolean", "date": "date"}


@dataclass(frozen=True)
class Property:
    """One column of the wide table."""

    name: str
    range_local: str


def datatype_properties(tbox: DataFrame) -> list[Property]:
    """The columns: properties of kind ``datatype``; of several ranges the first by text."""
    rows = (
        tbox.where((F.col("kind") == "datatype") & F.col("local_name").isNotNull())
        .groupBy("local_name")
        .agg(F.min(local_name("range_iri")).alias("r"))
        .orderBy("local_name")
        .limit(MAX_COLUMNS + 1)
        .collect()
    )
    if len(rows) > MAX_COLUMNS:
        raise ValueError(f"over {MAX_COLUMNS} datatype properties")
    return [Property(r["local_name"], r["r"] or "string") for r in rows]


def wide_delta(batch: DataFrame, properties: Sequence[Property], subject: str = "s", prop: str = "p", value: str = "o", version: str = "loaded_at", run: Column | None = None) -> DataFrame:
    """One row per subject; column ``c<i>`` holds the cell of property i, ``struct<version, text>`` or null.

    With ``run``, rows of several batches make one delta each: a row per subject and run, in column ``run``.
    """
    by = ["subject_local"] if run is None else ["subject_local", "run"]
    ranges = F.create_map(*[F.lit(x) for p in properties for x in (p.name, p.range_local)]) if properties else None
    rows = batch.select(
        local_name(F.col(subject)).alias("subject_local"),
        local_name(F.col(prop)).alias("__p"),
        F.col(version).cast("timestamp").alias("__v"),
        F.col(value).alias("__o"),
        *([] if run is None else [run.alias("run")]),
    ).where(F.col("subject_local") != "")
    if ranges is None:
        return rows.select(*by).where(F.lit(False))
    valued = rows.where(F.col("__p").isin([p.name for p in properties]) & F.col("__o").isNotNull()).withColumn("__r", ranges[F.col("__p")])
    # Invalid values are sifted in the fold: a filter here would be pushed down with the whole expression.
    cells = with_canonical(valued, "__o", "__r", "__x").select(*by, "__p", F.when(F.col("__x").isNotNull(), F.struct(F.col("__v").alias("version"), F.col("__x").alias("text"))).alias("__c"))
    return cells.groupBy(*by).agg(*[F.max(F.when(F.col("__p") == p.name, F.col("__c"))).alias(f"c{i}") for i, p in enumerate(properties)])


def compact(runs: Sequence[DataFrame]) -> DataFrame:
    """Merge runs of one schema into one row per subject, the latest version of every cell."""
    merged = reduce(DataFrame.unionByName, runs)
    names = [c for c in merged.columns if c != "subject_local"]
    return merged.groupBy("subject_local").agg(*[F.max(c).alias(c) for c in names]) if names else merged.distinct()


def typed(delta: DataFrame, properties: Sequence[Property]) -> DataFrame:
    """The wide table: typed columns without versions, and ``beyond``.

    ``beyond`` maps the properties whose number a column's type cannot hold as it is (more digits
    than its decimals, outside its integers) to their text; it is null where there are none. A double
    is rounded as its type says. A property whose name clashes with an earlier column's, but for case,
    has its place appended.
    """
    taken = {"subject_local", "beyond"}
    inexact = []

    def cell(i: int, p: Property) -> Column:
        name = p.name if p.name.lower() not in taken else f"{p.name}_{i}"
        taken.add(name.lower())
        text = F.col(f"c{i}.text")
        kind = SPARK_TYPES.get(p.range_local)
        if kind is None:
            return text.alias(name)
        if kind not in ("boolean", "date", "double", "float"):
            held = text.try_cast(kind)
            plain = F.when(held.cast("string").contains("."), F.rtrim(F.rtrim(held.cast("string"), F.lit("0")), F.lit("."))).otherwise(held.cast("string"))
            inexact.append(F.when(text.isNotNull() & ~plain.eqNullSafe(text), F.struct(F.lit(name).alias("key"), text.alias("value"))))
            return F.when(plain == text, held).alias(name)
        return text.try_cast(kind).alias(name)

    columns = [cell(i, p) for i, p in enumerate(properties)]
    some = F.array_compact(F.array(*inexact)) if inexact else None
    beyond = F.lit(None).cast("map<string,string>") if some is None else F.when(F.size(some) > 0, F.map_from_entries(some))
    return delta.select("subject_local", *columns, beyond.alias("beyond"))


def cells(delta: DataFrame, properties: Sequence[Property]) -> DataFrame:
    """The non-null cells of the wide table, one row each, as canonical text."""
    if not properties:
        return delta.select("subject_local", F.lit("").alias("property_local"), F.lit("").alias("value_text"))
    pairs = F.array(*[F.struct(F.lit(p.name).alias("property_local"), F.col(f"c{i}.text").alias("value_text")) for i, p in enumerate(properties)])
    return delta.select("subject_local", F.inline(pairs)).where(F.col("value_text").isNotNull())


class WideStore:
    """A wide table on shared storage: runs written by ``upsert``, merged by ``compact``.

    The runs are partitions of one table that is bucketed and sorted by subject, so whatever groups by
    subject merges bucket with bucket and shuffles nothing. The table is known to the session's
    catalog by a name made of its path and can be opened again from the path; the number of buckets
    is that of the session's shuffle partitions when it is made.
    """

    def __init__(self, spark: SparkSession, path: str, properties: Sequence[Property], buckets: int | None = None):
        self.spark, self.properties = spark, list(properties)
        found = sorted(int(n[8:]) for n in children(spark, path) if n.startswith("buckets="))
        self.buckets = found[-1] if found else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = path
        self.name = "kgloom_" + hashlib.sha256(path.encode()).hexdigest()[:24]
        cells_ = ", ".join(f"c{i} STRUCT<version: TIMESTAMP, text: STRING>" for i in range(len(self.properties)))
        at = f"{path}/buckets={self.buckets}"
        folder, fs = hadoop_path(spark, at)
        fs.mkdirs(folder)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (subject_local STRING{', ' if cells_ else ''}{cells_}, run STRING) USING parquet "
            f"PARTITIONED BY (run) CLUSTERED BY (subject_local) SORTED BY (subject_local) INTO {self.buckets} BUCKETS LOCATION '{at}'"
        )
        spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def upsert(self, batch: DataFrame, run: str | Column, **columns: str) -> None:
        """Write a batch as a run, or by a column several batches as a run each. Writing a run again replaces it."""
        delta = wide_delta(batch, self.properties, run=F.lit(run) if isinstance(run, str) else run, **columns)
        order = [c for c in delta.columns if c not in ("subject_local", "run")]
        delta = delta.repartition(self.buckets, "subject_local").sortWithinPartitions("run", "subject_local").select("subject_local", *order, "run")
        self._replace(delta)

    def _replace(self, delta: DataFrame) -> None:
        """Write the runs that the rows are of in place of what they were; other runs stay."""
        conf, key = delta.sparkSession.conf, "spark.sql.sources.partitionOverwriteMode"
        before = conf.get(key)
        conf.set(key, "dynamic")
        try:
            delta.write.insertInto(self.name, overwrite=True)
        finally:
            conf.set(key, before)

    def runs(self) -> DataFrame:
        return self.spark.table(self.name).drop("run")

    def merged(self) -> DataFrame:
        """One row per subject, the latest version of every cell, read from the sorted runs."""
        return compact([self.runs()])

    def compact(self, run: str = "base") -> WideStore:
        """Merge all runs into the single run of a new store beside this one."""
        target = WideStore(self.spark, f"{self.path}-{run}", self.properties, self.buckets)
        target._replace(self.merged().sortWithinPartitions("subject_local").withColumn("run", F.lit(run)))
        return target

    def read(self) -> DataFrame:
        return typed(self.merged(), self.properties)
