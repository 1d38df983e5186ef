"""Session helpers: building a session, reading tables, cutting lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(name: str = "kgloom", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects (on a cluster, pass your own)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``, else the folder set by
    ``setCheckpointDir``. Only a local master, as in tests, may do without: a private temporary
    folder is made and used there. On a cluster a folder of one machine would lose what the others
    write, so that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="kgloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a written table; removed when the program ends."""
    base = f"{shared_dir(spark)}/kgloom-{spark.sparkContext.applicationId}"
    if base not in _BASES:
        _BASES.add(base)
        atexit.register(_remove, spark, base)
    return f"{base}/{label}-{uuid.uuid4().hex}"


_BASES: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target, fs = hadoop_path(spark, path)
        fs.delete(target, True)
    except Exception:  # the session has ended; nothing more can be removed through it
        pass


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system, whatever storage it names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder of any storage, in order; none where there is no such folder."""
    target, fs = hadoop_path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder and forget how it was made.

    A lost executor loses nothing that was written. Unlike a checkpoint, the table brings neither
    the constraints of the plan that made it, which would multiply in every round of a loop, nor its
    size estimate: what reads it knows its true size.
    """
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[id(out)] = (weakref.ref(out, lambda _, key=id(out): _WRITTEN.pop(key, None)), path)
    return out


_WRITTEN: dict[int, tuple[weakref.ref, str]] = {}


def rename_cut(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new``, a view of the written table ``old``, as its owner in :func:`drop`."""
    known = _WRITTEN.pop(id(old), None)
    if known is not None:
        _WRITTEN[id(new)] = (weakref.ref(new, lambda _, key=id(new): _WRITTEN.pop(key, None)), known[1])
    return new


def drop(*frames: DataFrame | None) -> None:
    """Delete the tables of frames made by :func:`cut` that nothing will read any more; others are left alone."""
    for df in frames:
        known = _WRITTEN.pop(id(df), None) if df is not None else None
        if known is not None and known[0]() is df:
            _remove(df.sparkSession, known[1])


def is_small(df: DataFrame, max_rows: int) -> bool:
    """True where ``df`` has at most ``max_rows`` rows; reads no more than that many."""
    return df.limit(max_rows + 1).count() <= max_rows


def small_side(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Broadcast hint if a count proves that the side is bounded, else ``df`` for a shuffled join."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def skew_safe_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join on a key that may be hot in ``left``; ``right`` has one row per key.

    Where adaptive execution splits skewed joins itself, a plain join is enough and costs no extra
    pass; elsewhere hot keys are told apart first.
    """
    conf = left.sparkSession.conf
    adaptive = all(conf.get(f"spark.sql.adaptive.{x}", "true") == "true" for x in ("enabled", "skewJoin.enabled"))
    return left.join(right, on, how) if adaptive else hot_split_join(left, right, on, how)


def hot_split_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", hot_keys: int = 1000, least: int = 100_000) -> DataFrame:
    """Join ``left`` with ``right`` (unique in ``on``) where single keys may hold a third of ``left``.

    Keys with over ``1/hot_keys`` of all rows of ``left`` are at most ``hot_keys`` in number, so the
    matching rows of ``right`` are provably few and are broadcast; all other rows take the shuffled
    join, whose largest group is then bounded by ``rows / hot_keys``.
    """
    counts = left.groupBy(on).agg(F.count(F.lit(1)).alias("__n")).persist(StorageLevel.MEMORY_AND_DISK)
    total = counts.agg(F.sum("__n")).first()[0] or 0
    floor = max(total // hot_keys, least)
    hot = [r[0] for r in counts.where(F.col("__n") > floor).select(on).limit(hot_keys).collect() if r[0] is not None]
    counts.unpersist()
    if not hot:
        return left.join(right, on, how)
    is_hot = F.coalesce(F.col(on).isin(hot), F.lit(False))
    return left.where(is_hot).join(F.broadcast(right.where(F.col(on).isin(hot))), on, how).unionByName(left.where(~is_hot).join(right, on, how))
