"""A folder of documents as a stream of chunks, and a stream of attribute rows into a wide table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from kgloom.operators.documents import MAX_TOKENS, chunk_documents
from kgloom.operators.wide import WideStore
from kgloom.sources.files import with_markdown


def stream_chunks(spark: SparkSession, folder: str, max_tokens: int = MAX_TOKENS, files_per_trigger: int = 1000) -> DataFrame:
    """Chunks of every new text or markdown file below ``folder``; the same content counts once.

    The state holds one hash per file's content.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return chunk_documents(with_markdown(raw).dropDuplicates(["source_sha256"]), max_tokens)


def stream_upserts(rows: DataFrame, store: WideStore, checkpoint: str, **columns: str) -> StreamingQuery:
    """Write every micro-batch of attribute rows as one run of the store; a repeated batch replaces its run."""
    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: store.upsert(df, f"batch{n:09d}", **columns)).start()
