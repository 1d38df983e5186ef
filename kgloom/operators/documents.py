"""Documents to markdown, headings and chunks.

Conversion and headings are column expressions. Chunking scans the lines of one document with
state, so it runs as an Arrow-batched Python function over rows: no shuffle, one document at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.lexical import strip
from kgloom.functions.text import short_hash

MAX_TOKENS = 512
MIN_CHUNK_CHARS = 30
CHUNK_SCHEMA = (
    "artifact_id string, chunk_ix int, id string, text string, char_start int, char_end int, token_count int, "
    "section_path array<struct<level:int,title:string,anchor:string>>, "
    "locator struct<source_id:string,source_path:string,source_format:string,page:int,line_start:int,line_end:int>"
)
_HEADING = re.compile(r"(#{1,6})\s+(.+)")


def markdown(content: Column) -> Column:
    """Runs of empty lines to one, stripped, ended by one line end."""
    return F.concat(strip(F.regexp_replace(content, r"\n{3,}", "\n\n")), F.lit("\n"))


def text_heading_level(line: Column) -> Column:
    """1 to 3 for lines of plain text that look like headings, else null.

    Numbered lines by the depth of their number; capitals only, without end punctuation, are 2.
    """
    s = strip(line)
    number = F.regexp_extract(s, r"(?U)^(\d+(?:\.\d+)*)\s+\w", 1)
    capitals = (s == F.upper(s)) & (F.length(s) >= 3) & ~s.rlike(r"[.,:;?!]$") & F.replace(s, F.lit(" "), F.lit("")).rlike(r"^\p{L}+$")
    return F.when((s == "") | (F.length(s) > 80), F.lit(None).cast("int")).when(number != "", F.least(F.size(F.split(number, r"\.")), F.lit(3))).when(capitals, 2)


def text_to_markdown(content: Column) -> Column:
    """Plain text with ``#`` marks in front of its headings; a final line end is lost."""
    lines = F.split(F.regexp_replace(content, r"\n\z", ""), "\n")
    # The level is worked out once per line, then used.
    levelled = F.transform(lines, lambda x: F.struct(x.alias("x"), text_heading_level(x).alias("n")))
    return F.array_join(F.transform(levelled, lambda y: F.when(y["n"].isNotNull(), F.concat(F.repeat(F.lit("#"), y["n"]), F.lit(" "), strip(y["x"]))).otherwise(y["x"])), "\n")


def body_sizes(spans: DataFrame, pages: int = 5) -> DataFrame:
    """doc, body_size: the most frequent font size above 4 on the first pages; the first seen on ties.

    Documents without such a span have 10.
    """
    docs = spans.select("doc").distinct()
    s = spans.where(F.col("page") <= pages).withColumn("size", F.round("size", 1)).where(F.col("size") > 4)
    n = s.groupBy("doc", "size").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page", "block", "line", "span")).alias("at"))
    top = n.groupBy("doc").agg(F.min_by("size", F.struct(-F.col("n"), F.col("at"))).alias("body_size"))
    return docs.join(top, "doc", "left").select("doc", F.coalesce("body_size", F.lit(10.0)).alias("body_size"))


def span_heading_level(size: Column, body: Column, bold: Column, text: Column) -> Column:
    """1 to 3 by the ratio of font sizes, 3 for bold numbered lines; null for body text."""
    s, r = strip(text), size / body
    level = F.when(r >= 1.4, 1).when(r >= 1.2, 2).when((r >= 1.05) & bold, 3).when(bold & s.rlike(r"^\d+(\.\d+)*\s") & (F.length(s) < 80), 3)
    return F.when((s == "") | (F.length(s) > 120) | (body <= 0), F.lit(None).cast("int")).otherwise(level)


def spans_to_blocks(spans: DataFrame, pages: int = 5) -> DataFrame:
    """doc, page, block, level, text: blocks of a page layout; the first heading level in a block wins."""
    body = body_sizes(spans, pages)
    lines = spans.groupBy("doc", "page", "block", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda x: x["text"]), "").alias("text"),
        F.max_by(F.struct("size", "bold"), F.struct("size", -F.col("span"))).alias("widest"),
    )
    levelled = lines.join(body, "doc").withColumn("level", span_heading_level(F.col("widest.size"), F.col("body_size"), F.col("widest.bold"), F.col("text")))
    blocks = levelled.groupBy("doc", "page", "block").agg(F.array_sort(F.collect_list(F.struct("line", "text", "level"))).alias("ls"))
    text = strip(F.array_join(F.transform("ls", lambda x: strip(x["text"])), " "))
    first = F.try_element_at(F.filter("ls", lambda x: x["level"].isNotNull()), F.lit(1))["level"]
    return blocks.select("doc", "page", "block", first.alias("level"), text.alias("text")).where(F.col("text") != "")


def blocks_to_documents(blocks: DataFrame) -> DataFrame:
    """doc, markdown, page_map: blocks joined by empty lines, with the characters of each page."""
    piece = F.concat(F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "))).otherwise(""), F.col("text"), F.lit("\n\n"))
    pages = blocks.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", piece.alias("t")))), lambda x: x["t"]), "").alias("t"))
    w = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    placed = pages.withColumn("start", F.coalesce(F.sum(F.length("t")).over(w), F.lit(0)).cast("int"))
    whole = placed.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "t", "start"))).alias("ps"))
    return whole.select(
        "doc", F.array_join(F.transform("ps", lambda x: x["t"]), "").alias("markdown"),
        F.transform("ps", lambda x: F.struct(x["start"].alias("char_start"), (x["start"] + F.length(x["t"])).alias("char_end"), x["page"].alias("page"))).alias("page_map"),
    )


def page_of(page_map: Column, position: Column) -> Column:
    """The page whose characters hold the position, else the last page; null without pages."""
    hit = F.try_element_at(F.filter(page_map, lambda x: (x["char_start"] <= position) & (position < x["char_end"])), F.lit(1))["page"]
    return F.coalesce(hit, F.try_element_at(page_map, F.lit(-1))["page"])


def heading_lines(documents: DataFrame, key: str = "id", text: str = "markdown") -> DataFrame:
    """key, line_no, level, title of markdown headings."""
    lines = documents.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    m = F.regexp_extract("line", r"^(#{1,6})\s+(.+?)\s*$", 1)
    return lines.select(key, "line_no", F.length(m).alias("level"), F.regexp_extract("line", r"^(#{1,6})\s+(.+?)\s*$", 2).alias("title")).where(F.col("level") > 0)


def heading_paths(headings: DataFrame, key: str = "id") -> DataFrame:
    """key, line_no, path: titles from the outermost heading down to each heading itself.

    A heading closes those of its own and deeper levels: the title at a level counts only if it is
    newer than the last heading above that level. Windows per document, in line order.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    df = headings
    for n in range(1, 7):
        df = df.withColumn(f"__at{n}", F.last(F.when(F.col("level") == n, F.col("line_no")), ignorenulls=True).over(w))
        df = df.withColumn(f"__t{n}", F.last(F.when(F.col("level") == n, F.col("title")), ignorenulls=True).over(w))
    parts, above = [], F.lit(-1)
    for n in range(1, 7):
        at = F.coalesce(F.col(f"__at{n}"), F.lit(-1))
        parts.append(F.when((F.col("level") >= n) & (at > above), F.col(f"__t{n}")))
        above = F.greatest(above, at)
    return df.select(key, "line_no", "level", "title", F.array_compact(F.array(*parts)).alias("path"))


def _slug(title: str) -> str:
    kept = re.sub(r"[^\w\s-]", "", title.lower())
    return re.sub(r"\s+", "-", kept).strip("-") or "section"


def scan_chunks(text: str, max_tokens: int = MAX_TOKENS) -> Iterator[tuple[int, int, str, list[tuple[int, str, str]]]]:
    """start, end, stripped text and section path of a document's chunks, in order.

    A heading ends the chunk before it; an empty line ends one that has reached ``max_tokens``
    (four characters each). A line that brings a chunk to twice that is the occasion of one cut, at
    the last space within ``max_tokens``; what follows is carried on without its leading space, by
    which the offsets of a chunk after a cut may lag. Offsets are those before stripping.
    """
    path: list[tuple[int, str, str]] = []
    held: list[str] = []
    size, start, at = 0, 0, 0

    def chunk(body: str, a: int, b: int) -> Iterator[tuple[int, int, str, list[tuple[int, str, str]]]]:
        body = body.strip()
        if body:
            yield a, b, body, list(path)

    for line in text.splitlines(keepends=True):
        end, bare = at + len(line), line.rstrip("\r\n")
        heading = _HEADING.match(bare) if bare.startswith("#") else None
        if heading:
            yield from chunk("".join(held), start, at)
            held, size, start = [], 0, end
            level, title = len(heading[1]), heading[2].strip()
            while path and path[-1][0] >= level:
                path.pop()
            path.append((level, title, _slug(title)))
        elif not bare:
            held.append(line)
            size += len(line)
            if max(1, size // 4) >= max_tokens:
                yield from chunk("".join(held), start, end)
                held, size, start = [], 0, end
        else:
            if not held:
                start = at
            held.append(line)
            size += len(line)
            if max(1, size // 4) >= 2 * max_tokens:
                whole = "".join(held)
                cut = whole.rfind(" ", 0, 4 * max_tokens)
                cut = cut if cut > 0 else 4 * max_tokens
                yield from chunk(whole[:cut], start, start + cut)
                rest = whole[cut:].lstrip()
                held, size, start = ([rest] if rest else []), len(rest), start + cut
        at = end
    yield from chunk("".join(held), start, at)


_NODE = pa.struct([("level", pa.int32()), ("title", pa.string()), ("anchor", pa.string())])
_PLACE = pa.struct([("source_id", pa.string()), ("source_path", pa.string()), ("source_format", pa.string()), ("page", pa.int32()), ("line_start", pa.int32()), ("line_end", pa.int32())])
_CHUNK_ARROW = pa.schema(
    [("artifact_id", pa.string()), ("chunk_ix", pa.int32()), ("id", pa.string()), ("text", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32()), ("token_count", pa.int32()), ("section_path", pa.list_(_NODE)), ("locator", _PLACE)]
)
#: Rows handed on at a time; bounds a task's memory.
_ROWS = 2000


def _chunk_rows(batch: pa.RecordBatch, max_tokens: int) -> Iterator[list[dict]]:
    out: list[dict] = []
    for doc in batch.to_pylist():
        text, pages, seen, lines = doc["markdown"], doc["page_map"] or [], 0, 0
        for i, (a, z, body, path) in enumerate(scan_chunks(text, max_tokens)):
            page = first = last = None
            if pages:
                page = next((p["page"] for p in pages if p["char_start"] <= a < p["char_end"]), pages[-1]["page"])
            else:
                # Offsets may lag after a cut, so counting starts again where one goes back.
                lines, seen = (lines + text.count("\n", seen, a) if a >= seen else text.count("\n", 0, a)), a
                first, last = lines + 1, lines + 1 + text.count("\n", a, z)
            key = hashlib.sha256(f"{doc['source_sha256']}:{a}:{z}".encode()).hexdigest()[:16]
            place = {"source_id": doc["id"], "source_path": doc["source_path"], "source_format": doc["source_format"], "page": page, "line_start": first, "line_end": last}
            nodes = [{"level": n, "title": t, "anchor": s} for n, t, s in path]
            out.append({"artifact_id": doc["artifact_id"], "chunk_ix": i, "id": key, "text": body, "char_start": a, "char_end": z, "token_count": max(1, len(body) // 4), "section_path": nodes, "locator": place})
            if len(out) >= _ROWS:
                yield out
                out = []
    if out:
        yield out


def chunk_documents(documents: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Chunks of ``documents`` (id, source_path, source_format, source_sha256, markdown, page_map).

    Null texts have none. Positions are pages for documents with pages, else lines.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from (pa.RecordBatch.from_pylist(part, schema=_CHUNK_ARROW) for part in _chunk_rows(batch, max_tokens))

    rows = documents.where(F.col("markdown").isNotNull()).select("id", "source_path", "source_format", "source_sha256", "markdown", "page_map", short_hash(F.col("id"), F.lit("chunks"), sep=":").alias("artifact_id"))
    return rows.mapInArrow(cut, CHUNK_SCHEMA)


def eligible(chunks: DataFrame, least: int = MIN_CHUNK_CHARS, first: int | None = None) -> DataFrame:
    """Chunks long enough for extraction; with ``first``, only those among the first of each document."""
    df = chunks
    if first is not None:
        w = Window.partitionBy("artifact_id").orderBy("chunk_ix")
        df = df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= first).drop("__n")
    return df.where(F.length("text") >= least)
