"""Splitting oversized items at natural boundaries.

A text goes through a hierarchy of separators: section (a heading line behind an empty line),
paragraph, line, sentence, word, character. A unit that fits is kept whole; one that does not is
cut by the next finer separator. Units are then packed greedily into pieces, each with the item's
context line in front and, where asked for, the end of the piece before it as overlap.

The boundary reported for an item is the finest separator that this cutting had to use.

Work is linear in the text and happens row by row, without any shuffle; only items above the limit
reach Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 2048
OVERLAP = 100
BOUNDARIES = ("paragraph", "line", "sentence", "word", "character")

# Where each kind of unit ends. A finer unit also ends where the coarser ones do, since it is cut
# out of them; a section ends at an empty line, where a paragraph does as well.
_BREAK = r"(?:\r\n|\r(?!\n)|[\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029])"
_EMPTY = rf"{_BREAK}(?:[^\S\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*{_BREAK})+"
_SECTION = re.compile(rf"{_EMPTY}(?=#{{1,6}}\s)")
_PARAGRAPH = re.compile(_EMPTY)
_LINE = re.compile(_BREAK)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_WORD = re.compile(r"\s+")
_ENDS = (_SECTION, _PARAGRAPH, _LINE, _SENTENCE, _WORD)


def context_line(section_path: Column) -> Column:
    """``[Section: T1 > T2]`` and two newlines; ``(no section)`` without any title."""
    titles = F.array_compact(F.transform(section_path, lambda x: x["title"]))
    joined = F.when(F.size(titles) > 0, F.array_join(titles, " > ")).otherwise("(no section)")
    return F.concat(F.lit("[Section: "), joined, F.lit("]\n\n"))


def units(text: str, level: int) -> list[tuple[int, int]]:
    """Start and end of the units of one text that are not blank, white space at the ends left out."""
    out, at = [], 0
    for m in _ENDS[level].finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    trimmed = []
    for a, b in out:
        part = text[a:b]
        lead = len(part) - len(part.lstrip())
        if lead < len(part):
            trimmed.append((a + lead, a + len(part.rstrip())))
    return trimmed


def atoms(text: str, room: int, step: int | None = None) -> Iterator[tuple[int, int, int]]:
    """Spans within ``room`` in order, each with the level of the separator that made it small enough.

    Every unit is cut by the coarsest separator that serves; only a word above the room is cut
    anywhere, into spans of ``step`` characters. Levels are places in ``_ENDS``, and their number
    for characters; a text that fits as it is has level 0.
    """
    stack = [(a, b, 0) for a, b in reversed(units(text, 0))]
    while stack:
        a, b, k = stack.pop()
        if b - a <= room:
            yield a, b, k
        elif k == len(_ENDS) - 1:
            yield from ((x, min(x + (step or room), b), k + 1) for x in range(a, b, step or room))
        else:
            stack.extend((a + x, a + y, k + 1) for x, y in reversed(units(text[a:b], k + 1)))


def cut_up(text: str, room: int, overlap: int = 0) -> tuple[str, list[str]]:
    """The boundary that serves and the pieces of at most ``room`` characters each, overlap included.

    Atoms are packed greedily. A piece after the first begins with the last ``overlap`` characters
    of what came before it, cut forward to a word's start where there is one; what separates them in
    the text stays between them. A unit that leaves less room than the overlap has a shorter one: the
    overlap makes no unit be cut.
    """
    room = max(1, room)
    overlap = max(0, min(overlap, room - 1))
    spans: list[list[int]] = []
    deepest = 0
    for a, b, level in atoms(text, room, room - overlap):
        deepest = max(deepest, level)
        if spans and b - spans[-1][0] <= room - (overlap if len(spans) > 1 else 0):
            spans[-1][1] = b
        else:
            spans.append([a, b])
    out = []
    for i, (a, b) in enumerate(spans):
        if i and overlap:
            lead = max(spans[i - 1][0], a - overlap, b - room)
            if lead < a and lead > 0 and not text[lead - 1].isspace():
                word = _WORD.search(text, lead, a)
                lead = word.end() if word and word.end() < a else lead
            a = min(a, lead)
        out.append(text[a:b])
    return BOUNDARIES[max(0, deepest - 1)], out


def boundary(text: str, room: int) -> str:
    """The coarsest kind of unit all of which are within ``room``."""
    return cut_up(text, room)[0] if room > 0 else BOUNDARIES[-1]


def pieces(text: str, room: int, overlap: int = 0) -> list[str]:
    """The text's pieces of at most ``room`` characters each, overlap included."""
    return cut_up(text, room, overlap)[1]


def split_items(items: DataFrame, item: str = "id", text: str = "text", context: Column | None = None, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """item, piece_ix, boundary, piece: the pieces of every item above the limit.

    ``context`` is put in front of every piece and counts towards the limit, in characters. An item
    whose context leaves no room for a single character is cut to pieces of ``limit`` characters
    without it, with boundary ``character``. ``boundary`` is the coarsest kind of unit that serves for
    the whole item, overlap not counted. Items that fit, null ids, null and blank texts have no rows; a repeated row repeats its
    pieces (:func:`chunk_pieces` drops them).
    """
    context = F.lit("") if context is None else context
    over = (
        items.select(F.col(item).alias("item"), F.col(text).alias("text"), context.alias("context"))
        .where(F.col("item").isNotNull() & (F.length("context") + F.length("text") > limit))
    )

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, t, c in zip(batch["item"], batch["text"], batch["context"]):
                fits = len(c) < limit
                kind, got = cut_up(t, limit - len(c) if fits else limit, overlap)
                out += [(i, n, kind if fits else BOUNDARIES[-1], (c if fits else "") + p) for n, p in enumerate(got)]
            yield pd.DataFrame(out, columns=["item", "piece_ix", "boundary", "piece"])

    kind = dict(over.dtypes)["item"]
    return over.mapInPandas(split, f"item {kind}, piece_ix int, boundary string, piece string")


def chunk_pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of the chunks whose context line and text exceed the limit."""
    return split_items(chunks, "id", "text", context_line(F.col("section_path")), limit, overlap).distinct()


def chunk_boundaries(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """chunk_id, boundary of every chunk that is split; only these two leave the tasks."""
    found = split_items(chunks, "id", "text", context_line(F.col("section_path")), limit, overlap)
    return found.select(F.col("item").alias("chunk_id"), "boundary").distinct()
