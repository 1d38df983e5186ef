"""Filling fixed-capacity containers with whole documents: best-two-fit.

A container is filled greedily, each time with the largest document left that fits. Then its
smallest document gives way to two of those left, if two fit the gap so widened more tightly.

Documents are sized in tokens of a public tokenizer whose file is a parameter. They are spread over
shards of about ``SHARD_ITEMS`` documents by a hash of their id; each shard is a fair sample of all
lengths and is packed on its own, which leaves at most a few containers of a shard less than full.
Only ids and lengths are shuffled, never texts.
"""

from __future__ import annotations

import json
import math
import os
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.session import cut

CAPACITY = 2048
SHARD_ITEMS = 8192
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"

#: Lengths of parts of texts that a task keeps; they are forgotten where there are more.
KEPT_PARTS = 1_000_000

# Fixed value: how tokenizers of kind ByteLevel with their own pattern part a text before merging bytes.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class Lengths(dict):
    """Lengths of texts in tokens of one tokenizer.

    Where the tokenizer parts a text by the well-known pattern and merges within parts only, as its file
    says, a length is the sum of its parts' lengths, and a part met before is not encoded again. Other
    tokenizers encode every text whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(self.tokenizer.to_str())
        parted = spec.get("pre_tokenizer") or {}
        self.by_parts = parted.get("type") == "ByteLevel" and parted.get("use_regex", True) and not parted.get("add_prefix_space") and not spec.get("normalizer") and not spec.get("truncation") and spec["model"]["type"] == "BPE"

    def __missing__(self, part: str) -> int:
        if len(self) >= KEPT_PARTS:
            self.clear()
        self[part] = n = len(self.tokenizer.encode(part, add_special_tokens=False))
        return n

    def of(self, texts: Sequence[str]) -> list[int]:
        if self.by_parts:
            return [sum(map(self.__getitem__, _PARTS.findall(t))) for t in texts]
        return [len(e) for start in range(0, len(texts), 64) for e in self.tokenizer.encode_batch(texts[start : start + 64], add_special_tokens=False)]


@lru_cache(2)
def _lengths(path: str) -> Lengths:
    return Lengths(path)


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens: the length of every different non-null text.

    ``tokenizer`` is the path of the tokenizer's file on every machine that runs tasks.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths = _lengths(tokenizer)
        for b in batches:
            yield b[["doc", "h"]].assign(n_tokens=lengths.of(b["text"].tolist()))

    kind = dict(documents.dtypes)[key]
    texts = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    counted = texts.mapInPandas(count, f"doc {kind}, h bigint, n_tokens int")
    return counted.distinct().select(F.col("doc").alias(key), "n_tokens")


def best_two_fit(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Containers as lists of positions in ``sizes``; every size is within 1 and ``capacity``."""
    left: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        left.setdefault(sizes[i], []).append(i)
    kinds = sorted(left)

    def take(size: int) -> int:
        i = left[size].pop()
        if not left[size]:
            del left[size]
            kinds.pop(bisect_left(kinds, size))
        return i

    def put(i: int) -> None:
        if sizes[i] not in left:
            left[sizes[i]] = []
            insort(kinds, sizes[i])
        left[sizes[i]].append(i)

    out = []
    while kinds:
        container, gap = [], capacity
        while kinds and kinds[0] <= gap:
            size = kinds[bisect_right(kinds, gap) - 1]
            container.append(take(size))
            gap -= size
        if gap and kinds:
            smallest = sizes[container[-1]]
            pair = _best_pair(kinds, left, gap + smallest, smallest)
            if pair:
                put(container.pop())
                container += [take(pair[0]), take(pair[1])]
        out.append(container)
    return out


def _best_pair(kinds: list[int], left: dict[int, list[int]], room: int, above: int) -> tuple[int, int] | None:
    """The two sizes left whose sum is the greatest within ``room``, if it exceeds ``above``."""
    best, pair = above, None
    i, j = 0, bisect_right(kinds, room) - 1
    while i <= j:
        total = kinds[i] + kinds[j]
        if total > room or (i == j and len(left[kinds[i]]) < 2):
            j -= 1
            continue
        if total > best:
            best, pair = total, (kinds[j], kinds[i])
            if best == room:
                break
        i += 1
    return pair


def pack(lengths: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", size: str = "n_tokens", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """key, piece_ix, n_tokens, container: every item in one container, none over its capacity.

    Only an item above the capacity is cut: into full pieces, which fill containers of their own, and
    the rest, which is packed like any item. Items without tokens need no container and have no row.
    """
    kind = dict(lengths.dtypes)[key]
    # Lengths are written once: they are counted, then packed, and texts must not be tokenized twice.
    items = cut(lengths.where(F.col(key).isNotNull() & (F.col(size) > 0)).select(F.col(key).alias("k"), F.col(size).cast("bigint").alias("n")))
    shards = max(1, math.ceil(items.count() / shard_items))
    cut_up = items.select("k", F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {capacity}")), lambda i: F.struct(i.cast("int").alias("ix"), F.least(F.col("n") - i * capacity, F.lit(capacity)).cast("int").alias("n")))).alias("p"))
    pieces = cut_up.select("k", F.col("p.ix").alias("ix"), F.col("p.n").alias("n"), F.pmod(F.xxhash64("k"), F.lit(shards)).alias("shard"))
    full = pieces.where(F.col("n") == capacity).select("k", "ix", "n", F.concat_ws("-", F.lit("full"), F.col("k").cast("string"), F.col("ix").cast("string")).alias("container"))

    def one_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "k", "ix"]).reset_index(drop=True)
        names = [""] * len(pdf)
        for c, members in enumerate(best_two_fit(pdf["n"].tolist(), capacity)):
            for i in members:
                names[i] = f"{pdf['shard'].iloc[0]}-{c}"
        return pdf.assign(container=names)[["k", "ix", "n", "container"]]

    rest = pieces.where(F.col("n") < capacity).groupBy("shard").applyInPandas(one_shard, f"k {kind}, ix int, n int, container string")
    return full.unionAll(rest).select(F.col("k").alias(key), F.col("ix").alias("piece_ix"), F.col("n").alias(size), "container")
