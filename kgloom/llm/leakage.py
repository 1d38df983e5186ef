"""Evaluation texts leaking into training text, by template canonicalisation.

A text is reduced to its words, without case, punctuation, spacing, layout, markup and invisible
characters. In a template, numbers and units are replaced by typed placeholders, and so is
every word that is no ordinary word of the evaluation texts: it stands for a name. Windows of
``WINDOW`` template words are hashed and joined; the slots of matching windows then tell a passage
that is the same word for word from one with other names and numbers filled in consistently, and
from a chance match.

The windows of the evaluation texts are counted and broadcast only where they are few; the corpus
side is then scanned without any shuffle of its windows. Beyond, both sides are shuffled by hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.operators.units import MULTIPLIERS, NUMBER_WORDS, SPELLINGS
from kgloom.session import cut, is_small, small_side

WINDOW = 12
#: Windows of evaluation texts that are still broadcast (about 40 bytes each).
MAX_BROADCAST = 1_000_000
#: Ordinary words kept in templates. For exact leaks the most frequent ones serve: fewer make templates
#: coarser and their matches more, of which the word hash then keeps the same ones. Verdicts on slots
#: need all of them, and more are an error.
MAX_VOCABULARY = 50_000
#: A passage with other names and numbers is a re-parameterised item if it covers so much of its words.
COVERAGE = 0.5

NUMBERS = tuple(sorted({*NUMBER_WORDS, *MULTIPLIERS, "dozen", "half"}))
UNITS = tuple(sorted({n for kinds in SPELLINGS.values() for names in kinds.values() for n in names if n.isalpha() and len(n) > 3}))


def _bare(text: Column) -> Column:
    """Without tags, entities, link targets, invisible characters, apostrophes and marks of emphasis."""
    inline = F.regexp_replace(text, r"(?i)</?(?:b|i|u|em|strong|span|a|code|sub|sup|mark|s|small)(?:\s[^<>]*)?>|&(?:apos|rsquo|lsquo|shy|#39|#8217);", "")
    return F.regexp_replace(F.regexp_replace(inline, r"<[/!a-zA-Z][^<>]*>|&(?:[a-zA-Z]{2,8}|#\d{1,6});|(?<=\])\([^()\s]*\)", " "), r"[\p{Cf}'’ʼ`*~]+", "")


def words(text: Column) -> Column:
    """The words of a text in lower case, in order."""
    return F.array_remove(F.split(F.lower(_bare(text)), r"[^\p{L}\p{M}\p{N}]+"), "")


def ordinary_words(items: DataFrame, text: str = "text", limit: int = MAX_VOCABULARY, whole: bool = False) -> list[str]:
    """Words of the evaluation texts that are no names: seen in lower case, or only at a sentence's start.

    At most the ``limit`` most frequent ones; with ``whole``, more of them are an error.
    """
    marked = F.regexp_replace(_bare(F.col(text)), r"(^|[.!?]\s+)\p{L}+", r"$1")
    lower = F.filter(F.split(marked, r"[^\p{L}\p{M}\p{N}]+"), lambda w: w == F.lower(w))
    middle = F.filter(F.split(marked, r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != F.lower(w))
    seen = items.select(F.explode(words(F.col(text))).alias("w"), F.lit(1).alias("n"), F.lit(0).alias("low"), F.lit(0).alias("name"))
    seen = seen.unionAll(items.select(F.explode(lower), F.lit(0), F.lit(1), F.lit(0))).unionAll(items.select(F.explode(F.transform(middle, F.lower)), F.lit(0), F.lit(0), F.lit(1)))
    counts = seen.groupBy("w").agg(F.sum("n").alias("n"), F.max("low").alias("low"), F.max("name").alias("name"))
    kept = [r["w"] for r in counts.where((F.col("w") != "") & ((F.col("low") == 1) | (F.col("name") == 0))).orderBy(F.desc("n"), "w").limit(limit + 1).select("w").collect()]
    if whole and len(kept) > limit:
        raise ValueError(f"the evaluation texts have over {limit} ordinary words; pass a larger limit")
    return kept[:limit]


def template(word: Column, vocabulary: list[str]) -> Column:
    """The word itself if it is ordinary, else the placeholder of its type.

    Most words are in none of the lists, so one look into all of them comes first. A word of letters,
    marks and digits begins with a plain digit if it is before the colon in the order of code points.
    """
    digit = F.when(word < ":", True).when(word >= "\u0080", word.rlike(r"^\p{N}")).otherwise(False)
    listed = F.when(word.isin(*NUMBERS), "<number>").when(word.isin(*UNITS), "<unit>").otherwise(word)
    return F.when(word.isin(*{*NUMBERS, *UNITS, *vocabulary}), F.when(digit, "<number>").otherwise(listed)).when(digit, "<number>").otherwise("<name>")


def windows(texts: DataFrame, key: str, vocabulary: list[str], text: str = "text", window: int = WINDOW) -> DataFrame:
    """key, at, t, e: place, template hash and word hash of every window of every text."""
    # One step per column, so that no expression is evaluated twice.
    w = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key), words(F.col(text)).alias("__w"))
    h = w.select(key, F.transform("__w", lambda x: F.xxhash64(x)).alias("__e"), F.transform("__w", lambda x: F.xxhash64(template(x, vocabulary))).alias("__t"))
    n = F.size("__e")
    starts = F.when(n >= window, F.sequence(F.lit(1), n - window + 1))
    pairs = F.transform(starts, lambda i: F.struct(F.xxhash64(F.slice("__t", i, window)).alias("t"), F.xxhash64(F.slice("__e", i, window)).alias("e")))
    return h.select(key, F.posexplode(pairs).alias("at", "p")).select(key, "at", "p.t", "p.e")


def matches(documents: DataFrame, items: DataFrame, vocabulary: list[str], window: int = WINDOW, doc: str = "doc_id", item: str = "item_id") -> DataFrame:
    """doc, item, at, item_at, same: pairs of windows of one template; same if word for word."""
    asked = windows(items, item, vocabulary, window=window).select(item, F.col("at").alias("item_at"), "t", F.col("e").alias("item_e")).distinct()
    if is_small(asked, MAX_BROADCAST):
        asked = F.broadcast(asked)
    found = windows(documents, doc, vocabulary, window=window).join(asked, "t")
    return found.select(doc, item, "at", "item_at", (F.col("e") == F.col("item_e")).alias("same"))


def leaked(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id: documents with at least ``window`` consecutive words of an item.

    Null ids and texts, and texts of fewer words, have no rows; repeated rows count once.
    """
    return matches(documents, items, ordinary_words(items), window).where("same").select("doc_id", "item_id").distinct()


def leaked_templates(documents: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, n_windows, verdict: also items that occur with other slots filled in.

    The windows of a document and an item that lie on one diagonal are one passage, of which the
    longest counts. Its verdict is ``exact`` where all slots are the same. Else it is ``phrase`` where
    it covers less than ``coverage`` of the item's words, ``reparameterised`` where every slot value of the item
    stands for one value in the document and the reverse, and ``inconsistent`` where not.

    Of the corpus only the few documents with a match are read again and cut to the passage: their ids
    are found by the join of windows and, where few, broadcast. An id with several texts has the
    longest passage of any; null ids and texts have no rows.
    """
    vocabulary = ordinary_words(items, whole=True)
    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("d"), "text")
    asked = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.struct("item_id", F.xxhash64("text").alias("h")).alias("i"), "text").dropDuplicates(["i"])
    runs = matches(texts, asked, vocabulary, window, "d", "i").distinct().groupBy("d", "i", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.count(F.lit(1)).alias("n_windows"), F.min("at").alias("first"), F.max("at").alias("last"), F.every("same").alias("all_same")
    )
    rank = F.struct("n_windows", "all_same", -F.col("first"), "shift", "d", "i", "last", "first")
    best = cut(runs.groupBy("d.doc_id", "i.item_id").agg(F.max(rank).alias("r")).select("r.*"))
    matched = best.select("d").distinct()
    doc_words = texts.join(small_side(matched, MAX_BROADCAST), "d", "left_semi").dropDuplicates(["d"]).select("d", words(F.col("text")).alias("dw"))
    item_words = asked.select("i", words(F.col("text")).alias("iw"))
    size = F.col("last") - F.col("first") + window
    both = best.join(doc_words, "d").join(item_words, "i").select(
        "d.doc_id", "i.item_id", "n_windows", "all_same", (size < coverage * F.size("iw")).alias("short"),
        F.arrays_zip(F.slice("dw", F.col("first") + 1, size).alias("d"), F.slice("iw", F.col("first") - F.col("shift") + 1, size).alias("i")).alias("z"),
    )
    slots = F.array_distinct(F.filter("z", lambda x: template(x["i"], vocabulary).isin("<number>", "<unit>", "<name>")))
    got = both.select("doc_id", "item_id", "n_windows", "all_same", "short", slots.alias("s"))
    one_to_one = (F.size(F.array_distinct(F.transform("s", lambda x: x["d"]))) == F.size("s")) & (F.size(F.array_distinct(F.transform("s", lambda x: x["i"]))) == F.size("s"))
    verdict = F.when(F.col("all_same"), "exact").when(F.col("short"), "phrase").when(one_to_one, "reparameterised").otherwise("inconsistent")
    return got.select("doc_id", "item_id", "n_windows", verdict.alias("verdict"))
