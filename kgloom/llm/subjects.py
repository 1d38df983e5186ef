"""Subject areas of documents, from sentence classifiers trained on weak labels.

Labels exist for some documents only, as a set per document, while a document is about the subjects
of its single sentences. So the labels are weak for sentences: a sentence of a labelled document
belongs to one of the document's subjects or to none. The headings of a labelled document are further
training sentences with its labels; a heading labels no sentence under it, and the headings of documents
without labels are not used. One linear classifier per subject against the rest is trained on hashed
word n-grams, first with all inherited labels, then again without those that it rejects itself.
The threshold of each is calibrated on labelled documents held out from training, for the rule that
is asked for: a document has a subject that at least ``MIN_SENTENCES`` of its sentences have.

The models are fitted on a bounded sample of labelled documents (``max_docs``, ``max_chars``);
every document is then scored whole. Texts never leave their task; what is shuffled is one row per
document and subject found.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash buckets of the n-grams.
BUCKETS = 1 << 18
MIN_SENTENCES = 2
#: A model is fitted on at most so many labelled documents (and as many texts of no subject), those
#: of the smallest hashes among documents of at most so many characters, taken whole. Every
#: document is scored, whatever its size.
MAX_DOCS, MAX_CHARS = 8_000, 20_000
#: Features (in scoring, characters) handled at a time; bounds the memory.
BLOCK = 200_000

_LINE_END = re.compile(r"[\r\n\x0b\x0c\x85\u2028\u2029]+")
_SENTENCE_END = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+")
_CLUTTER = re.compile(r"\[\d+/\d+\]|\(\d+\)|(?:[-—–]\s*\d+\s*[-—–])|(?:\*\s*){3,}")
_WORD = re.compile(r"[^\W_]+")


def sentences(text: str) -> tuple[list[str], list[str]]:
    """The sentences of a text and its headings. Lines marked with ``#`` are headings; an unmarked
    line, even one that stands alone, is running text; page clutter is neither."""
    found: list[str] = []
    heads: list[str] = []
    run: list[str] = []

    def flush() -> None:
        for s in _SENTENCE_END.split(" ".join(run)):
            if _WORD.search(s):
                found.append(s)
        run.clear()

    for line in _LINE_END.split(text):
        line = _CLUTTER.sub(" ", line).strip()
        if line.startswith("#"):
            flush()
            heads.append(line.lstrip("# "))
        elif line:
            run.append(line)
    flush()
    return found, heads


class _WordHashes(dict):
    """A hash of every word met; numbers are all one word. Cleared where it would grow beyond bounds."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = zlib.crc32(b"0" if word.isdigit() else word.encode())
        return h


_HASHES = _WordHashes()


def features(sents: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sentence and bucket of every different hashed unigram and bigram, in order of the sentences."""
    words = [_WORD.findall(s.lower()) for s in sents]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter(map(_HASHES.__getitem__, chain.from_iterable(words)), np.int64, int(lengths.sum()))
    at = np.repeat(np.arange(len(words)), lengths)
    together = at[1:] == at[:-1]
    pairs = (h[:-1] * 0x9E3779B1 + h[1:])[together]
    grams = np.concatenate([h, pairs ^ (pairs >> 29)]) & (BUCKETS - 1)
    both = np.unique(np.concatenate([at, at[1:][together]]) * BUCKETS + grams)
    return both // BUCKETS, both % BUCKETS


@dataclass
class Model:
    """One linear classifier per subject on the buckets that training met, and its threshold."""

    subjects: list[str]
    weights: np.ndarray  # float32 [buckets met + 1, subjects]; the last row is the bias
    index: np.ndarray  # int32 [BUCKETS]; row of a bucket, -1 for one not met
    thresholds: np.ndarray

    def scores(self, sents: Sequence[str]) -> np.ndarray:
        out = np.tile(self.weights[-1], (len(sents), 1))
        # Blocks of sentences bound the memory for their features.
        start, size = 0, 0
        for i, s in enumerate(sents):
            size += len(s)
            if size >= BLOCK or i + 1 == len(sents):
                rows, buckets = features(sents[start : i + 1])
                place = self.index[buckets]
                rows, place = rows[place >= 0], place[place >= 0]
                if len(rows):
                    ids, starts = np.unique(rows, return_index=True)
                    out[start + ids] += np.add.reduceat(self.weights[place], starts)
                start, size = i + 1, 0
        return out

    def counts(self, texts: Sequence[str]) -> np.ndarray:
        """How many sentences of each text each subject has: [texts, subjects]."""
        found = [sentences(t)[0] for t in texts]
        flat = {s: i for i, s in enumerate(dict.fromkeys(chain.from_iterable(found)))}
        hits = (self.scores(list(flat)) >= self.thresholds).astype(np.int64)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        out = np.zeros((len(texts), len(self.subjects)), np.int64)
        if flat and lengths.any():
            at = np.fromiter(map(flat.__getitem__, chain.from_iterable(found)), np.int64, int(lengths.sum()))
            some = np.flatnonzero(lengths)
            out[some] = np.add.reduceat(hits[at], np.concatenate([[0], np.cumsum(lengths[some])[:-1]]))
        return out


class Design:
    """Sparse 0/1 features, kept in both orders so that either product is one segmented sum."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, n: int, width: int):
        self.n, self.width = n, width
        order = np.argsort(cols, kind="stable")
        self.by_row = self._segments(rows, cols)
        self.by_col = self._segments(cols[order], rows[order])

    @staticmethod
    def _segments(keys: np.ndarray, others: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of whole segments: the keys, their starts, the other index of each entry."""
        ids, starts = np.unique(keys, return_index=True)
        cuts = np.unique(np.searchsorted(starts, np.arange(0, len(keys), BLOCK)))
        out = []
        for a, b in zip(cuts, [*cuts[1:], len(ids)]):
            first, last = starts[a], starts[b] if b < len(ids) else len(keys)
            out.append((ids[a:b].astype(np.int32), starts[a:b] - first, others[first:last].astype(np.int32)))
        return out

    @staticmethod
    def _product(blocks: list, values: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((size, values.shape[1]), np.float32)
        for ids, starts, others in blocks:
            if len(ids):
                out[ids] = np.add.reduceat(values[others], starts)
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        return self._product(self.by_row, w, self.n)

    def transposed_times(self, x: np.ndarray) -> np.ndarray:
        return self._product(self.by_col, x, self.width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: Design, target: np.ndarray, rounds: int, start: np.ndarray | None = None, rate: float = 0.5, decay: float = 2e-6) -> np.ndarray:
    """Logistic regressions, one per column of ``target``, by full-batch AdaGrad; the last row is the bias."""
    w = np.zeros((x.width + 1, target.shape[1]), np.float32) if start is None else start.copy()
    if start is None:
        w[-1] = -2
    seen = np.full(w.shape, 1e-7, np.float32)
    for _ in range(rounds):
        err = ((_sigmoid(x.times(w[:-1]) + w[-1]) - target) / max(1, x.n)).astype(np.float32)
        grad = np.vstack([x.transposed_times(err), err.sum(0, keepdims=True)]) + decay * w
        seen += grad * grad
        w -= rate * grad / np.sqrt(seen)
    return w


def train(docs: Sequence[tuple[str, frozenset[str]]], subjects: Sequence[str], foreign: Sequence[str] = (), held_out: float = 0.25, rounds: int = 25, relabel: int = 3, keep: float = 0.5) -> Model:
    """Fit on (text, subjects) of labelled documents; every fourth one calibrates the thresholds.

    ``foreign`` are texts of no subject. A sentence first inherits the subjects of its document. Phrases of no subject then occur with
    every subject at its base rate and get no weight, in any language. Sentences that the
    classifier of an inherited subject rejects lose it, and the classifier is fitted again.
    """
    subjects = sorted(subjects)
    place = {s: i for i, s in enumerate(subjects)}
    step = max(2, round(1 / held_out))
    held = [i % step == 0 and len(docs) >= 4 * step for i in range(len(docs))]
    sents: list[str] = []
    labelled: list[list[int]] = []
    for (text, labels), skip in zip(docs, held):
        if not skip:
            body, heads = sentences(text)
            for s in dict.fromkeys([*body, *heads]):
                sents.append(s)
                labelled.append([place[x] for x in labels])
    for text in foreign:
        body, _ = sentences(text)
        sents += body
        labelled += [[]] * len(body)
    rows, buckets = features(sents)
    met = np.unique(buckets)
    index = np.full(BUCKETS, -1, np.int32)
    index[met] = np.arange(len(met))
    inherited = np.zeros((len(sents), len(subjects)), np.float32)
    for i, ks in enumerate(labelled):
        inherited[i, ks] = 1
    x = Design(rows, index[buckets].astype(np.int64), len(sents), len(met))
    weights = fit_linear(x, inherited, rounds)
    for _ in range(relabel):
        p = _sigmoid(x.times(weights[:-1]) + weights[-1])
        weights = fit_linear(x, inherited * (p >= keep), rounds, weights)
    model = Model(list(subjects), weights, index, np.zeros(len(subjects)))
    if docs:
        model.thresholds = _thresholds(model, [d for d, h in zip(docs, held) if h] or list(docs), place)
    return model


def _thresholds(model: Model, docs: Sequence[tuple[str, frozenset[str]]], place: dict[str, int]) -> np.ndarray:
    """Per subject the middle of the thresholds that are best for documents not trained on."""
    second = np.full((len(docs), len(place)), -np.inf)
    truth = np.zeros((len(docs), len(place)), bool)
    for i, (text, labels) in enumerate(docs):
        body, _ = sentences(text)
        if len(body) >= MIN_SENTENCES:
            second[i] = np.sort(model.scores(body), axis=0)[-MIN_SENTENCES]
        for s in labels:
            truth[i, place[s]] = True
    out = np.zeros(len(place))
    grid = np.linspace(-4, 4, 81)
    for k in range(len(place)):
        got = second[:, k][:, None] >= grid
        hit = (got & truth[:, k][:, None]).sum(0)
        f1 = 2 * hit / np.maximum(1, got.sum(0) + truth[:, k].sum())
        best = grid[f1 >= f1.max() - 1e-9]
        out[k] = best[np.argmin(np.abs(best - np.median(best)))] if truth[:, k].any() else 0.0
    return out


def labelled_sample(documents: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> list[tuple[str, frozenset[str]]]:
    """At most ``max_docs`` labelled documents of at most ``max_chars`` characters with their subjects, the same ones for the same input."""
    sets = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    some = sets.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    texts = documents.where(F.length("text") <= max_chars).select("doc_id", "text")
    rows = texts.join(some, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").toPandas()
    return [(t, frozenset(s)) for t, s in zip(rows["text"], rows["subjects"])]


def document_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame, foreign: DataFrame | None = None, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, subject, n_sentences: every subject that at least two sentences of the text have.

    ``foreign``: texts (column ``text``) that are of no subject wherever they are quoted; a model is
    fitted on ``max_docs`` of them at most, those of the smallest hashes.

    Null ids and null or blank texts have no rows; a repeated row counts once; labels of unknown
    documents or subjects are ignored; without any label nothing is found. Headings are no
    sentences, but a model learns from them.
    """
    names = sorted({r[0] for r in areas.select("subject").where(F.col("subject").isNotNull()).distinct().collect()})
    known = set(names)
    sample = [(t, frozenset(s & known)) for t, s in labelled_sample(documents, labels, max_docs)]
    alien = [] if foreign is None else [r[0] for r in foreign.select("text").where(F.col("text").isNotNull()).distinct().orderBy(F.xxhash64("text"), "text").limit(max_docs).collect()]
    shared = documents.sparkSession.sparkContext.broadcast(train(sample, names, alien))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.iloc[start : start + 256]
                n = model.counts(part["text"].tolist())
                i, k = np.nonzero(n >= MIN_SENTENCES)
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[i], "subject": np.array(model.subjects, object)[k], "n_sentences": n[i, k].astype(np.int32)})

    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    return texts.mapInPandas(score, "doc_id bigint, subject string, n_sentences int").distinct()
