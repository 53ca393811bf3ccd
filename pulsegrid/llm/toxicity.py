"""Toxicity by subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (its edges marked) and itself, a passage of PASSAGE words the
bag of its words. Every subword has an embedding; the mean over a passage goes through a linear softmax
of two classes. Embeddings and softmax are trained together. A misspelling or an unseen form of a word
shares n-grams with the words that were seen, so it shares their vectors.

A text is as toxic as its most toxic passage, so one insult weighs as much in a long text as in a short
one. Labels are for whole texts: training goes by turns between finding each text's highest passage
and fitting to those passages, and to others of the texts without the label.

Only the fit runs on the driver, on whole texts of a bounded sample of the labelled rows (SAMPLE_DOCS and
SAMPLE_CHARS, which bounds the number of rows). Scoring reads every whole text in the tasks: because the model is linear, a subword's embedding folds into one number,
so what is sent to the tasks is one number for each bucket.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import ROWS_AT_ONCE, _arrow_type
from .common import released, whole_text

# Labelled texts that a fit uses at most, and characters of all of them together, from which on no further
# text is drawn; the drawn ones are whole. Scoring has no such bounds.
SAMPLE_DOCS, SAMPLE_CHARS = 6_000, 60_000_000
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
SHORTEST, LONGEST = 3, 6
PASSAGE = 24
DIM, ROUNDS, STEPS, RATE, DECAY = 4, 3, 80, 0.1, 1e-6
# Buckets that are trained: in this many sample texts, and in the texts of one label this many standard
# errors more often than in those of the other. All others keep the zero vector.
LEAST_TEXTS, LEAST_Z = 3, 4.0
# Code points that are looked at together; a longer text is cut behind a word.
SLICE = 1 << 18

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_MIX = np.uint64(0xFF51AFD7ED558CCD)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which code points are letters or marks; the powers of the hash's step and of its inverse."""
    letters = np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)
    powers = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * SLICE, x, np.uint64)])) for x in (_STEP, _BACK)]
    return letters, *powers


def _slices(text: str) -> Iterator[np.ndarray]:
    """The lower-cased text's code points in slices that end behind a word, or at SLICE * 2."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letters = _tables()[0]
    while len(codes) > 2 * SLICE - 2:
        gaps = np.flatnonzero(~letters[codes[SLICE : 2 * SLICE - 2]])
        end = SLICE + int(gaps[0]) if len(gaps) else 2 * SLICE - 2
        yield codes[:end]
        codes = codes[end:]
    yield codes


def _windows(codes: np.ndarray) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]:
    """The subwords of a slice: for each size the bucket of the window at each place and whether that
    window counts; and the place of each word (its first edge).

    The subwords of a word are its character n-grams with both edges marked, and all of it (size 0, one
    for each word). A window's hash is a difference of running sums, so its place does not matter.
    """
    letters, power, inverse = _tables()
    is_letter = np.zeros(len(codes) + 2, bool)
    is_letter[1:-1] = letters[codes]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[0] = True
    mark = ~is_letter[keep]
    value = np.zeros(len(codes) + 2, np.uint64)
    value[1:-1] = codes
    value = value[keep] + np.uint64(2)
    value[mark] = 1
    size = len(value)
    running = np.zeros(size + 1, np.uint64)
    np.cumsum(value * inverse[:size], out=running[1:])
    marks = np.zeros(size + 1, np.int32)
    np.cumsum(mark, out=marks[1:])

    def bucket(hashed: np.ndarray) -> np.ndarray:
        hashed ^= hashed >> np.uint64(31)
        hashed *= _MIX
        return (hashed >> np.uint64(64 - BUCKET_BITS)).view(np.int64)

    found = []
    for n in range(SHORTEST, min(LONGEST, size) + 1):
        places = size - n + 1
        hashed = (running[n:] - running[:places]) * power[:places]
        found.append((n, bucket(hashed), marks[n - 1 : size] == marks[1 : places + 1]))
    edges = np.flatnonzero(mark)
    whole = (running[edges[1:] + 1] - running[edges[:-1]]) * power[edges[:-1]]
    found.append((0, bucket(whole), np.ones(len(whole), bool)))
    return found, edges[:-1]


def subwords(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Word number and bucket of every subword, and the number of words."""
    found, edges = _windows(codes)
    words, buckets = [], []
    for n, bucket, counts in found:
        at = np.flatnonzero(counts)
        words.append(np.searchsorted(edges, at, side="right") - 1 if n else at)
        buckets.append(bucket[at])
    return np.concatenate(words), np.concatenate(buckets), len(edges)


def passage_means(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The mean weight of the subwords of each passage."""
    found, edges = _windows(codes)
    sums, counts = np.zeros(int(codes.size) + 2), np.zeros(int(codes.size) + 2)
    for n, bucket, counted in found:
        if n:
            sums[: len(bucket)] += weights[bucket] * counted
            counts[: len(bucket)] += counted
        else:
            sums[edges] += weights[bucket]
            counts[edges] += 1
    if not len(edges):
        return np.zeros(0)
    starts = edges[::PASSAGE]
    return np.add.reduceat(sums, starts) / np.add.reduceat(counts, starts)


@dataclass
class Model:
    """``weights``: embedding times softmax of each bucket (logit of class 1 minus class 0)."""

    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        """The probability of label 1 of the text's highest passage; without words, of no evidence."""
        highest = -np.inf
        for codes in _slices(text):
            means = passage_means(codes, self.weights)
            if len(means):
                highest = max(highest, float(means.max()))
        logit = self.bias + (highest if np.isfinite(highest) else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(logit, -60.0, 60.0))))


class _Bags:
    """Passages of the sample as sparse rows over the trained buckets: (passage, bucket, share)."""

    def __init__(self, passage: np.ndarray, bucket: np.ndarray, share: np.ndarray, n: int):
        self.passage, self.bucket, self.share, self.n = passage, bucket, share.astype(np.float32), n
        self.starts = np.searchsorted(passage, np.arange(n + 1))

    def take(self, chosen: np.ndarray) -> _Bags:
        counts = self.starts[chosen + 1] - self.starts[chosen]
        ends = np.cumsum(counts)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[chosen] - (ends - counts), counts)
        return _Bags(np.repeat(np.arange(len(chosen)), counts), self.bucket[at], self.share[at], len(chosen))

    def logits(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.passage, weights=weights[self.bucket] * self.share, minlength=self.n)

    def means(self, embeddings: np.ndarray) -> np.ndarray:
        rows = embeddings[self.bucket] * self.share[:, None]
        return np.stack([np.bincount(self.passage, weights=c, minlength=self.n) for c in rows.T], axis=1)

    def back(self, delta: np.ndarray, n_buckets: int) -> np.ndarray:
        rows = delta[self.passage] * self.share[:, None]
        return np.stack([np.bincount(self.bucket, weights=c, minlength=n_buckets) for c in rows.T], axis=1)


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Train on texts and 0/1 labels. Without both labels every score is the share of label 1."""
    y = np.asarray(labels, np.int64)
    share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
    bias = float(np.log(share / (1 - share)))
    none = Model(np.zeros(BUCKETS, np.float32), bias)
    if not 0 < y.sum() < len(y):
        return none
    trained = _associated(texts, y)
    if not len(trained):
        return none
    index = np.full(BUCKETS, -1)
    index[trained] = np.arange(len(trained))
    bags, of_text = _passages(texts, index)
    rng = np.random.default_rng(seed)
    embeddings = np.zeros((len(trained), DIM))
    softmax = rng.normal(0.0, 1.0, (DIM, 2)) / np.sqrt(DIM)
    offset = np.array([0.0, bias])
    # The first choice of passages goes by how much more often a bucket is in texts of the label.
    direction = _log_odds(bags, of_text, y, len(trained))
    for _ in range(ROUNDS):
        logit = bags.logits(direction)
        order = np.lexsort((rng.random(bags.n), -logit, of_text))
        top = order[np.flatnonzero(np.diff(of_text[order], prepend=-1))]
        clean = np.flatnonzero(y[of_text] == 0)
        others = rng.choice(clean, min(len(clean), len(top)), replace=False) if len(clean) else clean
        chosen = np.concatenate([top, others])
        embeddings, softmax, offset = _train(bags.take(chosen), y[of_text[chosen]], embeddings, softmax, offset)
        direction = embeddings @ (softmax[:, 1] - softmax[:, 0])
    weights = np.zeros(BUCKETS, np.float32)
    weights[trained] = direction
    return Model(weights, float(offset[1] - offset[0]))


def _associated(texts: list[str], y: np.ndarray) -> np.ndarray:
    """Buckets that go with a label (see LEAST_TEXTS and LEAST_Z), from the texts that have them."""
    texts_with = np.zeros((2, BUCKETS))
    for text, label in zip(texts, y.tolist()):
        for codes in _slices(text):
            texts_with[label][np.unique(subwords(codes)[1])] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()], float)
    both = texts_with.sum(axis=0)
    p = np.minimum(both / n.sum(), 1.0)
    error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n).sum())
    z = np.abs(texts_with[1] / n[1] - texts_with[0] / n[0]) / error
    return np.flatnonzero((both >= LEAST_TEXTS) & (z >= LEAST_Z))


def _passages(texts: list[str], index: np.ndarray) -> tuple[_Bags, np.ndarray]:
    """All passages of all texts, and the text of each. A text without words is one empty passage."""
    passages, buckets, shares, of_text, n = [], [], [], [], 0
    for text, content in enumerate(texts):
        for codes in _slices(content):
            word, bucket, n_words = subwords(codes)
            own = -(-n_words // PASSAGE) or 1
            passage, trained = word // PASSAGE, index[bucket]
            hit = np.flatnonzero(trained >= 0)
            hit = hit[np.argsort(passage[hit], kind="stable")]
            passages.append(passage[hit] + n)
            buckets.append(trained[hit])
            shares.append(1.0 / np.bincount(passage, minlength=own)[passage[hit]])
            of_text.append(np.full(own, text))
            n += own
    joined = [np.concatenate(x) for x in (passages, buckets, shares)]
    return _Bags(*joined, n), np.concatenate(of_text)


def _log_odds(bags: _Bags, of_text: np.ndarray, y: np.ndarray, n_buckets: int) -> np.ndarray:
    pairs = np.unique(of_text[bags.passage] * np.int64(n_buckets) + bags.bucket)
    text, bucket = np.divmod(pairs, n_buckets)
    ones = np.bincount(bucket, weights=y[text], minlength=n_buckets) + 0.5
    zeros = np.bincount(bucket, weights=1 - y[text], minlength=n_buckets) + 0.5
    return np.log(ones / (y.sum() + 1)) - np.log(zeros / ((1 - y).sum() + 1))


def _train(bags: _Bags, y: np.ndarray, embeddings, softmax, offset):
    """Gradient steps (Adam) on embeddings, softmax and offset together."""
    params = [embeddings, softmax, offset]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    target = np.stack([1 - y, y], axis=1)
    for step in range(1, STEPS + 1):
        means = bags.means(params[0])
        logits = means @ params[1] + params[2]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        delta = (p - target) / len(y)
        grads = [
            bags.back(delta @ params[1].T, len(params[0])) + DECAY * params[0],
            means.T @ delta,
            delta.sum(axis=0),
        ]
        for i, (g, rate) in enumerate(zip(grads, (20 * RATE, RATE, RATE))):
            first[i] += 0.1 * (g - first[i])
            second[i] += 0.01 * (g * g - second[i])
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-9)
    return params


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: CRC-32 of the id as text is divisible by 5 (a null id as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS
) -> Model:
    """Fit on whole texts of at most ``sample_docs`` labelled documents outside the held-out ones.

    The sample is drawn in the order of a hash of the id, from all labelled documents, until it has
    ``sample_chars`` characters. A document with contradicting labels counts as its highest one, one with
    several texts as that of the lowest hash. Rows without an id or label are left out of the fit.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    texts = docs.select(F.col("doc_id").alias("id"), whole_text().alias("text"), F.xxhash64(whole_text()).alias("tie"))
    # One narrow row for each drawn document that is there; the texts of those that are used follow.
    sizes = texts.join(F.broadcast(drawn), F.col("id") == F.col("doc_id")).groupBy("id", "label").agg(
        F.min(F.struct("tie", F.char_length("text").alias("size"))).alias("of")
    )
    sizes = sizes.select("id", "label", "of.tie", "of.size", F.xxhash64("id").alias("turn")).collect()
    used, total = [], 0
    for row in sorted(sizes, key=lambda r: (r["turn"], r["id"])):
        if total >= sample_chars:
            break
        used.append((row["id"], row["label"], row["tie"]))
        total += row["size"]
    id_type = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(used, f"of_id {id_type}, label int, of_tie long")
    met = (F.col("id") == F.col("of_id")) & (F.col("tie") == F.col("of_tie"))
    sample = texts.join(F.broadcast(chosen), met).groupBy("id", "label").agg(F.min("text").alias("text")).collect()
    sample.sort(key=lambda r: r["id"])
    return fit([r["text"] for r in sample], [r["label"] for r in sample])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) of every row, from the whole text alone; null texts are empty."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    id_type, arrow_id = docs.schema[id_col].dataType.simpleString(), _arrow_type(docs, id_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            scores = [own.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(arrow_id), pa.array(scores, pa.float64())], names=["id", "score"]
            )

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(released(run), f"id {id_type}, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.5 on) of every document.

    The model learns from labels outside the held-out rows only; a score depends on the text alone. An
    empty text has the score of no evidence; without labels of both kinds all scores are equal. Repeated
    rows stay; an empty table gives no rows; other columns are not read.
    """
    scored = score(docs, train(docs, labels))
    return scored.select(
        F.col("id").alias("doc_id"),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted to be toxic, with all their columns."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(low, ROWS_AT_ONCE)
                yield part.filter(pa.array([own.score(t.as_py() or "") < 0.5 for t in part.column(at)], pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
