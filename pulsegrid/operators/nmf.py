"""Non-negative matrix factorisation of document vectors, V ~ W H, with an elastic-net penalty.

Documents stay where they are. H (topics x terms, both bounded) goes to every task; a task solves
for its documents' rows of W given H, and sends back only its share of the sums that H's next
value depends on. W is a function of H, so no state of it is kept between the rounds.

Objective: 1/2 |V - WH|^2 + alpha * ratio * (|W|_1 + |H|_1) + alpha * (1 - ratio) / 2 * (|W|^2 + |H|^2)
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ROWS_AT_ONCE = 4096


@dataclass(frozen=True)
class Factors:
    topics: np.ndarray  # topics x terms
    objective: list[float]  # after every round


def descend(start: np.ndarray, square: np.ndarray, cross: np.ndarray, l1: float, l2: float, rounds: int) -> np.ndarray:
    """Non-negative rows x minimising 1/2 x A x' - c x' + l1 |x| + l2/2 |x|^2, one place at a time.

    A row that has come to rest is not worked on while the others move."""
    curve = np.diag(square) + l2
    places = np.flatnonzero(curve > 0).tolist()
    curve = np.where(curve > 0, curve, 1.0)[:, None]
    pull = (np.diag(np.diag(square)) - square) / curve  # of the other places
    x, rest = np.array(start.T, float, order="C"), (cross.T - l1) / curve
    out, on = x, np.arange(x.shape[1])
    for _ in range(rounds):
        before = x.copy()
        for j in places:
            x[j] = np.maximum(pull[j] @ x + rest[j], 0.0)
        moving = np.abs(x - before).max(axis=0, initial=0.0) >= 1e-10
        if 2 * np.count_nonzero(moving) <= len(on):
            out[:, on] = x
            on, x, rest = on[moving], x.compress(moving, axis=1), rest.compress(moving, axis=1)
            if not len(on):
                break
    out[:, on] = x
    return out.T


def _dense_rows(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    for low in range(0, batch.num_rows, _ROWS_AT_ONCE):
        part = batch.slice(low, _ROWS_AT_ONCE)
        lists = part.column("indices")
        dense = np.zeros((part.num_rows, width))
        row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
        dense[row, lists.flatten().to_numpy()] = part.column("values").flatten().to_numpy()
        yield dense


def _round(entries: DataFrame, h: np.ndarray, alpha: float, ratio: float, inner: int):
    """One pass over the documents: W'V, W'W and the scalars of the objective."""
    k, width = h.shape
    l1, l2 = alpha * ratio, alpha * (1 - ratio)
    square = h @ h.T

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k + 1, width + max(k, 3)))  # last row: scalars
        for batch in batches:
            for v in _dense_rows(batch, width):
                w = descend(np.zeros((len(v), k)), square, v @ h.T, l1, l2, inner)
                sums[:k, :width] += w.T @ v
                sums[:k, width : width + k] += w.T @ w
                sums[k, width : width + 3] += np.vdot(v, v), w.sum(), (w * w).sum()
        part = np.arange(k + 1, dtype=np.int32)
        yield pa.RecordBatch.from_pydict({"part": part, "sums": sums.tolist()})

    total = Summarizer.sum(array_to_vector(F.col("sums"))).alias("sums")
    partial = entries.mapInArrow(task, "part int, sums array<double>")
    rows = partial.groupBy("part").agg(total).collect()  # topics + 1 rows
    merged = np.stack([r["sums"].toArray() for r in sorted(rows, key=lambda r: r["part"])])
    cross, gram = merged[:k, :width], merged[:k, width : width + k]
    v2, w1, w2 = merged[k, width : width + 3]
    loss = 0.5 * (v2 - 2 * (cross * h).sum() + (gram * square).sum())
    loss += l1 * (w1 + h.sum()) + 0.5 * l2 * (w2 + (h * h).sum())
    return cross, gram, float(loss)


def _gram(entries: DataFrame, width: int) -> np.ndarray:
    """V'V (terms x terms) in one pass over the documents."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((width, width))
        for batch in batches:
            for v in _dense_rows(batch, width):
                sums += v.T @ v
        yield pa.RecordBatch.from_pydict({"part": np.arange(width, dtype=np.int32), "sums": sums.tolist()})

    total = Summarizer.sum(array_to_vector(F.col("sums"))).alias("sums")
    rows = entries.mapInArrow(task, "part int, sums array<double>").groupBy("part").agg(total).collect()
    out = np.zeros((width, width))
    for r in rows:  # one row for each term
        out[r["part"]] = r["sums"].toArray()
    return out


def singular_start(entries: DataFrame, width: int, topics: int, mean: float) -> np.ndarray:
    """Topics from the leading singular vectors of V: of each, the sign part that carries more of it.

    The share of documents' side in that choice needs V v, of which only norms of the positive and
    negative part matter; they come from one more pass. Zeros are filled with the mean, so that no place
    is stuck at 0."""
    values, axes = np.linalg.eigh(_gram(entries, width))
    order = np.argsort(values)[::-1][:topics]
    lengths, right = np.sqrt(np.maximum(values[order], 0.0)), axes[:, order].T

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, down = np.zeros(len(right)), np.zeros(len(right))
        for batch in batches:
            for v in _dense_rows(batch, width):
                scores = v @ right.T
                up += (np.maximum(scores, 0.0) ** 2).sum(axis=0)
                down += (np.minimum(scores, 0.0) ** 2).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"up": [up.tolist()], "down": [down.tolist()]})

    sums = [Summarizer.sum(array_to_vector(F.col(c))).alias(c) for c in ("up", "down")]
    found = entries.mapInArrow(task, "up array<double>, down array<double>").agg(*sums).first()
    h = np.zeros((topics, width))
    for t in range(len(right)):
        plus, minus = np.maximum(right[t], 0.0), np.maximum(-right[t], 0.0)
        up, down = np.sqrt(found["up"].toArray()[t]), np.sqrt(found["down"].toArray()[t])
        gain_up, gain_down = np.linalg.norm(plus) * up, np.linalg.norm(minus) * down
        part, gain = (plus, gain_up) if gain_up >= gain_down else (minus, gain_down)
        norm = np.linalg.norm(part)
        if norm > 0 and lengths[t] > 0:  # |U part| |V part| sqrt(s): up and down are norms of s * U
            h[t] = np.sqrt(gain) * part / norm
    return np.where(h > 0, h, mean)


def factorise(
    vectors: DataFrame,
    width: int,
    topics: int,
    alpha: float = 0.1,
    ratio: float = 0.5,
    seed: int = 1,
    max_iter: int = 200,
    tol: float = 1e-4,
    inner: int = 100,
    start: str = "singular",
) -> Factors:
    """Factorise sparse ``(…, features)`` vectors of length ``width``.

    ``start`` is "singular" (the leading singular vectors; with fewer terms than topics it is "random")
    or "random". A fit that has not come to rest after ``max_iter`` rounds warns.
    """
    if start not in ("singular", "random"):
        raise ValueError("start must be singular or random")
    parts = F.unwrap_udt("features")
    entries = vectors.select(parts["indices"].alias("indices"), parts["values"].alias("values")).persist()
    total = entries.agg(
        F.sum(F.aggregate("values", F.lit(0.0), lambda s, x: s + x)).alias("mass"), F.count("*").alias("n")
    ).first()
    mean = (total["mass"] or 0.0) / max(1, total["n"] * width)
    if start == "singular" and topics < width:
        h = singular_start(entries, width, topics, mean)
    else:
        h = np.abs(np.random.default_rng(seed).standard_normal((topics, width))) * np.sqrt(mean / topics)
    l1, l2 = alpha * ratio, alpha * (1 - ratio)
    history: list[float] = []
    while True:
        cross, gram, loss = _round(entries, h, alpha, ratio, inner)
        history.append(loss)
        if len(history) > 1 and history[-2] - loss <= tol * history[0]:
            break  # the last value belongs to the topics returned
        if len(history) >= max_iter:
            warnings.warn(f"the factors still moved after {max_iter} rounds", stacklevel=2)
            break
        h = descend(h.T, gram, cross.T, l1, l2, inner).T
    entries.unpersist()
    return Factors(h, history)
