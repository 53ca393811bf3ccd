"""Online LDA by variational Bayes, all models at once and all executors in every update.

The documents are dealt out to a fixed number of updates once. An update is one job over all partitions
that hold its share, whatever its size: a task works through its documents and hands back one array with
the topic x term sums of every model, and a few tasks add those up. So the number of jobs depends neither on
the documents nor on the models; every pass reads every document exactly once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .merging import added, as_batch

# Updates in a pass, passes over the documents.
UPDATES, PASSES = 4, 5
# Documents of an update that one task takes.
_ROWS_PER_TASK = 2048
# Cells (document, term of its own, topic) of a block of documents; they stay in a core's cache.
_CELLS = 1 << 16


class Fitted(NamedTuple):
    """Topic-term weights (topics x width); of each pass the documents read and the log likelihood of a word
    under the weights that its updates began with."""

    weights: np.ndarray
    documents: list[int]
    likelihoods: list[float]


def _expected_log(x: np.ndarray) -> np.ndarray:
    """E[log p] of Dirichlet rows, up to the terms that a row shares: digamma by its asymptotic series."""

    def digamma(v: np.ndarray) -> np.ndarray:
        v, shift = np.array(v, float), 0.0
        for _ in range(6):  # digamma(v) = digamma(v + 1) - 1 / v
            shift = shift - 1.0 / v
            v = v + 1.0
        w = 1.0 / (v * v)
        return shift + np.log(v) - 0.5 / v - w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w / 240)))

    return digamma(x) - digamma(x.sum(axis=-1, keepdims=True))


def _topic_weights(gamma: np.ndarray) -> np.ndarray:
    """exp(E[log p]) of Dirichlet rows, up to a factor of the row: exp(digamma), six steps of its recurrence in pairs."""
    low, high = gamma * (gamma + 5.0), gamma + 6.0
    below = 1.0 / low
    below += 1.0 / (low + 4.0)
    below += 1.0 / (low + 6.0)
    below *= gamma + gamma + 5.0
    w = 1.0 / high
    below += 0.5 * w
    w *= w
    below += w * (1 / 12 - w * (1 / 120 - w * (1 / 252 - w / 240)))
    return high * np.exp(-below)


def expectation(
    lengths: np.ndarray, indices: np.ndarray, values: np.ndarray, word_weights: np.ndarray, alpha: float, most: int = 100
) -> tuple[np.ndarray, float, float]:
    """Expected (topic, term) counts of documents, their log likelihood and words. The entries of all documents
    are in ``indices`` and ``values`` one after the other, ``lengths`` of them each.

    Documents of like length are worked through together, each over its own terms only; each stops moving for itself.
    """
    topics, width = word_weights.shape
    by_term = np.ascontiguousarray(word_weights.T)
    sums, likelihood, words = np.zeros((topics, width)), 0.0, 0.0
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    order, at = order[lengths[order] > 0], 0
    while at < len(order):
        stop = min(len(order), at + max(1, _CELLS // (topics * int(lengths[order[at]]))))
        while stop - at > 1 and (stop - at) * topics * int(lengths[order[stop - 1]]) > 2 * _CELLS:
            stop = at + (stop - at + 1) // 2
        own, at = order[at:stop], stop
        # entries beyond a document's own have count 0
        place = np.arange(int(lengths[own[-1]]))
        there = place < lengths[own, None]
        entry = np.where(there, starts[own, None] + place, 0)
        terms, counts = indices[entry], np.where(there, values[entry], 0.0)
        weights = by_term[terms]
        gamma, moving = np.ones((len(own), topics)), np.arange(len(own))
        now, here, part = gamma, weights, counts
        for _ in range(most):
            theta = _topic_weights(now)
            share = part / (np.matmul(here, theta[:, :, None])[:, :, 0] + 1e-100)
            new = alpha + theta * np.matmul(share[:, None, :], here)[:, 0]
            on = np.abs(new - now).mean(axis=1) >= 1e-3
            gamma[moving] = now = new
            if not on.all():
                moving, now, here, part = moving[on], now[on], here[on], part[on]
                if not len(moving):
                    break
        theta = np.exp(_expected_log(gamma))
        mixed = np.matmul(weights, theta[:, :, None])[:, :, 0] + 1e-100
        share, terms = (counts / mixed)[there], terms[there]
        row = np.nonzero(there)[0]
        for t in range(topics):
            sums[t] += np.bincount(terms, share * theta[row, t], width)
        likelihood += float((counts * np.log(mixed)).sum())
        words += float(counts.sum())
    return word_weights * sums, likelihood, words


def fit_many(
    counts: DataFrame,
    widths: Sequence[int],
    topics: int,
    documents: Sequence[int],
    updates: int = UPDATES,
    passes: int = PASSES,
    seed: int = 0,
    offset: float = 2.0,
    decay: float = 0.7,
    on_update: Callable[[int, int, int], None] | None = None,
) -> list[Fitted]:
    """One model for each value 0, 1, … of ``model`` in ``counts(model, doc, features)``.

    ``widths`` and ``documents`` are the vocabulary size and the number of documents of each model. A pass
    has ``updates`` updates at every size; documents are dealt out by a hash. ``on_update`` is told (pass,
    update, documents) of every update. A model's result does not depend on the models beside it.
    """
    parts = F.unwrap_udt("features")
    models = range(len(widths))
    cores = counts.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(cores, sum(documents)), ceil(sum(documents) / updates / _ROWS_PER_TASK))
    share = F.pmod(F.xxhash64("doc", F.lit(seed)), F.lit(updates)).cast("int")
    place = share * tasks + F.pmod(F.xxhash64("doc", F.lit(seed + 1)), F.lit(tasks))
    every = F.sequence(F.lit(0), F.size(parts["values"]) - 1)  # a dense vector names no indices
    laid = counts.select(
        "model",
        F.coalesce(parts["indices"], every).alias("indices"),
        parts["values"].alias("values"),
        share.alias("share"),
        place.cast("int").alias("place"),
    ).repartitionById(updates * tasks, F.col("place"))
    # The cache keeps the range of ``share`` of each of its pieces, so an update reads its own only.
    laid = laid.select("share", "model", "indices", "values").persist(StorageLevel.MEMORY_AND_DISK)
    context = laid.sparkSession.sparkContext
    alpha = eta = 1.0 / topics
    weights = [np.random.default_rng(seed).gamma(100.0, 0.01, (topics, w)) for w in widths]
    order = np.random.default_rng(seed + 1)
    starts = np.concatenate([[0], np.cumsum([topics * w + 3 for w in widths])])
    steps = [0] * len(widths)
    read = [[0] * passes for _ in models]
    said = [[(0.0, 0.0)] * passes for _ in models]
    try:
        for turn in range(passes):
            for update in order.permutation(updates).tolist():
                sent = context.broadcast([np.exp(_expected_log(w)) for w in weights])

                def work(batches, sent=sent):
                    total = None
                    for batch in batches:
                        of = batch.column("model").to_numpy()
                        lengths = batch.column("values").value_lengths().to_numpy()
                        indices, values = (batch.column(c).flatten().to_numpy() for c in ("indices", "values"))
                        for m in np.unique(of).tolist():
                            own = of == m
                            entries = np.repeat(own, lengths)
                            sums, likelihood, words = expectation(
                                lengths[own], indices[entries], values[entries], sent.value[m], alpha
                            )
                            total = np.zeros(starts[-1]) if total is None else total
                            total[starts[m] : starts[m + 1]] += np.concatenate([sums.ravel(), [own.sum(), likelihood, words]])
                    if total is not None:
                        yield as_batch(total)

                mine = laid.where(F.col("share") == update).select("model", "indices", "values")
                total = added(mine.mapInArrow(work, "m array<double>"))
                sent.unpersist()
                total = np.zeros(starts[-1]) if total is None else total
                for m in models:
                    *sums, seen, likelihood, words = total[starts[m] : starts[m + 1]].tolist()
                    read[m][turn] += int(seen)
                    said[m][turn] = said[m][turn][0] + likelihood, said[m][turn][1] + words
                    if seen:
                        steps[m] += 1
                        rate = (offset + steps[m]) ** -decay
                        found = np.array(sums).reshape(topics, widths[m])
                        weights[m] = (1 - rate) * weights[m] + rate * (eta + documents[m] / seen * found)
                if on_update is not None:
                    on_update(turn, update, int(sum(total[starts[m + 1] - 3] for m in models)))
    finally:
        laid.unpersist()
    return [Fitted(weights[m], read[m], [a / max(b, 1.0) for a, b in said[m]]) for m in models]


def fit(counts: DataFrame, width: int, topics: int, documents: int, **options) -> Fitted:
    """One model of ``counts(doc, features)``; options as of ``fit_many``."""
    return fit_many(counts.withColumn("model", F.lit(0)), [width], topics, [documents], **options)[0]
