"""k-means for many models at once: all restarts and all cluster numbers share every pass.

A sweep over cluster numbers with restarts is dozens of models. Fitted one by one, each would read
the data on its own, round after round. Here one pass assigns every row to its nearest centroid in
every model that still moves, and one grouped sum brings back each centroid's members; only
centroids (a bounded number of bounded vectors) are on the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import as_arrays, nearest_centroid

_ROUNDS = 5  # of drawing candidates for the first centres
_CELLS_AT_ONCE = 1 << 21


@dataclass(frozen=True)
class KMeansFit:
    centres: np.ndarray
    cost: float  # summed squared distance of the rows to their centres
    converged: bool = True  # False: still moving when the round limit came

    def labels(self, vectors: DataFrame) -> DataFrame:
        """``(entity, label)`` of any rows, by the nearest centre."""
        rows = [(i, c.tolist()) for i, c in enumerate(self.centres)]
        table = vectors.sparkSession.createDataFrame(rows, "label int, features array<double>")
        return nearest_centroid(vectors, table)


def _draw(chosen: np.ndarray, draws: int):
    """Task body: the ``draws`` rows with the smallest -ln(u) / gap, gap being the squared distance to the
    nearest chosen point. Over all tasks that is a draw without replacement in proportion to the gap."""
    squares = (chosen * chosen).sum(axis=1)
    per_step = max(1, _CELLS_AT_ONCE // len(chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, kept = np.zeros(0), np.zeros((0, chosen.shape[1]))
        for batch in batches:
            if not batch.num_rows:
                continue
            dense = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
            waits = -np.log(batch.column("u").to_numpy())
            for low in range(0, len(dense), per_step):
                x, wait = dense[low : low + per_step], waits[low : low + per_step]
                own = (x * x).sum(axis=1)
                gap = (squares - 2 * x @ chosen.T + own[:, None]).min(axis=1)
                away = gap > 1e-12 * (own + squares.max())
                keys = np.concatenate([keys, wait[away] / gap[away]])
                kept = np.concatenate([kept, x[away]])
                if len(keys) > draws:
                    best = np.argpartition(keys, draws)[:draws]
                    keys, kept = keys[best], kept[best]
        yield pa.RecordBatch.from_pydict({"key": keys, "features": pa.array(kept.tolist(), pa.list_(pa.float64()))})

    return run


def _candidates(vectors: DataFrame, draws: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Points to choose first centres from, and the number of rows nearest to each.

    Any row can be drawn: the first by a hash, then in each round ``draws`` rows, far ones rather than
    near ones. The draw depends on the entities alone, not on partitions, and is the same at any size.
    """
    first = vectors.orderBy(F.xxhash64("entity", F.lit(seed)), "entity").select("features").take(1)
    if not first:
        raise ValueError("there is nothing to cluster")
    chosen = np.array([first[0][0]], float)
    for turn in range(_ROUNDS):
        bits = F.shiftrightunsigned(F.xxhash64("entity", F.lit(seed), F.lit(turn)), 11)
        u = (bits.cast("double") + 0.5) / float(1 << 53)
        drawn = vectors.select("features", u.alias("u")).mapInArrow(
            _draw(chosen, draws), "key double, features array<double>"
        )
        rows = drawn.orderBy("key").limit(draws).collect()
        if not rows:  # every row is at a chosen point
            break
        chosen = np.concatenate([chosen, np.array([r["features"] for r in rows])])
    return chosen, _totals(vectors, [chosen])[0]


def _spread_out(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Weighted k-means++: every further centre is drawn in proportion to weight and squared distance."""
    share = weights / weights.sum()
    chosen = [points[rng.choice(len(points), p=share)]]
    gap = weights * ((points - chosen[0]) ** 2).sum(axis=1)
    for _ in range(1, k):
        total = gap.sum()
        place = rng.choice(len(points), p=gap / total if total > 0 else share)
        chosen.append(points[place])
        gap = np.minimum(gap, weights * ((points - points[place]) ** 2).sum(axis=1))
    return np.array(chosen)


def _assign(models: list[np.ndarray]):
    """Task body: per centroid of every model, members, their sum and their squared distances."""
    edges = np.cumsum([0, *map(len, models)])
    centres = np.concatenate(models)
    squares = (centres * centres).sum(axis=1)
    per_step = max(1, _CELLS_AT_ONCE // len(centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, cost = np.zeros(len(centres)), np.zeros(len(centres))
        sums = np.zeros(centres.shape)
        for batch in batches:
            flat = batch.column("features").flatten().to_numpy()
            dense = flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, centres.shape[1])
            for low in range(0, len(dense), per_step):
                x = dense[low : low + per_step]
                gap = squares - 2 * x @ centres.T + (x * x).sum(axis=1)[:, None]
                member = np.zeros(gap.shape)
                rows = np.arange(len(x))
                for start, stop in zip(edges, edges[1:]):
                    member[rows, start + gap[:, start:stop].argmin(axis=1)] = 1.0
                number += member.sum(axis=0)
                cost += (member * np.maximum(gap, 0.0)).sum(axis=0)
                sums += member.T @ x
        yield pa.RecordBatch.from_pydict(
            {"at": np.arange(len(centres), dtype=np.int32), "n": number, "cost": cost, "sums": sums.tolist()}
        )

    return run


def _totals(vectors: DataFrame, models: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members, squared distances and sums of all centroids, one after the other."""
    partial = vectors.select("features").mapInArrow(
        _assign(models), "at int, n double, cost double, sums array<double>"
    )
    rows = (
        partial.groupBy("at")
        .agg(
            F.sum("n").alias("n"),
            F.sum("cost").alias("cost"),
            Summarizer.sum(array_to_vector(F.col("sums"))).alias("sums"),
        )
        .collect()  # one row per centroid
    )
    rows.sort(key=lambda r: r["at"])
    number, cost = np.array([r["n"] for r in rows]), np.array([r["cost"] for r in rows])
    return number, cost, np.array([r["sums"].toArray() for r in rows])


def _one_pass(vectors: DataFrame, models: list[np.ndarray]):
    number, cost, sums = _totals(vectors, models)
    edges = np.cumsum([0, *map(len, models)])
    for old, start, stop in zip(models, edges, edges[1:]):
        n = number[start:stop, None]
        moved = np.divide(sums[start:stop], n, out=old.copy(), where=n > 0)  # an empty cluster stays
        yield moved, float(cost[start:stop].sum())


def fit_many(
    vectors: DataFrame,
    ks: Sequence[int],
    seed: int,
    restarts: int = 10,
    max_iter: int = 300,
    tol: float = 1e-4,
) -> dict[int, KMeansFit]:
    """The best of ``restarts`` models for every k. ``vectors(entity, features)`` should be cached.

    A model that still moves after ``max_iter`` rounds says so (``converged``, and a warning).
    """
    vectors = as_arrays(vectors).select("entity", "features")
    points, weights = _candidates(vectors, 2 * max(ks), seed)
    moving = [
        (k, _spread_out(points, weights, k, np.random.default_rng([seed, k, attempt])))
        for k in ks
        for attempt in range(restarts)
    ]
    best: dict[int, KMeansFit] = {}
    for step in range(max_iter):
        still = []
        results = list(_one_pass(vectors, [centres for _, centres in moving]))
        for (k, centres), (moved, cost) in zip(moving, results):
            moves = np.sqrt(((moved - centres) ** 2).sum(axis=1)).max() > tol
            if step + 1 < max_iter and moves:
                still.append((k, moved))
            elif k not in best or cost < best[k].cost:
                best[k] = KMeansFit(centres, cost, not moves)
        moving = still
        if not moving:
            break
    for k, model in best.items():
        if not model.converged:
            warnings.warn(f"k-means with {k} clusters still moved after {max_iter} rounds", stacklevel=2)
    return best
