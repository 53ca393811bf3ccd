"""Spectral clustering features: leading eigenvectors of the normalised affinity of the entities.

The affinity is exp(-gamma * squared distance). Up to ``BLOCK`` entities it is one small matrix
built from a pair table. For more, it is never stored: every round of the iteration recomputes it
between two blocks of vectors inside a task, tile by tile, and emits one array of weighted sums per entity. Blocks are dealt
by place; those so far apart that all their affinities are 0 never meet. Both routes
give the same features up to the iteration's tolerance.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..settings import cut_plan, release
from . import krylov
from .vectors import BLOCK, as_arrays, as_stream, near_blocks, over_block_pairs, packed_blocks, tiles, vector_pair_distances, vector_shape

_EPSILON = 2.0**-52
_UNDERFLOW = 750.0  # exp(-745.2) is 0; the rest is for rounding
# From so many rows on the iteration comes near in single precision first; to what residual, in how many rounds.
ROUGH_ROWS = 16_384
_ROUGH_TOLERANCE = 1e-6
_ROUGH_ROUNDS = 15
_ROWS_AT_ONCE = 4096


def spectral_features(
    vectors: DataFrame, k: int, gamma: float = 1.0, seed: int = 0, block: int = BLOCK, max_iter: int = 60
) -> DataFrame:
    """``(entity, features)``: k coordinates per entity, to be clustered by k-means. Warns if ``max_iter``
    rounds of the iteration leave a residual above its tolerance."""
    vectors = as_arrays(vectors).select("entity", "features")
    if len(vectors.select("entity").take(block + 1)) <= block:
        return _from_pairs(vectors, k, gamma)
    return _by_iteration(vectors, k, gamma, seed, None if block == BLOCK else block, max_iter)


def _from_pairs(vectors: DataFrame, k: int, gamma: float) -> DataFrame:
    names = sorted(r[0] for r in vectors.select("entity").collect())  # at most one block
    rows = vector_pair_distances(vectors, "sqeuclidean").collect()
    place = {e: i for i, e in enumerate(names)}
    affinity = np.zeros((len(names), len(names)))
    for a, b, distance in rows:
        affinity[place[a], place[b]] = affinity[place[b], place[a]] = np.exp(-gamma * distance)
    root = _degree_root(affinity.sum(axis=1))
    _, axes = np.linalg.eigh(affinity / np.outer(root, root))
    coordinates = axes[:, ::-1][:, :k] / root[:, None]
    schema = T.StructType(
        [vectors.schema["entity"], T.StructField("features", T.ArrayType(T.DoubleType()))]
    )
    data = [(e, row.tolist()) for e, row in zip(names, coordinates)]
    return vectors.sparkSession.createDataFrame(data, schema).coalesce(1)


def _degree_root(degree: np.ndarray) -> np.ndarray:
    return np.sqrt(np.where(degree > 0, degree, 1.0))


def _reach(gamma: float) -> float:
    """The distance beyond which exp(-gamma * squared distance) is 0 as a double."""
    return float(np.sqrt(_UNDERFLOW / gamma)) if gamma > 0 else float("inf")


def affinity_sums(
    vectors: DataFrame,
    gamma: float,
    block: int | None,
    shape: tuple[int, int],
    near: DataFrame | None = None,
    rough: bool = False,
) -> DataFrame:
    """``(entity, y)``: for every entity, the affinity-weighted sum of the array ``y`` over the other entities.
    With ``near`` (see ``near_blocks``) blocks whose affinities are all 0 do not meet. ``rough`` sums have
    single precision and take less than half the time. The sums are written out, the blocks removed."""
    kind = vectors.schema["entity"].dataType.simpleString()
    number = np.float32 if rough else np.float64

    def run(pairs):
        names, totals = {}, {}
        for p, left, q, right in pairs:
            (a, ya), (b, yb) = ((np.stack(x["features"].to_numpy()), np.stack(x["y"].to_numpy())) for x in (left, right))
            if p == q:  # every block meets itself once
                names[p] = pa.Table.from_pandas(left[["entity"]], preserve_index=False)
            onward, back = (totals.setdefault(at, np.zeros(y.shape)) for at, y in ((p, ya), (q, yb)))
            a, b = _exponents(a, b, gamma)
            a, b, ya, yb = (x.astype(number, copy=False) for x in (a, b, ya, yb))
            for i, j in tiles(len(a), len(b), p == q):
                affinity = a[i] @ b[j].T
                (np.minimum if gamma >= 0 else np.maximum)(affinity, 0, out=affinity)
                np.exp(affinity, out=affinity)
                own = p == q and i == j
                if own:
                    np.fill_diagonal(affinity, 0)
                onward[i] += affinity @ yb[j]
                if not own:
                    back[j] += affinity.T @ ya[i]
        for at, total in totals.items():
            yield pd.DataFrame({"_p": [at], "names": [names.get(at) and as_stream(names[at])], "y": [total.tobytes()]})

    def added(batches):
        """The parts of a block come one after the other."""
        last, names, total = None, None, None
        for batch in batches:
            for p, name, y in zip(batch.column("_p").to_pylist(), batch.column("names"), batch.column("y")):
                if p != last and last is not None:
                    yield from listed(names, total)
                y = np.frombuffer(y.as_buffer())
                last, total = p, y if p != last else total + y
                names = pa.ipc.open_stream(name.as_buffer()).read_all() if name.is_valid else names
        if last is not None:
            yield from listed(names, total)

    def listed(names, total):
        ends = pa.array(np.arange(0, total.size + 1, total.size // names.num_rows), pa.int32())
        y = pa.ListArray.from_arrays(ends, pa.array(total))
        entity = names.column("entity").combine_chunks().cast(wanted)
        for at in range(0, len(y), _ROWS_AT_ONCE):
            yield pa.RecordBatch.from_arrays([x.slice(at, _ROWS_AT_ONCE) for x in (entity, y)], ["entity", "y"])

    wanted = to_arrow_type(vectors.schema["entity"].dataType)
    packed = packed_blocks(vectors, block, shape, near)
    partial = over_block_pairs(packed, run, "_p int, names binary, y binary")
    partial = partial.repartition("_p").sortWithinPartitions("_p")
    written = cut_plan(krylov.added_rows(partial.mapInArrow(added, f"entity {kind}, y array<double>")))
    release(packed)
    return written


def _exponents(a: np.ndarray, b: np.ndarray, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose products are -gamma times the squared distances. The offset that the rows share goes first."""
    centre = b.mean(axis=0)
    a, b = a - centre, b - centre
    square, other = ((x * x).sum(axis=1, keepdims=True) for x in (a, b))
    ones = np.ones_like
    return np.hstack([2 * gamma * a, -gamma * square, -gamma * ones(square)]), np.hstack([b, ones(other), other])


def _by_iteration(vectors, k, gamma, seed, block, max_iter) -> DataFrame:
    return eigenfeatures(vectors, k, gamma, seed, block, max_iter)[0]


def eigenfeatures(
    vectors: DataFrame, k: int, gamma: float = 1.0, seed: int = 0, block: int | None = None, max_iter: int = 60
) -> tuple[DataFrame, krylov.Eigen]:
    """The features of the iteration, and what it found: values, residuals, rounds. Many rows start from what
    an iteration in single precision found; values and residuals are those of full precision."""
    shape = vector_shape(vectors)
    placed = near_blocks(vectors, _reach(gamma), block, shape)
    ones = placed.rows.withColumn("y", F.array(F.lit(1.0)))
    degrees = affinity_sums(ones, gamma, block, shape, placed.near).select("entity", F.col("y")[0].alias("degree"))
    root = F.sqrt(F.when(F.col("degree") > 0, F.col("degree")).otherwise(1.0))
    based = cut_plan(placed.rows.join(degrees.select("entity", root.alias("root")), "entity"))
    width = min(k + 6, shape[0])  # the extra columns speed up convergence

    def over_root(table: DataFrame, *kept: str) -> DataFrame:
        return table.select("entity", *kept, F.transform("y", lambda x: x / F.col("root")).alias("y"))

    read: list[DataFrame] = []

    def step(y: DataFrame, rough: bool = False) -> DataFrame:
        while read:
            release(read.pop())  # of a round that is written
        rows = over_root(based.join(y, "entity"), "features", "_ball", "_mine")
        read.append(affinity_sums(rows, gamma, block, shape, placed.near, rough))
        return over_root(read[0].join(based.select("entity", "root"), "entity"))

    start, first = krylov.random_start(vectors.select("entity"), width, seed), 0
    if shape[0] >= ROUGH_ROWS and max_iter > _ROUGH_ROUNDS:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")  # what counts is the residual in the end
            near = krylov.leading_eigenvectors(
                lambda y: step(y, True), start, k, _ROUGH_ROUNDS, _ROUGH_TOLERANCE, kept=width
            )
        start, first = near.vectors, near.rounds
    found = krylov.leading_eigenvectors(step, start, k, max_iter - first)
    found = found._replace(rounds=first + found.rounds)
    joined = found.vectors.join(based.select("entity", "root"), "entity")
    return over_root(joined).withColumnRenamed("y", "features"), found


def power_iteration(vectors: DataFrame, gamma: float = 1.0, max_iter: int = 20) -> DataFrame:
    """``(entity, v)``: the start of the degrees after some steps by the row-normalised affinity, each scaled to
    sum 1. The steps end when the change of the vector no longer changes. The affinity is never stored."""
    vectors = as_arrays(vectors).select("entity", "features").dropDuplicates()
    shape = vector_shape(vectors)
    placed = near_blocks(vectors, _reach(gamma), None, shape)
    ones = placed.rows.withColumn("y", F.array(F.lit(1.0)))
    degrees = affinity_sums(ones, gamma, None, shape, placed.near).select("entity", F.col("y")[0].alias("degree"))
    total, n = degrees.agg(F.sum("degree"), F.count("*")).first()
    if not total:
        raise ValueError("power iteration needs entities with some affinity")
    v = degrees.select("entity", "degree", (F.col("degree") / total).alias("v"))
    tol, before, change = max(1e-5 / n, 1e-8), np.inf, np.inf
    for _ in range(max_iter):
        if change <= tol:
            break
        rows = placed.rows.join(v.select("entity", F.array("v").alias("y")), "entity")
        sums = affinity_sums(rows, gamma, None, shape, placed.near).select("entity", F.col("y")[0].alias("sum"))
        new = F.col("sum") / F.greatest("degree", F.lit(_EPSILON))
        found = cut_plan(v.join(sums, "entity").select("entity", "degree", F.col("v").alias("old"), new.alias("v")))
        norm = found.agg(F.sum(F.abs("v"))).first()[0]
        delta = found.agg(F.sum(F.abs(F.col("v") / norm - F.col("old")))).first()[0]
        v = found.select("entity", "degree", (F.col("v") / norm).alias("v"))
        before, change = delta, abs(delta - before)
    return v.select("entity", "v")
