"""Dense vectors of bounded length, ``(entity, features array<double>)``, and block-wise pair work.

When there are many entities with short vectors, all pair distances are still what an exact
silhouette needs. Entities are hashed into blocks, and a block is written as one row; a task reads the
blocks of two groups from there, goes through them tile by tile, and hands back sums per entity, not pairs.
No row is shuffled more than once; what is shuffled are the sums, as many for an entity as there are groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, isqrt
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.distances import block_distances, check_metric
from ..settings import checked_small, cut_lineage, cut_plan
from . import krylov

BLOCK = 1024
_BLOCK_CELLS = 1 << 22
# Rows of a block whose pairs are added up inside the task, and of the tiles it is worked through in; blocks
# are smaller while there are few of them, so that every core has pairs of blocks.
SUMMED_BLOCK = 16_384
TILE = 512
_LEAST_BLOCKS = 12
# Up to so many blocks each is a group of its own; beyond, a group has so many blocks at most.
_SINGLE_BLOCKS = 12
_BLOCKS_AT_ONCE = 4
_MANY_LABELS = 256
# Cells of a part of a column, and rows that a task hands on at once.
_CELLS_AT_ONCE = 500_000
_ROWS_AT_ONCE = 4096
MOST_BALLS = 1024
PIVOT_SAMPLE = 4096
_PIVOT_CELLS = 1 << 22
WIDEST_ROW = 4096


def as_arrays(vectors: DataFrame) -> DataFrame:
    """Features as arrays of doubles, whether they came as ML vectors, floats or doubles."""
    if vectors.schema["features"].dataType.typeName().startswith("array"):
        return vectors.withColumn("features", F.col("features").cast("array<double>"))
    return vectors.withColumn("features", vector_to_array("features"))


def as_ml_vectors(vectors: DataFrame) -> DataFrame:
    if vectors.schema["features"].dataType.typeName().startswith("array"):
        features = array_to_vector(F.col("features").cast("array<double>"))
        return vectors.withColumn("features", features)
    return vectors


def to_triples(vectors: DataFrame) -> DataFrame:
    """``(entity, item, rate)`` with the position in the vector as the item."""
    return as_arrays(vectors).select("entity", F.posexplode("features").alias("item", "rate"))


def dense_rows(triples: DataFrame, row: str, column: str) -> DataFrame:
    """Rows of the matrix as ``(<row>, features)``, one place per value of a bounded column."""
    names = [r[0] for r in triples.select(column).distinct().take(WIDEST_ROW + 1)]
    if len(names) > WIDEST_ROW:
        raise ValueError(f"rows are built over at most {WIDEST_ROW} values of {column}")
    width = len(names)
    schema = T.StructType([triples.schema[column], T.StructField("_at", T.IntegerType())])
    places = triples.sparkSession.createDataFrame([(x, i) for i, x in enumerate(sorted(names))], schema)
    cells = triples.join(F.broadcast(places), column).groupBy(row).agg(
        F.collect_list(F.struct("_at", "rate")).alias("cells")  # at most one cell per place
    )

    @F.pandas_udf("array<double>")
    def fill(at: pd.Series, rate: pd.Series) -> pd.Series:
        out = []
        for where, what in zip(at, rate):
            dense = np.zeros(width)
            dense[where] = what
            out.append(dense)
        return pd.Series(out)

    return cells.select(row, fill("cells._at", "cells.rate").alias("features"))


def _spread(vectors: DataFrame) -> tuple[np.ndarray, int]:
    summary = (
        as_ml_vectors(vectors)
        .select(Summarizer.metrics("std", "count").summary(F.col("features")).alias("s"))
        .select("s.std", "s.count")
        .first()
    )
    return summary["std"].toArray(), summary["count"]


def metric_transform(vectors: DataFrame, metric: str) -> np.ndarray | None:
    """Matrix to multiply vectors with so that the metric becomes plain euclidean, if it needs one."""
    if metric == "seuclidean":
        std, _ = _spread(vectors)
        return np.diag(np.divide(1.0, std, out=np.zeros_like(std), where=std > 0))
    if metric == "mahalanobis":
        std, n = _spread(vectors)
        if n <= len(std) or not (std > 0).all():
            raise ValueError("mahalanobis needs more entities than dimensions, each with some spread")
        corr = Correlation.corr(as_ml_vectors(vectors), "features").first()[0].toArray()
        covariance = corr * np.outer(std, std)
        if np.linalg.cond(corr) > 1e12:
            raise ValueError("mahalanobis: the covariance matrix is singular")
        return np.linalg.cholesky(np.linalg.inv(covariance))
    return None


def vector_shape(vectors: DataFrame) -> tuple[int, int]:
    """Number of rows and longest vector."""
    row = as_arrays(vectors).agg(F.count("*").alias("n"), F.max(F.size("features")).alias("length")).first()
    return row["n"], row["length"] or 0


def block_pairs(
    vectors: DataFrame,
    work: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame],
    schema: str,
    block: int | None = None,
    shape: tuple[int, int] | None = None,
    near: DataFrame | None = None,
) -> DataFrame:
    """Run ``work(left rows, right rows, same block)`` once per unordered pair of blocks.

    Without ``block`` the blocks are those of ``summed_room``: ``work`` must not make all pairs at once.
    ``shape`` (rows, longest vector) saves the job that finds it. With ``near``, the table of
    ``near_blocks`` that goes with these rows, only blocks of balls within reach of each other meet.
    """

    def run(pairs: Iterator[BlockPair]) -> Iterator[pd.DataFrame]:
        for p, left, q, right in pairs:
            yield work(left, right, p == q)

    return over_block_pairs(packed_blocks(vectors, block, shape, near), run, schema)


BlockPair = tuple[int, pd.DataFrame, int, pd.DataFrame]


def packed_blocks(
    vectors: DataFrame, block: int | None = None, shape: tuple[int, int] | None = None, near: DataFrame | None = None
) -> DataFrame:
    """The blocks of ``block_pairs``, written as one row each: ``(_p, _with, _rows)``, with the numbers of the blocks
    from ``_p`` on that it meets. A partition is a group of blocks."""
    vectors = as_arrays(vectors)
    n, length = shape or vector_shape(vectors)
    blocks = max(1, ceil(n / (block or summed_room(n, length))))
    if near is None:
        vectors = vectors.withColumn("_mine", F.pmod(F.xxhash64("entity"), F.lit(blocks)).cast("int"))
        vectors = vectors.withColumn("_ball", F.lit(0))

    def pack(rows: pa.Table) -> pa.Table:
        first = rows.slice(0, 1)
        packed = pa.array([as_stream(rows.drop_columns(["_mine", "_ball"]).combine_chunks())], pa.binary())
        return pa.table({"_p": first["_mine"], "_ball": first["_ball"], "_rows": packed})

    packed = vectors.groupBy("_mine").applyInArrow(pack, "_p int, _ball int, _rows binary")
    if near is None:
        others = F.sequence("_p", F.lit(blocks - 1))
    else:
        packed = packed.join(F.broadcast(near), "_ball")  # at most MOST_BALLS rows
        met = F.flatten(F.transform("_near", lambda ball: F.sequence(ball["first"], ball["last"])))
        others = F.filter(met, lambda other: other >= F.col("_p"))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    groups = max(_SINGLE_BLOCKS, ceil(blocks / _BLOCKS_AT_ONCE), isqrt(8 * cores))
    if near is None:  # else there may be more blocks, smaller ones; empty groups are none
        groups = min(groups, blocks)
    packed = packed.select("_p", others.alias("_with"), "_rows")
    return cut_plan(packed.repartitionByRange(groups, "_p"))


def as_stream(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_table(rows)
    return sink.getvalue().to_pybytes()


def over_block_pairs(
    packed: DataFrame, run: Callable[[Iterator[BlockPair]], Iterator[pd.DataFrame]], schema: str
) -> DataFrame:
    """What ``run`` makes of the pairs of blocks ``(p, left rows, q, right rows)`` of a task, those of two groups.
    Blocks are read where ``packed_blocks`` wrote them; the product of the table with itself has no shuffle."""

    def unpacked(rows: bytes) -> pd.DataFrame:
        return pa.ipc.open_stream(pa.py_buffer(rows)).read_all().to_pandas()

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[BlockPair]:
        last, left = None, None
        for batch in batches:
            for p, q, here, there in zip(batch["_p"], batch["_q"], batch["_left"], batch["_right"]):
                if p != last:
                    last, left = p, unpacked(here)
                yield p, left, q, left if p == q else unpacked(there)

    left = packed.select("_p", "_with", F.col("_rows").alias("_left"))
    right = packed.select(F.col("_p").alias("_q"), F.col("_rows").alias("_right"))
    met = left.hint("shuffle_replicate_nl").join(right, F.expr("array_contains(_with, _q)"))
    return met.select("_p", "_q", "_left", "_right").mapInPandas(lambda batches: run(pairs(batches)), schema)


def tiles(left: int, right: int, same: bool = False) -> Iterator[tuple[slice, slice]]:
    """The tiles of a block of pairs; of a block with itself, those on the diagonal, which have equal sides, and
    those to the right of it."""
    for i in range(0, left, TILE):
        for j in range(i if same else 0, right, TILE):
            yield slice(i, min(i + TILE, left)), slice(j, min(j + TILE, right))


class NearBlocks(NamedTuple):
    """``rows(entity, features, _ball, _mine)``, ``near(_ball, _near)`` for ``block_pairs``, and how many of
    all pairs of blocks are within reach."""

    rows: DataFrame
    near: DataFrame
    pairs_kept: int
    pairs: int


def near_blocks(vectors: DataFrame, reach: float, block: int | None = None, shape: tuple[int, int] | None = None) -> NearBlocks:
    """Deal the rows into blocks by place, and find the blocks that can hold rows less than ``reach`` apart.

    Every row goes to the ball of its nearest pivot; a ball with more rows than a block is several blocks.
    Balls are out of reach when their pivots' distance exceeds both radii and the reach, so no pair
    of rows within reach is lost. The pivots are taken far from one another among at most ``PIVOT_SAMPLE``
    rows (fewer if they are wide), drawn by a hash; they decide what can be skipped, never the result.
    """
    vectors = as_arrays(vectors).select("entity", "features")
    n, length = shape or vector_shape(vectors)
    room = block or summed_room(n, length)
    most = int(np.clip(_PIVOT_CELLS // max(1, length), 64, PIVOT_SAMPLE))
    drawn = vectors.orderBy(F.xxhash64("entity", F.lit(1)), "entity").select("features").take(most)
    pivots = _apart(np.array([r["features"] for r in drawn] or [[0.0]], float), min(MOST_BALLS, 2 * ceil(n / room)))
    squares = (pivots * pivots).sum(axis=1)

    @F.pandas_udf("ball int, gap double")
    def nearest(features: pd.Series) -> pd.DataFrame:
        dense = np.stack(features.to_numpy()).astype(float)
        ball = np.argmin(squares - 2 * dense @ pivots.T, axis=1)
        return pd.DataFrame({"ball": ball.astype("int32"), "gap": np.sqrt(((dense - pivots[ball]) ** 2).sum(axis=1))})

    dealt = cut_lineage(vectors.withColumn("_at", nearest("features")))
    balls = dealt.groupBy("_at.ball").agg(F.count("*").alias("n"), F.max("_at.gap").alias("radius")).collect()
    place = {r["ball"]: i for i, r in enumerate(balls)}
    parts = np.array([ceil(r["n"] / room) for r in balls], int)
    first = np.cumsum(parts) - parts
    radius, centre = np.array([r["radius"] for r in balls]), pivots[np.array([r["ball"] for r in balls], int)]
    near, kept = [], 0
    for ball, i in place.items():
        between = np.sqrt(((centre - centre[i]) ** 2).sum(axis=1))
        met = np.flatnonzero(between * (1 - 1e-9) <= radius + radius[i] + reach)
        near.append((ball, int(parts[i]), int(first[i]), [(int(first[j]), int(first[j] + parts[j] - 1)) for j in met]))
        kept += int(parts[i] * parts[met].sum())
    table = vectors.sparkSession.createDataFrame(
        near, "_ball int, parts int, first int, _near array<struct<first:int,last:int>>"
    )
    mine = F.col("first") + F.pmod(F.xxhash64("entity"), F.col("parts")).cast("int")
    rows = dealt.select("entity", "features", F.col("_at.ball").alias("_ball"))
    rows = rows.join(F.broadcast(table.drop("_near")), "_ball").select("entity", "features", "_ball", mine.alias("_mine"))
    blocks = int(parts.sum())
    return NearBlocks(rows, table.select("_ball", "_near"), (kept + blocks) // 2, blocks * (blocks + 1) // 2)


def _apart(rows: np.ndarray, wanted: int) -> np.ndarray:
    """Up to ``wanted`` different rows, each the farthest from those taken before."""
    taken, gaps = [0], np.full(len(rows), np.inf)
    while True:
        gaps = np.minimum(gaps, ((rows - rows[taken[-1]]) ** 2).sum(axis=1))
        far = int(gaps.argmax())
        if len(taken) >= wanted or gaps[far] <= 0:
            return rows[taken]
        taken.append(far)


def _room(length: int, most: int = BLOCK) -> int:
    """Rows of a block."""
    return int(np.clip(_BLOCK_CELLS // max(1, length), 16, most))


def summed_room(n: int, length: int) -> int:
    """Rows of a block whose pairs are added up where they are made."""
    return min(_room(length, SUMMED_BLOCK), max(_room(length), ceil(n / _LEAST_BLOCKS)))


def _matrix(rows: pd.DataFrame, transform: np.ndarray | None) -> np.ndarray:
    dense = np.stack(rows["features"].to_numpy()).astype(float)
    return dense if transform is None else dense @ transform


def vector_pair_distances(
    vectors: DataFrame,
    metric: str = "euclidean",
    block: int | None = None,
    fold: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> DataFrame:
    """``(a, b, distance)`` for all pairs ``a < b``, for callers that want the whole table.

    Callers that only want sums over the pairs give ``fold``, and the pairs stay in their task: of a tile of pairs it
    gets the arrays ``y`` of the rows on both sides, all distances, and ones where a pair counts, else zeros. Result:
    ``(sums)``, an array a task, to be added up.
    """
    check_metric(metric)
    transform = metric_transform(vectors, metric)
    kind = vectors.schema["entity"].dataType.simpleString()
    if fold is not None:
        return _folded_distances(vectors, metric, transform, block, fold)

    def work(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": [], "distance": []})
        distance = block_distances(metric, _matrix(left, transform), _matrix(right, transform))
        a, b = (x.ravel() for x in np.meshgrid(left["entity"], right["entity"], indexing="ij"))
        keep = a < b if same else np.full(len(a), True)
        low, high = np.where(a < b, a, b), np.where(a < b, b, a)
        return pd.DataFrame({"a": low[keep], "b": high[keep], "distance": distance.ravel()[keep]})

    vectors = vectors.select("entity", "features")
    shape = vector_shape(vectors)  # a task holds all pairs of two blocks
    return block_pairs(vectors, work, f"a {kind}, b {kind}, distance double", block or _room(shape[1]), shape)


def _folded_distances(vectors: DataFrame, metric: str, transform, block: int | None, fold) -> DataFrame:
    def run(pairs: Iterator[BlockPair]) -> Iterator[pd.DataFrame]:
        total = None
        for p, left, q, right in pairs:
            (a, ya, of_a), (b, yb, of_b) = (
                (_matrix(x, transform), np.stack(x["y"].to_numpy()), x["entity"].to_numpy()) for x in (left, right)
            )
            for i, j in tiles(len(a), len(b), p == q):
                distance = block_distances(metric, a[i], b[j])
                keep = np.ones_like(distance)
                if p == q:  # a pair counts once, rows of one entity are none
                    keep *= of_a[i][:, None] != of_b[j][None]
                    keep = np.triu(keep) if i == j else keep
                found = fold(ya[i], yb[j], distance, keep)
                total = found if total is None else total + found
        if total is not None:
            yield pd.DataFrame({"sums": [total]})

    vectors = vectors.filter(F.col("entity").isNotNull()).select("entity", "features", "y")
    return over_block_pairs(packed_blocks(vectors, block), run, "sums array<double>")


def label_distance_sums(
    vectors: DataFrame, labels: DataFrame, metric: str, block: int | None = None
) -> DataFrame:
    """Per entity and label, the summed distance to that label's other members and their number.

    ``labels(entity, label)`` may hold several labellings told apart by a column ``k``. Result:
    ``(k, entity, own, label, total, n)``.
    """
    check_metric(metric)
    k = F.col("k") if "k" in labels.columns else F.lit(0)
    if metric in ("sqeuclidean", "cosine"):
        marks = labels.select("entity", k.cast("int").alias("k"), F.col("label").cast("int").alias("own"))
        return _linear_label_sums(vectors, marks.withColumn("at", F.col("k")), metric)
    pairs = F.sort_array(F.collect_list(F.struct(k.cast("int").alias("k"), F.col("label").cast("int").alias("label"))))
    marks = labels.groupBy("entity").agg(pairs.alias("marks"))
    if metric == "correlation":
        listed = marks.select("entity", F.posexplode("marks").alias("at", "mark"))
        return _linear_label_sums(vectors, listed.select("entity", "at", "mark.k", F.col("mark.label").alias("own")), metric)
    labelled = labels.select(k.alias("k"), "label").distinct().limit(_MANY_LABELS + 1).count()
    if metric in ("cityblock", "manhattan", "l1") and labelled <= _MANY_LABELS:
        return _column_label_sums(vectors, marks)
    transform = metric_transform(vectors, metric)
    marked = vectors.join(marks, "entity").select(
        "entity", "features", F.col("marks.k").alias("ks"), F.col("marks.label").alias("labels")
    )
    kind = vectors.schema["entity"].dataType.simpleString()
    schema = f"k int, entity {kind}, own int, label int, total double, n long"

    def indicators(rows: pd.DataFrame) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """A column of zeros and ones for every label of every labelling, and (place, k, label) of each."""
        marked = np.stack(rows["labels"].to_numpy())
        named = [
            (c, number, label) for c, number in enumerate(rows["ks"].iloc[0]) for label in np.unique(marked[:, c])
        ]
        return np.stack([marked[:, c] == label for c, _, label in named], axis=1).astype(float), named

    def listed(rows: pd.DataFrame, totals: np.ndarray, named, members: np.ndarray, same: bool):
        own, entity = np.stack(rows["labels"].to_numpy()), rows["entity"].to_numpy()
        for at, (c, number, label) in enumerate(named):
            count = np.full(len(rows), int(members[at])) - (same & (own[:, c] == label))
            columns = {"k": number, "entity": entity, "own": own[:, c], "label": label, "total": totals[:, at], "n": count}
            yield pd.DataFrame(columns)

    def work(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["k", "entity", "own", "label", "total", "n"])
        a, (of_a, named_a) = _matrix(left, transform), indicators(left)
        b, (of_b, named_b) = (a, (of_a, named_a)) if same else (_matrix(right, transform), indicators(right))
        onward = np.zeros((len(a), len(named_b)))
        back = onward if same else np.zeros((len(b), len(named_a)))
        for i, j in tiles(len(a), len(b), same):
            distance = block_distances(metric, a[i], b[j])
            if same and i == j:
                np.fill_diagonal(distance, 0.0)
            onward[i] += distance @ of_b[j]
            if not (same and i == j):
                back[j] += distance.T @ of_a[i]
        out = list(listed(left, onward, named_b, of_b.sum(axis=0), same))
        if not same:
            out += listed(right, back, named_a, of_a.sum(axis=0), False)
        return pd.concat(out)

    if block is None and labelled > _MANY_LABELS:
        shape = vector_shape(vectors)  # a task has a sum for each of its rows and labels
        block = _room(shape[1])
    sums = block_pairs(marked, work, schema, block)
    return sums.groupBy("k", "entity", "own", "label").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _column_label_sums(vectors: DataFrame, marks: DataFrame) -> DataFrame:
    """``label_distance_sums`` of absolute differences without pairs: in a column in order, what a label's members
    add to a row's sum follows from the number and the sum of those before and after it. ``marks(entity, marks)``."""
    rows = as_arrays(vectors).join(marks, "entity")
    members = rows.select(F.posexplode("marks").alias("at", "mark")).groupBy("at", "mark").count().collect()
    named = sorted((r["at"], r["mark"]["k"], r["mark"]["label"], r["count"]) for r in members)
    own = F.col("marks.label").alias("labels")
    cells = rows.select("entity", own, F.posexplode("features").alias("item", "x"))
    number, cores = sum(c[3] for c in named if c[0] == 0), vectors.sparkSession.sparkContext.defaultParallelism
    length = vector_shape(vectors)[1]
    parts = max(1, min(cores, number), ceil(number * length / _CELLS_AT_ONCE))
    # the entity divides a value that many rows have
    cells = cells.repartitionByRange(parts, "item", "x", F.xxhash64("entity"))
    cells = cut_plan(cells.sortWithinPartitions("item", "x"))
    least = {r["item"]: r["x"] for r in cells.groupBy("item").agg(F.min("x").alias("x")).collect()}

    def by_item(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
        """The item, the entities, the values from the column's least one on, and a column of zeros and ones a label."""
        held: list[pa.RecordBatch] = []

        def found():
            table = pa.Table.from_batches(held).combine_chunks()
            item, low = table["item"][0].as_py(), 0.0
            if least[item] is not None and np.isfinite(least[item]):
                low = least[item]
            labels = table["labels"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
            ones = np.stack([labels[:, at] == label for at, _, label, _ in named], axis=1).astype(float)
            return item, table["entity"].combine_chunks(), table["x"].to_numpy() - low, ones

        for batch in batches:
            items = batch.column("item").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(items)) + 1), len(items)]
            for start, end in zip(cuts, cuts[1:]):
                if held and end > start and held[0].column("item")[0].as_py() != items[start]:
                    yield found()
                    held.clear()
                if end > start:
                    held.append(batch.slice(start, end - start))
        if held:
            yield found()

    def ends(batches):
        for item, _, x, ones in by_item(batches):
            sums = np.concatenate([ones.sum(axis=0), x @ ones])
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "item": pa.array([item], pa.int32()), "sums": [sums]}
            )

    told: dict[int, list[tuple[int, np.ndarray]]] = {}
    for r in cells.mapInArrow(ends, "part int, item int, sums array<double>").toLocalIterator():
        told.setdefault(r["item"], []).append((r["part"], np.array(r["sums"])))
    beside = {}  # of a part of a column: numbers and sums of the labels' members in the parts before and after
    for item, found in told.items():
        found.sort(key=lambda part: part[0])
        sums = np.stack([part[1] for part in found])
        none = np.zeros((1, sums.shape[1]))
        before = np.concatenate([none, sums.cumsum(axis=0)[:-1]])
        after = np.concatenate([sums[::-1].cumsum(axis=0)[::-1][1:], none])
        beside |= {(part, item): (before[i], after[i]) for i, (part, _) in enumerate(found)}

    def work(batches):
        part, wide = TaskContext.get().partitionId(), len(named)
        for item, entity, x, ones in by_item(batches):
            before, after = beside[part, item]
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            value = x[first][:, None]
            count = np.add.reduceat(ones, first, axis=0)
            total = np.zeros_like(count)
            for way, rest, sign in ((slice(None), before, 1.0), (slice(None, None, -1), after, -1.0)):
                n = np.concatenate([rest[None, :wide], count[way]])[:-1].cumsum(axis=0)
                s = np.concatenate([rest[None, wide:], (count * value)[way]])[:-1].cumsum(axis=0)
                total += sign * (value * n[way] - s[way])
            at = np.repeat(np.arange(len(first)), np.diff([*first, len(x)]))
            # the last number says how many rows an entity has
            sums = np.concatenate([np.maximum(total, 0.0)[at], np.full((len(x), 1), 1.0 if item == 0 else 0.0)], axis=1)
            for low in range(0, len(x), _ROWS_AT_ONCE):
                some = sums[low : low + _ROWS_AT_ONCE]
                y = pa.ListArray.from_arrays(pa.array(np.arange(0, some.size + 1, wide + 1), pa.int32()), pa.array(some.ravel()))
                yield pa.RecordBatch.from_arrays([entity.slice(low, len(some)), y], ["entity", "y"])

    kind = vectors.schema["entity"].dataType.simpleString()
    sums = krylov.added_rows(cells.mapInArrow(work, f"entity {kind}, y array<double>")).join(marks, "entity")
    name = F.array(*[F.struct(F.lit(at).alias("at"), F.lit(c).alias("c"), F.lit(count).alias("count")) for c, (at, _, _, count) in enumerate(named)])
    of = F.array(*[F.struct(F.lit(k).cast("int").alias("k"), F.lit(label).cast("int").alias("label")) for _, k, label, _ in named])
    listed = sums.select("entity", "y", "marks", F.explode(name).alias("name"), of.alias("of"))
    mark, mine = F.get("of", F.col("name.c")), F.get("marks", F.col("name.at"))["label"]
    others = F.col("name.count") - (mine == mark["label"]).cast("long")
    listed = listed.select(
        mark["k"].alias("k"), "entity", mine.alias("own"), mark["label"].alias("label"),
        F.get("y", F.col("name.c")).alias("total"), (others * F.element_at("y", -1).cast("long")).alias("n"),
    )
    return listed.groupBy("k", "entity", "own", "label").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def _linear_label_sums(vectors: DataFrame, marks: DataFrame, metric: str) -> DataFrame:
    """``label_distance_sums`` without pairs: a label's members enter by their number, sum and square sum.
    The correlation is the cosine of rows whose own mean is taken off. ``marks(entity, at, k, own)``: a row's
    labels meet members of the same labelling, ``at``."""
    rows = as_arrays(vectors).select("entity", "features")
    if metric == "correlation":

        @F.pandas_udf("array<double>")
        def centred(features: pd.Series) -> pd.Series:
            return features.map(lambda x: x - x.mean() if len(x) else x)

        rows = rows.select("entity", centred("features").alias("features"))
    square = F.aggregate("x", F.lit(0.0), lambda total, v: total + v * v)
    if metric != "sqeuclidean":
        length = F.sqrt(F.aggregate("features", F.lit(0.0), lambda total, v: total + v * v))
        moved = F.transform("features", lambda v: F.coalesce(F.try_divide(v, length), F.lit(0.0)))
    else:
        # the mean goes first: it adds nothing to a distance and hides small ones
        mean = rows.select(Summarizer.mean(array_to_vector("features")).alias("m")).first()["m"]
        centre = F.lit([float(v) for v in mean] if mean is not None else [0.0])
        moved = F.zip_with("features", centre, lambda v, c: v - c)
    rows = rows.select("entity", moved.alias("x")).withColumn("q", square)
    marked = rows.join(marks, "entity")
    per = marked.groupBy("at", F.col("own").alias("label")).agg(
        F.count("*").alias("n"), F.sum("q").alias("squares"), Summarizer.sum(array_to_vector("x")).alias("s")
    )
    per = checked_small(per.select("at", "label", "n", "squares", vector_to_array("s").alias("s")))
    paired = marked.join(per, "at")
    dot = F.aggregate(F.zip_with("x", "s", lambda v, w: v * w), F.lit(0.0), lambda total, v: total + v)
    mine = F.col("own") == F.col("label")
    if metric != "sqeuclidean":
        # without oneself, whose distance to itself is 0
        total = F.col("n") - dot - F.when(mine, 1 - F.col("q")).otherwise(0.0)
    else:
        total = F.col("n") * F.col("q") - 2 * dot + F.col("squares")
    others = (F.col("n") - mine.cast("long")).alias("n")
    return paired.select("k", "entity", "own", "label", F.greatest(total, F.lit(0.0)).alias("total"), others)


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, max_centroids: int = 4096) -> DataFrame:
    """Label every vector with its closest centroid (lowest label on a tie), without a shuffle."""
    rows = sorted(as_arrays(centroids).select("label", "features").take(max_centroids + 1))
    if not rows or len(rows) > max_centroids:
        raise ValueError(f"expected 1 to {max_centroids} centroids")
    names = np.array([r["label"] for r in rows])
    centre = np.array([r["features"] for r in rows], float)
    squares = (centre * centre).sum(axis=1)

    @F.pandas_udf(centroids.schema["label"].dataType)
    def closest(features: pd.Series) -> pd.Series:
        dense = np.stack(features.to_numpy())
        return pd.Series(names[np.argmin(squares - 2 * dense @ centre.T, axis=1)])

    return as_arrays(vectors).select("entity", closest("features").alias("label"))
