"""Pair statistics and distances between entities, from sparse ``(entity, item, rate)`` triples.

The items are the long side: Spark spreads them over all tasks, one row per item holding that
item's cells. A task adds its items up in a small entity x entity accumulator and emits that once,
so no per-item pairs are ever written out and memory does not depend on the number of items.
Beyond ``BLOCK`` entities the accumulator is cut into pairs of entity blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.distances import (
    DISTANCES,
    PAIR_STATS,
    SIDE_STATS,
    block_statistics,
    check_metric,
    distance_column,
)
from ..settings import checked_small

BLOCK = 1024
_CELLS_AT_ONCE = 1 << 20


def _entity_index(entities: DataFrame, block: int) -> tuple[DataFrame, int, int]:
    """``(entity, block, pos)``, the number of blocks, and the longest block."""
    names = entities.select("entity").distinct()
    rows = names.take(block + 1)
    if len(rows) <= block:
        rows = sorted(r[0] for r in rows)
        schema = T.StructType([*names.schema, T.StructField("block", T.IntegerType()), T.StructField("pos", T.IntegerType())])
        table = names.sparkSession.createDataFrame([(e, 0, i) for i, e in enumerate(rows)], schema)
        return F.broadcast(table), 1, max(len(rows), 1)
    blocks = ceil(names.count() / (block // 2))  # hashed blocks stay near half of the room
    hashed = names.withColumn("block", F.pmod(F.xxhash64("entity"), F.lit(blocks)).cast("int"))
    pos = F.row_number().over(Window.partitionBy("block").orderBy("entity")) - 1
    index = hashed.withColumn("pos", pos.cast("int"))
    longest = index.agg(F.max("pos")).first()[0] + 1
    return checked_small(index), blocks, longest


def _accumulate(room: int, wanted: set[str]):
    """Task body: add up the statistics of the items of each block pair (rows sorted by pair)."""
    width = 2 * room
    names = [s for s in PAIR_STATS if s in wanted]
    per_step = max(1, _CELLS_AT_ONCE // width)

    def flush(key, total, sides, items) -> pa.RecordBatch:
        p, q = key
        i, j = (x.ravel() for x in np.indices((room, room)))
        if p == q:
            i, j = i[i < j], j[i < j]
        shift = 0 if p == q else room
        data = {"p": np.full(len(i), p, np.int32), "q": np.full(len(i), q, np.int32)}
        data |= {"i": i.astype(np.int32), "j": j.astype(np.int32), "d": np.full(len(i), items, np.int64)}
        data |= {s: total[s][i, j] for s in names}
        for name, per_entity in zip("cnsq", sides):
            data[name + "a"], data[name + "b"] = per_entity[i], per_entity[j + shift]
        return pa.RecordBatch.from_pydict(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = total = sides = None
        items = 0
        for batch in batches:
            pair = np.stack([batch.column("p").to_numpy(), batch.column("q").to_numpy()], axis=1)
            cuts = np.flatnonzero((pair[1:] != pair[:-1]).any(axis=1)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(pair)]):
                if stop == start:
                    continue
                if key != tuple(pair[start]):
                    if key is not None:
                        yield flush(key, total, sides, items)
                    key, items = tuple(int(x) for x in pair[start]), 0
                    total = {s: np.zeros((room, room)) for s in names}
                    sides = np.zeros((4, width))
                for low in range(start, stop, per_step):
                    some = batch.column("cells").slice(low, min(per_step, stop - low))
                    flat = some.flatten()
                    pos = flat.field("pos").to_numpy(zero_copy_only=False)
                    row = np.repeat(np.arange(len(some)), some.value_lengths().to_numpy())
                    dense = np.zeros((width, len(some)))
                    dense[pos, row] = flat.field("rate").to_numpy(zero_copy_only=False)
                    sides[0] += np.bincount(pos, minlength=width)
                    sides[1] += (dense != 0).sum(axis=1)
                    sides[2] += dense.sum(axis=1)
                    sides[3] += (dense * dense).sum(axis=1)
                    items += len(some)
                    a = dense[:room]
                    b = a if key[0] == key[1] else dense[room:]
                    for s, part in block_statistics(a, b, wanted).items():
                        if s == "max_diff":
                            np.maximum(total[s], part, out=total[s])
                        else:
                            total[s] += part
        if key is not None:
            yield flush(key, total, sides, items)

    return run


def pair_stats(
    triples: DataFrame, entities: DataFrame, stats: set[str] | None = None, block: int = BLOCK
) -> DataFrame:
    """One row per unordered pair ``a < b`` of the entities that occur in ``triples``.

    ``entities(entity)`` lists the possible entities (a small table beside the events), so that
    their number is known without reading the triples twice. ``stats`` limits the work to what a
    distance reads; by default all statistics come out.
    """
    wanted = set(PAIR_STATS if stats is None else stats)
    index, blocks, room = _entity_index(entities, block)
    cells = triples.join(index, "entity")
    own, room_lit = F.col("block"), F.lit(room)
    if blocks == 1:
        placed = cells.select(F.lit(0).alias("p"), F.lit(0).alias("q"), "item", "pos", "rate")
    else:
        other = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        placed = other.select(
            F.least(own, "other").alias("p"),
            F.greatest(own, "other").alias("q"),
            "item",
            F.when(own > F.col("other"), F.col("pos") + room_lit).otherwise(F.col("pos")).alias("pos"),
            "rate",
        )
    rows = placed.groupBy("p", "q", "item").agg(F.collect_list(F.struct("pos", "rate")).alias("cells"))
    if blocks > 1:
        rows = rows.sortWithinPartitions("p", "q")
    sums = [s for s in PAIR_STATS if s in wanted]
    sides = ["ca", "cb", *SIDE_STATS]  # in the order the task emits them
    schema = "p int, q int, i int, j int, d long" + "".join(f", {s} double" for s in sums + sides)
    merged = (
        rows.mapInArrow(_accumulate(room, wanted), schema)
        .groupBy("p", "q", "i", "j")
        .agg(
            F.sum("d").alias("d"),
            *[(F.max if s == "max_diff" else F.sum)(s).alias(s) for s in sums + sides],
        )
        .filter((F.col("ca") > 0) & (F.col("cb") > 0))  # both occur in the triples
    )
    if blocks > 1:  # a block pair saw only its own items
        merged = merged.withColumn("d", cells.agg(F.count_distinct("item")).scalar())
    for side, place, number in (("a", "p", "i"), ("b", "q", "j")):
        named = index.select(
            F.col("entity").alias(side), F.col("block").alias(place), F.col("pos").alias(number)
        )
        merged = merged.join(named, [place, number])
    flip = F.col("a") > F.col("b")
    columns = [F.when(flip, F.col("b")).otherwise(F.col("a")).alias("a")]
    columns += [F.when(flip, F.col("a")).otherwise(F.col("b")).alias("b"), F.col("d"), *map(F.col, sums)]
    for x in "nsq":
        columns += [F.when(flip, F.col(x + "b")).otherwise(F.col(x + "a")).alias(x + "a")]
        columns += [F.when(flip, F.col(x + "a")).otherwise(F.col(x + "b")).alias(x + "b")]
    return merged.select(*columns)


def scale_by_deviation(triples: DataFrame, n_entities: int) -> DataFrame:
    """Divide every rate by its item's sample deviation over all entities, zeros included. Only items
    whose values are all equal drop out. Gaps to the mean are squared, not values, so large values with
    small gaps keep theirs."""
    rate, n = F.col("rate"), F.lit(float(n_entities))
    moments = triples.groupBy("item").agg(
        (F.sum(rate) / n).alias("mean"), F.count("*").alias("here"), F.min(rate).alias("low"), F.max(rate).alias("high")
    )
    varied = (F.col("low") < F.col("high")) | ((F.col("here") < n) & ((F.col("low") != 0) | (F.col("high") != 0)))
    moments = moments.filter(varied).select("item", "mean", "here")
    gap = rate - F.col("mean")
    spread = triples.join(moments, "item").groupBy("item").agg(
        F.sum(gap * gap).alias("gaps"), F.first("mean").alias("mean"), F.first("here").alias("here")
    )
    absent = (n - F.col("here")) * F.col("mean") * F.col("mean")
    spread = spread.select("item", F.sqrt((F.col("gaps") + absent) / (n - 1)).alias("spread"))
    return triples.join(spread.filter("spread > 0"), "item").select(
        "entity", "item", (F.col("rate") / F.col("spread")).alias("rate")
    )


def pair_distances(
    triples: DataFrame, entities: DataFrame, metric: str = "euclidean", block: int = BLOCK
) -> DataFrame:
    """``(a, b, distance)`` for every pair ``a < b`` of the entities that occur."""
    check_metric(metric)
    if metric == "mahalanobis":
        raise ValueError("mahalanobis needs vectors with fewer dimensions than entities")
    if metric == "seuclidean":
        triples = scale_by_deviation(triples, triples.select("entity").distinct().count())
    stats = pair_stats(triples, entities, DISTANCES[metric][0], block)
    return stats.select("a", "b", distance_column(metric).alias("distance"))
