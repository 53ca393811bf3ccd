"""Cluster codes: labels to codes, codes to members, and the small tables shown with them.

``ordinals(entity, ord)`` is the one canonical order used in both directions, so a code never
depends on row order.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base58 import (
    MAX_WIDTH,
    PIECE,
    STATE_ORDER,
    check_width,
    code_to_ordinals,
    decode_sql,
    encode_sql,
    pieces_to_code,
)
from ..settings import SMALL_ROWS, checked_small, cut_lineage


def state_ordinals(spark: SparkSession) -> DataFrame:
    """The default ordinal table for the fifty states."""
    return spark.createDataFrame(
        [(name, i) for i, name in enumerate(STATE_ORDER)], "entity string, ord int"
    )


def numbered(entities: DataFrame) -> DataFrame:
    """``(entity, ord)``: the rows in the order of their entities, numbered from 0 on. Each partition of the
    sorted table is numbered on its own; only the number of rows of each is on the driver."""
    row = F.monotonically_increasing_id()  # the partition, and in the lower 33 bits the place in it
    placed = cut_lineage(entities.select("entity").orderBy("entity").select("entity", row.alias("_at")))
    part = F.shiftright("_at", 33).alias("_part")
    sizes = sorted((r["_part"], r["count"]) for r in placed.groupBy(part).count().collect())
    starts, total = [], 0
    for number, size in sizes:
        starts.append((number, total))
        total += size
    starts = F.broadcast(entities.sparkSession.createDataFrame(starts, "_part long, _first long"))
    place = F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("_part", part).join(starts, "_part").select("entity", place.cast("int").alias("ord"))


def _pinned(ordinals: DataFrame) -> tuple[DataFrame, int]:
    """The ordinal table, pinned if it is small, and its width; entities and ordinals have to be there once each."""
    ordinals = ordinals.select("entity", "ord")
    rows = ordinals.take(SMALL_ROWS + 1)
    if len(rows) <= SMALL_ROWS:
        width = len(rows)
        check_width(width)
        whole = sorted(r["ord"] for r in rows) == list(range(width)) and len({r["entity"] for r in rows}) == width
    else:
        width = check_width(ordinals.count())
        low, high, places, names = ordinals.agg(
            F.min("ord"), F.max("ord"), F.count_distinct("ord"), F.count_distinct("entity")
        ).first()
        whole = (low, high, places, names) == (0, width - 1, width, width)
    if not whole:
        raise ValueError("ordinals must number every entity once, from 0 on")
    return checked_small(ordinals), width


def cluster_ids(labels: DataFrame, ordinals: DataFrame) -> DataFrame:
    """``labels(entity, label)`` to ``(label, mask, cluster_id)``; an entity without an ordinal raises. The
    mask is null with more than 63 entities."""
    table, width = _pinned(ordinals)
    complaint = F.concat(F.lit("no ordinal for entity "), F.coalesce(F.col("entity").cast("string"), F.lit("null")))
    known = F.when(F.col("ord").isNull(), F.raise_error(complaint).cast("int")).otherwise(F.col("ord").cast("int"))
    placed = labels.join(table, "entity", "left").select("label", (width - 1 - known).alias("place"))
    if width <= MAX_WIDTH:
        return (
            placed.groupBy("label")
            .agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"))
            .withColumn("cluster_id", F.expr(encode_sql("mask")))
        )
    parts = placed.groupBy("label", F.expr(f"place div {PIECE}").cast("int").alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, place % {PIECE})")).alias("piece")
    )
    # A row for each of a label's pieces, of which there are as many as the width has.
    wide = parts.groupBy("label").agg(F.collect_list("at").alias("at"), F.collect_list("piece").alias("piece"))

    @F.pandas_udf("string")
    def code(at: pd.Series, piece: pd.Series) -> pd.Series:
        return pd.Series([pieces_to_code(a, p) for a, p in zip(at, piece)])

    return wide.select("label", F.lit(None).cast("long").alias("mask"), code("at", "piece").alias("cluster_id"))


def cluster_members(ids: DataFrame, ordinals: DataFrame) -> DataFrame:
    """``ids(cluster_id)`` to ``(cluster_id, mask, entity)`` beside further columns of ``ids``; a bad code
    raises. The mask is null with more than 63 entities."""
    table, width = _pinned(ordinals)
    more = [c for c in ids.columns if c not in ("cluster_id", "mask", "entity")]
    if width > MAX_WIDTH:
        return _wide_members(ids.select("cluster_id", *more), table, width)
    complaint = F.concat(F.lit("not a cluster code here: "), F.col("cluster_id"))
    decoded = F.expr(decode_sql("cluster_id"))
    fits = decoded.isNotNull() & (F.shiftrightunsigned(decoded, width) == 0)
    masks = ids.select("cluster_id", *more, F.when(fits, decoded).otherwise(F.raise_error(complaint)).alias("mask"))
    return (
        masks.withColumn("ord", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
        .filter(F.expr(f"(shiftright(mask, {width - 1} - ord) & 1L) = 1L"))
        .join(table, "ord")
        .select("cluster_id", "mask", "entity", *more)
    )


def _wide_members(ids: DataFrame, table: DataFrame, width: int) -> DataFrame:
    """A code is as long as the entities are many, so it does not go along with every member: its digest does."""

    @F.pandas_udf("array<int>")
    def ordinals_of(codes: pd.Series) -> pd.Series:
        found = [code_to_ordinals(code, width) for code in codes]
        for code, places in zip(codes, found):
            if places is None:
                raise ValueError(f"not a cluster code here: {code}")
        return pd.Series(found)

    digest = F.unhex(F.sha2(F.coalesce("cluster_id", F.lit("")), 256)).alias("_code")
    codes = ids.select(digest, "cluster_id").dropDuplicates(["_code"])
    members = codes.select("_code", F.explode(ordinals_of("cluster_id")).alias("ord")).join(table, "ord")
    named = ids.withColumn("_code", digest).join(members.select("_code", "entity"), "_code")
    more = [c for c in ids.columns if c != "cluster_id"]
    return named.select("cluster_id", F.lit(None).cast("long").alias("mask"), "entity", *more)


def distinct_labels(labels: DataFrame) -> DataFrame:
    return labels.select("label").distinct().orderBy("label")


def label_map(labels: DataFrame) -> DataFrame:
    """One row holding the entity to label map (codes exist for at most 63 entities)."""
    return labels.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("entity", "label")))).alias("labels")
    )
