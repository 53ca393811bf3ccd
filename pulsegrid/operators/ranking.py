"""Top-N reports: most engaged items of a cluster, and top rows per group in general."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.base58 import decode_positions
from ..settings import checked_small

# Up to here Spark's own optimizer cuts each map task's share to the top rows before the shuffle.
_PRUNED_BY_SPARK = 1000
_SPREAD = 256


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of every group, with their rank.

    For large ``n`` the groups are first cut within hashed sub-groups; the winners of a group are
    among the winners of its sub-groups, so the result is exact and no task sorts a whole group.
    """
    if n > _PRUNED_BY_SPARK:
        others = [c for c in df.columns if c not in group]
        part = F.pmod(F.xxhash64(*others), F.lit(_SPREAD))
        inner = Window.partitionBy(*group, "_part").orderBy(*order)
        df = (
            df.withColumn("_part", part)
            .withColumn("_place", F.row_number().over(inner))
            .filter(F.col("_place") <= n)
            .drop("_part", "_place")
        )
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def _with_body(ranked: DataFrame, items: DataFrame) -> DataFrame:
    """Fetch the long text for the winners only, by the lowest item of each title."""
    bodies = items.select(F.col("item").alias("first_item"), "body")
    return ranked.join(bodies, "first_item").drop("first_item")


def items_by_title(events: DataFrame, items: DataFrame, by: str = "title") -> DataFrame:
    """Event counts per title (same-titled items merge) or, with ``by='item'``, per item.

    Result: ``(title, signatures, first_item)``. Events shrink to one row per item before they
    meet the item table.
    """
    if by not in ("title", "item"):
        raise ValueError("by must be 'title' or 'item'")
    counts = events.groupBy("item").agg(F.count("*").alias("n"))
    joined = counts.join(items.select("item", "title"), "item")
    keys = ["title"] if by == "title" else ["title", "item"]
    merged = joined.groupBy(*keys).agg(F.sum("n").alias("signatures"), F.min("item").alias("first_item"))
    return merged.select("title", "signatures", "first_item")


def top_items(
    events: DataFrame,
    items: DataFrame,
    members: Sequence | None,
    n: int = 10,
    by: str = "title",
    body: bool = True,
) -> DataFrame:
    """The ``n`` items with most events among ``members`` (all entities if None)."""
    if n < 1:
        raise ValueError("n must be at least 1")
    if members is not None:
        events = events.filter(F.col("entity").isin(list(members)))
    order = [F.desc("signatures"), F.asc("title"), F.asc("first_item")]
    best = items_by_title(events, items, by).orderBy(*order).limit(n)
    if body:
        best = _with_body(best, items).orderBy(F.desc("signatures"), F.asc("title"))
        return best.select("title", "signatures", "body")
    return best.select("title", "signatures")


def members_of(cluster_id: str, ordinals: DataFrame) -> list:
    """Entities named by one literal code, as constants for a filter."""
    rows = sorted(ordinals.select("ord", "entity").take(64))
    names = dict(rows)
    return [names[i] for i in decode_positions(cluster_id, len(rows))]


def top_items_for_cluster(
    events: DataFrame, items: DataFrame, cluster_id: str, ordinals: DataFrame, n: int = 10, **options
) -> DataFrame:
    return top_items(events, items, members_of(cluster_id, ordinals), n, **options)


def top_items_per_cluster(
    events: DataFrame, items: DataFrame, membership: DataFrame, n: int = 10
) -> DataFrame:
    """Several clusters at once: ``membership(cluster_id, entity)`` to
    ``(cluster_id, rank, title, signatures, body)``."""
    members = checked_small(membership.select("cluster_id", "entity"))
    counts = events.groupBy("entity", "item").agg(F.count("*").alias("n"))
    per_item = counts.join(members, "entity").groupBy("cluster_id", "item").agg(F.sum("n").alias("n"))
    per_title = (
        per_item.join(items.select("item", "title"), "item")
        .groupBy("cluster_id", "title")
        .agg(F.sum("n").alias("signatures"), F.min("item").alias("first_item"))
    )
    best = top_per_group(per_title, ["cluster_id"], [F.desc("signatures"), F.asc("title")], n)
    return _with_body(best, items).select("cluster_id", "rank", "title", "signatures", "body")


def top_terms(weights: DataFrame, n: int) -> DataFrame:
    """``weights(topic, term, idx, weight)`` to the heaviest terms; ties go to the later index."""
    return top_per_group(weights, ["topic"], [F.desc("weight"), F.desc("idx")], n)
