"""Population-adjusted engagement: counts per (entity, item), rates, and matrix forms.

The matrix is kept long and sparse, ``(entity, item, rate)``; an absent triple is zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import checked_small


# Copies of each lookup row, between which the events of a location are dealt out.
SALTS = 16


def locate_events(events: DataFrame, lookup: DataFrame, unique: bool = False, salts: int = SALTS) -> DataFrame:
    """``events(location, item)`` and ``lookup(location, entity)`` to ``(item, entity)``.

    Events at unknown locations drop out. Unless ``unique`` promises one lookup row per location,
    repeated rows are reduced to one, so they cannot multiply events. Adaptive execution cannot split a hot
    location behind that reduction, so its events are dealt out by item between ``salts`` copies of the row.
    """
    if unique:
        return events.join(lookup, "location").select("item", "entity")
    once = lookup.groupBy("location").agg(F.min("entity").alias("entity"))
    copies = once.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = events.withColumn("_salt", F.pmod(F.xxhash64("item"), F.lit(salts)).cast("int"))
    return dealt.join(copies, ["location", "_salt"]).select("item", "entity")


def located_counts(events: DataFrame, lookup: DataFrame, unique: bool = False, salts: int = SALTS) -> DataFrame:
    """``(entity, item, n)`` straight from ``events(location, item)``: counted per location and item first,
    map-side combined, so that a hot location or item is a partial sum of every task before the join."""
    counted = events.groupBy("location", "item").agg(F.count("*").alias("n"))
    packed = counted.select("location", F.struct("item", "n").alias("item"))
    found = locate_events(packed, lookup, unique, salts)
    return found.groupBy("entity", F.col("item.item").alias("item")).agg(F.sum("item.n").alias("n"))


def location_report(events: DataFrame, lookup: DataFrame) -> DataFrame:
    """One row: located events, dropped events, and lookup keys given more than once."""
    per_key = lookup.groupBy("location").agg(F.count("*").alias("copies"))
    joined = events.select("location").join(per_key, "location", "left")
    repeated = per_key.agg(F.count_if(F.col("copies") > 1)).scalar()
    return joined.agg(
        F.count("copies").alias("located"),
        F.count_if(F.col("copies").isNull()).alias("dropped"),
    ).withColumn("repeated_locations", repeated)


def engagement_counts(events: DataFrame) -> DataFrame:
    """``events(entity, item)`` to ``(entity, item, n)``; Spark combines on the map side."""
    return events.groupBy("entity", "item").agg(F.count("*").alias("n"))


def engagement_rates(events: DataFrame, entities: DataFrame, per: int = 1000) -> DataFrame:
    """Events per ``per`` residents: ``(entity, item, rate)``.

    ``entities(entity, weight)`` joins after the aggregation, since the weight depends on the
    entity alone; events of entities not listed drop out.
    """
    weights = checked_small(entities.select("entity", "weight"))
    rate = F.coalesce(
        F.try_divide((F.col("n") * per).cast("double"), F.col("weight").cast("double")), F.lit(0.0)
    )
    return (
        engagement_counts(events)
        .join(weights, "entity")
        .select("entity", "item", rate.alias("rate"))
    )


def pivot_items(items: DataFrame) -> list:
    """The distinct items in order, as columns of a wide table; more than Spark pivots raise."""
    most = int(items.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = [r["item"] for r in items.select("item").where("item is not null").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} items for a wide table")
    return sorted(found)


def rate_matrix(triples: DataFrame, items: Sequence | None = None) -> DataFrame:
    """Wide form, one row per entity and one column per item, zeros filled in.

    Giving ``items`` saves the job that lists them. Spark refuses more columns than
    ``spark.sql.pivotMaxValues``; the long form has no such limit.
    """
    grouped = triples.groupBy("entity")
    wide = grouped.pivot("item", list(items)) if items is not None else grouped.pivot("item")
    return wide.agg(F.first("rate")).fillna(0.0)


def rate_vectors(triples: DataFrame, items: Sequence) -> DataFrame:
    """Vector form ``(entity, features)`` over a listed, bounded set of items."""
    wide = rate_matrix(triples, items)
    columns = [F.col(f"`{item}`") for item in items]
    return wide.select("entity", array_to_vector(F.array(*columns)).alias("features"))
