"""Small attribute tables of entities: exclusion, groups, colours, map and legend rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import checked_small

# The palette of cluster numbers (the last one serves every later cluster), and the
# colours of the groups.
PALETTE = [
    ("Red", "#DC143C"),
    ("Green", "#32CD32"),
    ("Blue", "#00BFFF"),
    ("Yellow", "#F0CE3E"),
    ("Purple", "#9370DB"),
    ("Cyan", "#AFEEEE"),
    ("Orange", "#FFA500"),
    ("Pink", "#FFC0CB"),
    ("Magenta", "#EE82EE"),
    ("Khaki", "#BDB76B"),
    ("Lavender", "#E6E6FA"),
    ("Dark Blue", "#00008B"),
    ("Beige", "#F5DEB3"),
    ("Turqouise", "#40E0D0"),
    ("Maroon", "#800000"),
]
GROUP_COLOURS = {"R": "red", "D": "blue"}
OTHER_COLOUR = "black"


def exclude_entities(df: DataFrame, names: Sequence[str], column: str = "entity") -> DataFrame:
    return df.filter(~F.col(column).isin(list(names))) if names else df


def attach_group(entities: DataFrame, index: DataFrame) -> DataFrame:
    """``entities`` and ``index(entity, index)``: the group is the first letter of the index."""
    groups = index.select("entity", F.substring("index", 1, 1).alias("party"))
    return entities.join(checked_small(groups), "entity")


def palette_name(label: Column) -> Column:
    return _pick([name for name, _ in PALETTE], label)


def palette_hex(label: Column) -> Column:
    return _pick([code for _, code in PALETTE], label)


def _pick(values: list[str], label: Column) -> Column:
    place = F.least(label, F.lit(len(values) - 1)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), place)


def group_colour(party: Column) -> Column:
    """Colour of a group; unknown and missing groups are black."""
    known = F.create_map(*[F.lit(x) for pair in GROUP_COLOURS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.coalesce(party, F.lit(""))), F.lit(OTHER_COLOUR))


def attach_group_colour(entities: DataFrame, groups: DataFrame) -> DataFrame:
    """Left join of ``groups(entity, party)``, then its colour."""
    return entities.join(checked_small(groups.select("entity", "party")), "entity", "left").withColumn(
        "colour", group_colour(F.col("party"))
    )


def map_table(labels: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows to paint: ``regions(entity)`` of a map that carry a label; others are skipped."""
    label = F.col("label")
    return regions.join(labels, "entity").select(
        "entity", "label", palette_name(label).alias("colour_name"), palette_hex(label).alias("colour_hex")
    )


def legend(ids: DataFrame) -> DataFrame:
    """``ids(label, cluster_id)`` to ``(cluster_no, colour_name, cluster_id)``."""
    label = F.col("label")
    return ids.select(
        (label + 1).alias("cluster_no"), palette_name(label).alias("colour_name"), "cluster_id"
    )


def display_text(column: Column, limit: int | None = 50) -> Column:
    """Text as ``show`` prints it: longer than ``limit`` is cut and ends in three dots."""
    if not limit:
        return column
    cut = F.concat(F.substring(column, 1, limit - 3), F.lit("...")) if limit > 3 else F.substring(column, 1, limit)
    return F.when(F.char_length(column) > limit, cut).otherwise(column)
