"""CSV inputs. Everything is read as text with a stated layout; identifiers and postal codes keep
their leading zeros, and the weight is typed once, here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The layouts of the input files.
EVENT_FIELDS = "id string, item string, kind string, initials string, location string, made string"
LOCATION_COLUMNS = ("Postal Code", "State Abbreviation")
WEIGHT_COLUMNS = ("abb", "population")


def _headless(spark: SparkSession, path: str, layout: str) -> DataFrame:
    return spark.read.schema(layout).option("escape", '"').csv(path)


def _with_header(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').csv(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Raw events without a header: ``(location, item)``; the other fields are not parsed."""
    rows = _headless(spark, path, EVENT_FIELDS)
    return rows.select("location", "item")


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """Postal lookup with a header: ``(location, entity)``."""
    place, entity = LOCATION_COLUMNS
    return _with_header(spark, path).select(
        F.col(f"`{place}`").alias("location"), F.col(f"`{entity}`").alias("entity")
    )


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """Population with a header: ``(entity, weight bigint)``; text that is no number gives null."""
    entity, weight = WEIGHT_COLUMNS
    return _with_header(spark, path).select(
        F.col(entity).alias("entity"), F.col(weight).try_cast("bigint").alias("weight")
    )


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """Group index without a header: ``(entity, index)`` from the first and fifth field."""
    rows = _headless(spark, path, "_c0 string, _c1 string, _c2 string, _c3 string, _c4 string")
    return rows.select(F.col("_c0").alias("entity"), F.col("_c4").alias("index"))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items without a header: ``(item, title, body)`` from the second, fourth and fifth field."""
    rows = _headless(spark, path, "_c0 string, _c1 string, _c2 string, _c3 string, _c4 string")
    return rows.select(F.col("_c1").alias("item"), F.col("_c3").alias("title"), F.col("_c4").alias("body"))
