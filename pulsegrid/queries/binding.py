"""How the driver's tables play the roles: nations are entities, parts are items, line items are
events located through their order's customer, and the weight of a nation is its customer count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rates import engagement_rates, locate_events
from ..settings import checked_small  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("location"), F.col("l_partkey").alias("item")
    )


def lookup(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("o_orderkey").alias("location"), F.col("c_nationkey").alias("entity")
    )


def located(spark, sf_dir) -> DataFrame:
    return locate_events(raw_events(spark, sf_dir), lookup(spark, sf_dir), unique=True)


def entities(spark, sf_dir) -> DataFrame:
    return (
        table(spark, sf_dir, "customer")
        .groupBy(F.col("c_nationkey").alias("entity"))
        .agg(F.count("*").alias("weight"))
    )


def ordinals(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("entity"), F.col("n_nationkey").alias("ord")
    )


def region_labels(spark, sf_dir) -> DataFrame:
    """A given labelling of the nations: their region."""
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("entity"), F.col("n_regionkey").alias("label")
    )


def items(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item"), F.col("p_name").alias("title"), F.col("p_type").alias("body")
    )


def rates(spark, sf_dir) -> DataFrame:
    return engagement_rates(located(spark, sf_dir), entities(spark, sf_dir))


# The same roles in SQL, to be put in front of a query.
LOCATED_SQL = """located AS (
  SELECT l_partkey AS item, c_nationkey AS entity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

RATES_SQL = f"""{LOCATED_SQL},
weights AS (SELECT c_nationkey AS entity, count(*) AS weight FROM customer GROUP BY 1),
rates AS (
  SELECT entity, item, any_value(n) * 1000.0::DOUBLE / any_value(weight) AS rate
  FROM (SELECT entity, item, count(*) AS n FROM located GROUP BY 1, 2) JOIN weights USING (entity)
  GROUP BY 1, 2)"""
