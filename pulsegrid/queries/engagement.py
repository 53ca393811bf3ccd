"""Queries on locating, counting, rating, ranking and encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.base58 import ALPHABET
from ..operators import clusters, ranking, rates
from ..plans.commands import cluster_corpora
from . import binding as b
from .registry import query

ITEMS_SQL = "items AS (SELECT p_partkey AS item, p_name AS title, p_type AS body FROM part)"


@query("rates", f"WITH {b.RATES_SQL} SELECT entity, item, round(rate, 6) AS rate FROM rates")
def _(spark, sf_dir):
    return b.rates(spark, sf_dir).withColumn("rate", F.round("rate", 6))


@query(
    "events_located",
    f"WITH {b.LOCATED_SQL} SELECT item, entity FROM located",
)
def _(spark, sf_dir):
    return b.located(spark, sf_dir)


@query(
    "location_report",
    """SELECT count(o_orderkey) AS located, count(*) - count(o_orderkey) AS dropped,
    (SELECT count(*) FROM (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey
     GROUP BY 1 HAVING count(*) > 1)) AS repeated_locations
    FROM lineitem LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders
      JOIN customer ON o_custkey = c_custkey) ON l_orderkey = o_orderkey""",
)
def _(spark, sf_dir):
    return rates.location_report(b.raw_events(spark, sf_dir), b.lookup(spark, sf_dir))


def _brand_events(spark, sf_dir):
    brand = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), "p_brand")
    counts = rates.engagement_counts(b.located(spark, sf_dir))
    by_brand = counts.join(brand, "item").groupBy("entity", "p_brand").agg(F.sum("n").alias("n"))
    weights = b.checked_small(b.entities(spark, sf_dir))
    return by_brand.join(weights, "entity").select(
        "entity", F.col("p_brand").alias("item"), (F.col("n") * 1000 / F.col("weight")).alias("rate")
    )


# The brands of the given tables; the query itself reads them from part.
BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query(
    "matrix_pivot",
    f"WITH {b.RATES_SQL}, branded AS (SELECT entity, p_brand, "
    "count(*) * 1000.0::DOUBLE / any_value(weight) AS rate FROM located JOIN part ON item = p_partkey "
    "JOIN weights USING (entity) GROUP BY 1, 2) SELECT entity, "
    + ", ".join(
        f"round(coalesce(max(CASE WHEN p_brand = '{x}' THEN rate END), 0), 6) AS \"{x}\"" for x in BRANDS
    )
    + " FROM branded GROUP BY entity",
)
def _(spark, sf_dir):
    part = b.table(spark, sf_dir, "part")
    brands = rates.pivot_items(part.select(F.col("p_brand").alias("item")))
    wide = rates.rate_matrix(_brand_events(spark, sf_dir), brands)
    return wide.select("entity", *[F.round(F.col(f"`{x}`"), 6).alias(x) for x in brands])


@query(
    "entities_grouped",
    """SELECT n_nationkey AS entity, count(*) AS weight, any_value(substring(r_name, 1, 1)) AS party
    FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
    WHERE n_name <> 'NATION_7' GROUP BY 1""",
)
def _(spark, sf_dir):
    from ..operators.attributes import attach_group, exclude_entities

    nation = b.table(spark, sf_dir, "nation").join(
        b.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    named = nation.select(F.col("n_nationkey").alias("entity"), "n_name", F.col("r_name").alias("index"))
    kept = exclude_entities(named, ["NATION_7"], "n_name")
    return attach_group(b.entities(spark, sf_dir), kept.select("entity", "index"))


@query(
    "items_by_title",
    f"WITH {b.LOCATED_SQL}, {ITEMS_SQL} SELECT title, count(*) AS signatures, min(item) AS first_item "
    "FROM located JOIN items USING (item) GROUP BY title",
)
def _(spark, sf_dir):
    return ranking.items_by_title(b.located(spark, sf_dir), b.items(spark, sf_dir))


@query(
    "items_by_id",
    f"WITH {b.LOCATED_SQL}, {ITEMS_SQL} SELECT title, count(*) AS signatures, item AS first_item "
    "FROM located JOIN items USING (item) GROUP BY title, item",
)
def _(spark, sf_dir):
    return ranking.items_by_title(b.located(spark, sf_dir), b.items(spark, sf_dir), by="item")


# The code of nations 4 and 18 (25 ordinals): mask 2^20 + 2^6.
CODE = "6Nj1"
_TOP = f"""WITH {b.LOCATED_SQL}, {ITEMS_SQL} SELECT title, count(*) AS signatures{{body}}
FROM located JOIN items USING (item) WHERE entity IN (4, 18)
GROUP BY title ORDER BY signatures DESC, title LIMIT 10"""


@query("top_items", _TOP.format(body=", arg_min(body, item) AS body"))
def _(spark, sf_dir):
    return ranking.top_items_for_cluster(
        b.located(spark, sf_dir), b.items(spark, sf_dir), CODE, b.ordinals(spark, sf_dir), 10
    )


@query("top_items_no_body", _TOP.format(body=""))
def _(spark, sf_dir):
    return ranking.top_items_for_cluster(
        b.located(spark, sf_dir), b.items(spark, sf_dir), CODE, b.ordinals(spark, sf_dir), 10, body=False
    )


_MASKS_SQL = "masks AS (SELECT n_regionkey AS label, bit_or(1::BIGINT << (24 - n_nationkey)) AS mask FROM nation GROUP BY 1)"
_DIGITS_SQL = " || ".join(
    f"substr('{ALPHABET}', ((mask // {58 ** p}) % 58)::INTEGER + 1, 1)" for p in range(10, -1, -1)
)
CODES_SQL = f"{_MASKS_SQL}, codes AS (SELECT label, mask, ltrim({_DIGITS_SQL}, '1') AS cluster_id FROM masks)"


@query("cluster_ids", f"WITH {CODES_SQL} SELECT label, mask, cluster_id FROM codes")
def _(spark, sf_dir):
    return clusters.cluster_ids(b.region_labels(spark, sf_dir), b.ordinals(spark, sf_dir))


@query(
    "members_of_id",
    f"WITH {CODES_SQL} SELECT cluster_id, mask, n_nationkey AS entity "
    "FROM codes JOIN nation ON label = n_regionkey",
)
def _(spark, sf_dir):
    ids = clusters.cluster_ids(b.region_labels(spark, sf_dir), b.ordinals(spark, sf_dir))
    return clusters.cluster_members(ids.select("cluster_id"), b.ordinals(spark, sf_dir))


@query("distinct_labels", "SELECT DISTINCT n_regionkey AS label FROM nation ORDER BY 1")
def _(spark, sf_dir):
    return clusters.distinct_labels(b.region_labels(spark, sf_dir))


@query(
    "top_items_multi",
    f"""WITH {b.LOCATED_SQL}, {ITEMS_SQL}, {CODES_SQL},
    counted AS (SELECT cluster_id, title, count(*) AS signatures, arg_min(body, item) AS body
      FROM located JOIN nation ON entity = n_nationkey JOIN codes ON label = n_regionkey
      JOIN items USING (item) GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY signatures DESC, title)::INTEGER
      AS rank FROM counted)
    SELECT cluster_id, rank, title, signatures, body FROM ranked WHERE rank <= 10""",
)
def _(spark, sf_dir):
    ids = clusters.cluster_ids(b.region_labels(spark, sf_dir), b.ordinals(spark, sf_dir))
    members = clusters.cluster_members(ids.select("cluster_id"), b.ordinals(spark, sf_dir))
    return ranking.top_items_per_cluster(b.located(spark, sf_dir), b.items(spark, sf_dir), members, 10)


@query(
    "cluster_corpus",
    f"""WITH {b.LOCATED_SQL}, {ITEMS_SQL}, {CODES_SQL},
    counted AS (SELECT cluster_id, title, count(*) AS signatures, arg_min(body, item) AS body
      FROM located JOIN nation ON entity = n_nationkey JOIN codes ON label = n_regionkey
      JOIN items USING (item) GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY signatures DESC, title) AS rank FROM counted)
    SELECT cluster_id, title AS doc, title || ' ' || body AS text FROM ranked WHERE rank <= 50""",
)
def _(spark, sf_dir):
    return region_corpora(spark, sf_dir, 50)[0]


def region_corpora(spark, sf_dir, sample):
    """Corpora of the regions' clusters, and their codes (one per region)."""
    ids = clusters.cluster_ids(b.region_labels(spark, sf_dir), b.ordinals(spark, sf_dir))
    codes = sorted(r["cluster_id"] for r in ids.collect())
    docs = cluster_corpora(
        b.located(spark, sf_dir), b.items(spark, sf_dir), codes, b.ordinals(spark, sf_dir), sample
    )
    return docs, codes


@query("located_counts", f"WITH {b.LOCATED_SQL} SELECT entity, item, count(*) AS n FROM located GROUP BY 1, 2")
def _(spark, sf_dir):
    return rates.located_counts(b.raw_events(spark, sf_dir), b.lookup(spark, sf_dir))
