"""Queries on pair statistics, distances and the evaluation of given labels."""

from __future__ import annotations

from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from ..functions.distances import DISTANCES, PAIR_STATS, SIDE_STATS
from ..operators import evaluation, outliers, pairs
from ..operators.rates import engagement_counts
from ..operators.vectors import (
    as_arrays,
    as_ml_vectors,
    nearest_centroid,
    to_triples,
    vector_pair_distances,
)
from . import binding as b
from .registry import query

# Whole entity x item matrix per pair, then every statistic by its direct definition.
STATS_SQL = f"""{b.RATES_SQL},
present AS (SELECT DISTINCT entity FROM rates), all_items AS (SELECT DISTINCT item FROM rates),
dense AS (SELECT entity, item, coalesce(rate, 0) AS x FROM present CROSS JOIN all_items
  LEFT JOIN rates USING (entity, item)),
both_sides AS (SELECT l.entity AS a, r.entity AS b, item, l.x AS x, r.x AS y
  FROM dense l JOIN dense r USING (item) WHERE l.entity < r.entity),
stats AS (SELECT a, b, count(*) AS d, sum(x * y) AS dot,
  count(*) FILTER (x <> 0 AND y <> 0)::DOUBLE AS shared, sum(abs(x - y)) AS l1,
  sum(CASE WHEN x <> 0 OR y <> 0 THEN abs(x - y) / (abs(x) + abs(y)) ELSE 0 END) AS canberra,
  count(*) FILTER (x <> y)::DOUBLE AS neq, sum(abs(x + y)) AS sum_abs, max(abs(x - y)) AS max_diff,
  count(*) FILTER (x <> 0)::DOUBLE AS na, count(*) FILTER (y <> 0)::DOUBLE AS nb,
  sum(x) AS sa, sum(y) AS sb, sum(x * x) AS qa, sum(y * y) AS qb,
  count(*) FILTER (x <> 0 AND y = 0)::DOUBLE AS tf, count(*) FILTER (x = 0 AND y <> 0)::DOUBLE AS ft,
  count(*) FILTER (x = 0 AND y = 0)::DOUBLE AS ff, sum((x - y) * (x - y)) AS sq,
  avg(x) AS mx, avg(y) AS my, corr(x, y) AS corr
  FROM both_sides GROUP BY a, b)"""

_R = "(tf + ft)"
DISTANCE_SQL = {
    "euclidean": "sqrt(sq)",
    "l2": "sqrt(sq)",
    "minkowski": "sqrt(sq)",
    "sqeuclidean": "sq",
    "cosine": "1 - dot / sqrt(qa * qb)",
    "correlation": "1 - corr",
    "cityblock": "l1",
    "manhattan": "l1",
    "l1": "l1",
    "braycurtis": "l1 / sum_abs",
    "canberra": "canberra",
    "chebyshev": "max_diff",
    "hamming": "neq / d",
    "matching": f"{_R} / d",
    "jaccard": f"{_R} / (shared + {_R})",
    "dice": f"{_R} / (2 * shared + {_R})",
    "kulsinski": f"({_R} - shared + d) / ({_R} + d)",
    "rogerstanimoto": f"2 * {_R} / (shared + ff + 2 * {_R})",
    "sokalmichener": f"2 * {_R} / (shared + ff + 2 * {_R})",
    "russellrao": "(d - shared) / d",
    "sokalsneath": f"2 * {_R} / (shared + 2 * {_R})",
    "yule": "CASE WHEN tf * ft = 0 THEN 0 ELSE 2 * tf * ft / (shared * ff + tf * ft) END",
}
_SEUCLIDEAN_SQL = f"""WITH {b.RATES_SQL},
present AS (SELECT DISTINCT entity FROM rates), all_items AS (SELECT DISTINCT item FROM rates),
dense AS (SELECT entity, item, coalesce(rate, 0) AS x FROM present CROSS JOIN all_items
  LEFT JOIN rates USING (entity, item)),
spread AS (SELECT item, var_samp(x) AS v FROM dense GROUP BY item HAVING var_samp(x) > 1e-9)
SELECT l.entity AS a, r.entity AS b, round(sqrt(sum((l.x - r.x) * (l.x - r.x) / v)), 6) AS distance
FROM dense l JOIN dense r USING (item) JOIN spread USING (item) WHERE l.entity < r.entity GROUP BY 1, 2"""

_STAT_COLUMNS = (*PAIR_STATS, *SIDE_STATS)


@query(
    "pair_stats",
    f"WITH {STATS_SQL} SELECT a, b, d, "
    + ", ".join(f"round({s}, 4) AS {s}" for s in _STAT_COLUMNS)
    + " FROM stats",
)
def _(spark, sf_dir):
    stats = pairs.pair_stats(b.rates(spark, sf_dir), b.ordinals(spark, sf_dir))
    return stats.select("a", "b", "d", *[F.round(s, 4).alias(s) for s in _STAT_COLUMNS])


def _distance_query(metric):
    digits = 4 if metric == "sqeuclidean" else 6  # values near a million
    def run(spark, sf_dir):
        table = pairs.pair_distances(b.rates(spark, sf_dir), b.ordinals(spark, sf_dir), metric)
        return table.withColumn("distance", F.round("distance", digits))

    if metric == "seuclidean":
        sql = _SEUCLIDEAN_SQL
    else:
        sql = f"WITH {STATS_SQL} SELECT a, b, round({DISTANCE_SQL[metric]}, {digits}) AS distance FROM stats"
    query(f"dist_{metric}", sql)(run)


for _metric in DISTANCES:
    if _metric != "mahalanobis":
        _distance_query(_metric)


# Two coordinates per nation: how many events it has, and how many distinct items.
def _nation_activity(spark, sf_dir):
    counts = engagement_counts(b.located(spark, sf_dir))
    return counts.groupBy("entity").agg(F.sum("n").alias("events"), F.count("*").alias("items"))


@query(
    "dist_mahalanobis",
    f"""WITH {b.LOCATED_SQL}, activity AS (SELECT entity, count(*)::DOUBLE AS x,
      count(DISTINCT item)::DOUBLE AS y FROM located GROUP BY 1),
    cov AS (SELECT var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy FROM activity)
    SELECT l.entity AS a, r.entity AS b, round(sqrt(
      (yy * (l.x - r.x) ** 2 - 2 * xy * (l.x - r.x) * (l.y - r.y) + xx * (l.y - r.y) ** 2)
      / (xx * yy - xy * xy)), 6) AS distance
    FROM activity l JOIN activity r ON l.entity < r.entity CROSS JOIN cov""",
)
def _(spark, sf_dir):
    activity = _nation_activity(spark, sf_dir)
    vectors = activity.select("entity", F.array("events", "items").alias("features"))
    table = vector_pair_distances(vectors, "mahalanobis")
    return table.withColumn("distance", F.round("distance", 6))


_SILHOUETTE_TAIL = """both_ways AS (SELECT a AS entity, b AS other, distance FROM pairs
  UNION ALL SELECT b, a, distance FROM pairs),
means AS (SELECT entity, l.label = r.label AS mine, r.label, avg(distance) AS m FROM both_ways
  JOIN labelled l USING (entity) JOIN labelled r ON r.entity = other GROUP BY 1, 2, 3),
sides AS (SELECT entity, max(m) FILTER (mine) AS a, min(m) FILTER (NOT mine) AS b FROM means GROUP BY 1)
SELECT 0 AS k, round(avg(CASE WHEN a IS NULL THEN 0 WHEN greatest(a, b) = 0 THEN 0
  ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM sides"""

_NATION_LABELS_SQL = "labelled AS (SELECT n_nationkey AS entity, n_regionkey AS label FROM nation)"


def _nation_silhouette(metric):
    def run(spark, sf_dir):
        table = pairs.pair_distances(b.rates(spark, sf_dir), b.ordinals(spark, sf_dir), metric)
        score = evaluation.silhouette(table, b.region_labels(spark, sf_dir))
        return score.withColumn("silhouette", F.round("silhouette", 6))

    if metric == "seuclidean":
        pairs_sql = _SEUCLIDEAN_SQL.replace("round(", "(").replace(", 6)", ")").removeprefix("WITH ")
        head, body = pairs_sql.split("\nSELECT l.entity", 1)
        pairs_sql = f"{head}, pairs AS (SELECT l.entity{body})"
    else:
        pairs_sql = f"{STATS_SQL}, pairs AS (SELECT a, b, {DISTANCE_SQL[metric]} AS distance FROM stats)"
    query(f"silhouette_{metric}", f"WITH {pairs_sql}, {_NATION_LABELS_SQL}, {_SILHOUETTE_TAIL}")(run)


for _metric in DISTANCES:
    if _metric not in ("mahalanobis", "l2", "l1", "manhattan", "minkowski"):
        _nation_silhouette(_metric)


def _embeddings(spark, sf_dir):
    table = b.table(spark, sf_dir, "embeddings")
    return as_arrays(table.select(F.col("vec_id").alias("entity"), F.col("embedding").alias("features"), "label"))


_VECTORS_SQL = "vectors AS (SELECT vec_id AS entity, embedding::DOUBLE[] AS v, label FROM embeddings)"
_VECTOR_CELLS_SQL = f"""{_VECTORS_SQL}, labelled AS (SELECT entity, label FROM vectors),
cells AS (SELECT entity, unnest(range(len(v))) AS item, unnest(v) AS x FROM vectors)"""
_CELL_DISTANCE = {
    "euclidean": "sqrt(sum((l.x - r.x) ** 2))",
    "sqeuclidean": "sum((l.x - r.x) ** 2)",
    "cosine": "1 - sum(l.x * r.x) / sqrt(sum(l.x * l.x) * sum(r.x * r.x))",
    "correlation": "1 - corr(l.x, r.x)",
    "cityblock": "sum(abs(l.x - r.x))",
    "chebyshev": "max(abs(l.x - r.x))",
    "canberra": "sum(CASE WHEN l.x = 0 AND r.x = 0 THEN 0 ELSE abs(l.x - r.x) / (abs(l.x) + abs(r.x)) END)",
    "braycurtis": "sum(abs(l.x - r.x)) / sum(abs(l.x + r.x))",
}


def _vector_silhouette(metric):
    def run(spark, sf_dir):
        vectors = _embeddings(spark, sf_dir)
        score = evaluation.silhouette_vectors(vectors.drop("label"), vectors.drop("features"), metric)
        return score.withColumn("silhouette", F.round("silhouette", 6))

    query(
        f"silhouette_vectors_{metric}",
        f"""WITH {_VECTOR_CELLS_SQL}, pairs AS (SELECT l.entity AS a, r.entity AS b,
          {_CELL_DISTANCE[metric]} AS distance FROM cells l JOIN cells r USING (item)
          WHERE l.entity < r.entity GROUP BY 1, 2), {_SILHOUETTE_TAIL}""",
    )(run)


for _metric in _CELL_DISTANCE:
    _vector_silhouette(_metric)

_SQUARES_SQL = """sizes AS (SELECT label, count(*) AS size FROM labelled GROUP BY 1),
centres AS (SELECT label, item, sum(x) / any_value(size) AS m FROM cells JOIN labelled USING (entity)
  JOIN sizes USING (label) GROUP BY 1, 2),
grand AS (SELECT item, sum(x) / (SELECT count(*) FROM labelled) AS g FROM cells GROUP BY 1),
trw AS (SELECT sum((x - m) ** 2) AS w FROM cells JOIN labelled USING (entity) JOIN centres USING (label, item)),
trb AS (SELECT sum(size * (m - g) ** 2) AS b FROM centres JOIN grand USING (item) JOIN sizes USING (label)),
shape AS (SELECT count(*) AS k, sum(size) AS n FROM sizes)"""
_CH_TAIL = "SELECT 0 AS k, round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM trw, trb, shape"
_INERTIA_TAIL = "SELECT 0 AS k, round(w, 3) AS inertia FROM trw"
_NATION_CELLS_SQL = f"""{b.RATES_SQL}, {_NATION_LABELS_SQL},
cells AS (SELECT entity, item, coalesce(rate, 0) AS x FROM (SELECT DISTINCT entity FROM rates)
  CROSS JOIN (SELECT DISTINCT item FROM rates) LEFT JOIN rates USING (entity, item))"""


@query("calinski_harabasz", f"WITH {_NATION_CELLS_SQL}, {_SQUARES_SQL} {_CH_TAIL}")
def _(spark, sf_dir):
    score = evaluation.calinski_harabasz(b.rates(spark, sf_dir), b.region_labels(spark, sf_dir))
    return score.withColumn("calinski_harabasz", F.round("calinski_harabasz", 6))


@query("within_ss", f"WITH {_NATION_CELLS_SQL}, {_SQUARES_SQL} {_INERTIA_TAIL}")
def _(spark, sf_dir):
    score = evaluation.within_sum_of_squares(b.rates(spark, sf_dir), b.region_labels(spark, sf_dir))
    return score.withColumn("inertia", F.round("inertia", 3))


@query("calinski_harabasz_vectors", f"WITH {_VECTOR_CELLS_SQL}, {_SQUARES_SQL} {_CH_TAIL}")
def _(spark, sf_dir):
    vectors = _embeddings(spark, sf_dir)
    score = evaluation.calinski_harabasz(to_triples(vectors.drop("label")), vectors.drop("features"))
    return score.withColumn("calinski_harabasz", F.round("calinski_harabasz", 6))


@query("within_ss_vectors", f"WITH {_VECTOR_CELLS_SQL}, {_SQUARES_SQL} {_INERTIA_TAIL}")
def _(spark, sf_dir):
    vectors = _embeddings(spark, sf_dir)
    score = evaluation.within_sum_of_squares(to_triples(vectors.drop("label")), vectors.drop("features"))
    return score.withColumn("inertia", F.round("inertia", 3))


@query(
    "nearest_centroid",
    f"""WITH {_VECTOR_CELLS_SQL}, centres AS (SELECT label, item, avg(x) AS m FROM cells
      JOIN labelled USING (entity) GROUP BY 1, 2),
    gaps AS (SELECT entity, c.label, sum((x - m) ** 2) AS gap FROM cells JOIN centres c USING (item) GROUP BY 1, 2)
    SELECT entity, arg_min(label, gap) AS label FROM gaps GROUP BY entity""",
)
def _(spark, sf_dir):
    vectors = _embeddings(spark, sf_dir)
    features = as_ml_vectors(vectors).groupBy("label").agg(Summarizer.mean(F.col("features")).alias("features"))
    return nearest_centroid(vectors.drop("label"), features)


# Two coordinates per user of the event log: number of events and their summed value.
_USERS_SQL = """users AS (SELECT user_id AS entity, count(*)::DOUBLE AS x, sum(value) AS y FROM events GROUP BY 1),
moments AS (SELECT avg(x) AS mx, stddev_pop(x) AS dx, avg(y) AS my, stddev_pop(y) AS dy FROM users)"""


def _users(spark, sf_dir):
    return (
        b.table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("entity"))
        .agg(F.count("*").cast("double").alias("x"), F.sum("value").alias("y"))
    )


@query(
    "zscore",
    f"""WITH {_USERS_SQL} SELECT entity, round((x - mx) / dx, 6) AS x_z, round((y - my) / dy, 6) AS y_z
    FROM users, moments""",
)
def _(spark, sf_dir):
    scored = outliers.zscores(_users(spark, sf_dir), ["x", "y"])
    return scored.select("entity", F.round("x_z", 6).alias("x_z"), F.round("y_z", 6).alias("y_z"))


@query(
    "outlier_split",
    f"""WITH {_USERS_SQL} SELECT entity, abs((x - mx) / dx) < 1.0 AND abs((y - my) / dy) < 1.0 AS retained
    FROM users, moments""",
)
def _(spark, sf_dir):
    return outliers.mark_retained(_users(spark, sf_dir), ["x", "y"], 1.0).select("entity", "retained")
