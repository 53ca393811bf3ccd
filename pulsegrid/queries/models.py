"""Queries on projection and clustering; seeded models have no SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clustering, projection
from ..operators.sweep import sweep
from ..operators.topics import topics_per_cluster
from ..operators.vectors import as_arrays, vector_pair_distances
from ..plans.commands import cluster_topics
from . import binding as b
from .binding import RATES_SQL
from .distance import STATS_SQL
from .engagement import region_corpora
from .plane_sql import EMBEDDINGS_PLANE_SQL, RATES_PLANE_SQL
from .registry import query
from .text import STOP_WORDS


def _space(spark, sf_dir):
    return clustering.FeatureSpace.from_triples(b.rates(spark, sf_dir), b.ordinals(spark, sf_dir))


def _embeddings(spark, sf_dir):
    table = b.table(spark, sf_dir, "embeddings")
    return as_arrays(table.select(F.col("vec_id").alias("entity"), F.col("embedding").alias("features")))


def _rounded(plane):
    """Scores of 4 digits, without a negative zero."""
    return plane.withColumns({c: F.round(c, 4) + F.lit(0.0) for c in ("pc1", "pc2")})


_PLANE_COLUMNS = "entity, round(pc1, 4) + 0.0::DOUBLE AS pc1, round(pc2, 4) + 0.0::DOUBLE AS pc2"


@query("pca2", f"WITH {RATES_PLANE_SQL} SELECT {_PLANE_COLUMNS} FROM plane")
def _(spark, sf_dir):
    return _rounded(projection.plane_of_triples(b.rates(spark, sf_dir), b.ordinals(spark, sf_dir)))


@query("pca2_iteration", f"WITH {RATES_PLANE_SQL} SELECT {_PLANE_COLUMNS} FROM plane")
def _(spark, sf_dir):
    """The same plane by the iteration that many entities with many items need."""
    return _rounded(projection.plane_by_iteration(b.rates(spark, sf_dir)))


# Not SQL themselves, the compact coordinates must keep the distances of the whole matrix.
@query(
    "compact_distances",
    f"WITH {STATS_SQL} SELECT a, b, round(sqrt(sq), 4) AS distance FROM stats",
)
def _(spark, sf_dir):
    rows = projection.compact_coordinates(b.rates(spark, sf_dir), b.ordinals(spark, sf_dir))
    return vector_pair_distances(rows).withColumn("distance", F.round("distance", 4))


@query(
    "plane_spread",
    f"""WITH {RATES_SQL}, present AS (SELECT count(DISTINCT entity) AS n FROM rates),
    item_means AS (SELECT item, sum(rate) / any_value(n) AS m FROM rates, present GROUP BY item)
    SELECT round((SELECT sum(rate * rate) FROM rates) - (SELECT n * sum(m * m) FROM item_means, present
      GROUP BY n), 1) AS total""",
)
def _(spark, sf_dir):
    """The components together hold all the spread of the matrix."""
    rows = projection.compact_coordinates(b.rates(spark, sf_dir), b.ordinals(spark, sf_dir))
    square = F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x)
    return rows.agg(F.round(F.sum(square), 1).alias("total"))


@query("pca2_vectors", f"WITH {EMBEDDINGS_PLANE_SQL} SELECT {_PLANE_COLUMNS} FROM plane")
def _(spark, sf_dir):
    return _rounded(projection.plane_of_vectors(_embeddings(spark, sf_dir)))


@query(
    "projection",
    f"""WITH {RATES_PLANE_SQL}
    SELECT {_PLANE_COLUMNS}, CASE substr(r_name, 1, 1) WHEN 'R' THEN 'red' WHEN 'D' THEN 'blue' ELSE 'black' END AS colour,
      abs(pc1 - avg(pc1) OVER ()) < stddev_pop(pc1) OVER () AND abs(pc2 - avg(pc2) OVER ()) < stddev_pop(pc2) OVER () AS retained
    FROM plane LEFT JOIN nation ON entity = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def _(spark, sf_dir):
    nation, region = b.table(spark, sf_dir, "nation"), b.table(spark, sf_dir, "region")
    groups = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("entity"), F.substring("r_name", 1, 1).alias("party")
    )
    plane = projection.plane_of_triples(b.rates(spark, sf_dir), b.ordinals(spark, sf_dir))
    return _rounded(projection.projection_table(plane, groups, 1.0))


@query("kmeans")
def _(spark, sf_dir):
    return clustering.cluster(_space(spark, sf_dir), 5, seed=7).labels


@query("kmeans_pca")
def _(spark, sf_dir):
    return clustering.cluster(_space(spark, sf_dir), 5, pca=True, z_exclude=1.0, seed=7).labels


@query("kmeans_vectors")
def _(spark, sf_dir):
    space = clustering.FeatureSpace.from_vectors(_embeddings(spark, sf_dir))
    return clustering.cluster(space, 10, seed=7).labels


@query("spectral")
def _(spark, sf_dir):
    # unit-length embeddings; the affinity width is the library default
    space = clustering.FeatureSpace.from_vectors(_embeddings(spark, sf_dir))
    return clustering.cluster(space, 10, "spectral", seed=7).labels


@query("power_iteration")
def _(spark, sf_dir):
    return clustering.cluster_by_power_iteration(_embeddings(spark, sf_dir), 10)


@query("item_clusters")
def _(spark, sf_dir):
    return clustering.cluster_items(b.rates(spark, sf_dir), b.ordinals(spark, sf_dir), 8, seed=7)


@query("sweep_silhouette")
def _(spark, sf_dir):
    return sweep(_space(spark, sf_dir), 2, 10, "silhouette", "euclidean", seed=7)


@query("sweep_calinski_harabasz")
def _(spark, sf_dir):
    return sweep(_space(spark, sf_dir), 2, 10, "calinski_harabasz", pca=True, seed=7)


@query("sweep_inertia")
def _(spark, sf_dir):
    return sweep(_space(spark, sf_dir), 2, 10, "inertia", seed=7)


def _documents(spark, sf_dir, lang):
    table = b.table(spark, sf_dir, "documents").filter(F.col("lang") == lang)
    return table.select(F.col("doc_id").alias("doc"), "text")


def _languages(spark, sf_dir):
    rows = b.table(spark, sf_dir, "documents").select("lang").distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("a model for each of more than 1000 languages")
    return {lang: _documents(spark, sf_dir, lang) for lang in sorted(r[0] for r in rows)}


@query("lda_topics")
def _(spark, sf_dir):
    return topics_per_cluster(_languages(spark, sf_dir), method="lda", stop_words=STOP_WORDS)


@query("nmf_topics")
def _(spark, sf_dir):
    return topics_per_cluster(_languages(spark, sf_dir), method="nmf", stop_words=STOP_WORDS)


@query("topics_of_clusters_lda")
def _(spark, sf_dir):
    docs, codes = region_corpora(spark, sf_dir, 500)
    return cluster_topics(docs, codes, method="lda")


@query("topics_of_clusters_nmf")
def _(spark, sf_dir):
    docs, codes = region_corpora(spark, sf_dir, 500)
    return cluster_topics(docs, codes, method="nmf")
