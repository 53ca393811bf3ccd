"""Score a range of cluster numbers: all models in shared passes, then one scoring for all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distances import DISTANCES, check_metric, distance_column
from ..settings import checked_small
from . import evaluation, pairs
from .clustering import Clustering, FeatureSpace, check_options, cluster_range, draw_seed
from .vectors import to_triples

METRICS = ("silhouette", "calinski_harabasz", "inertia")


def _stacked_labels(models: dict[int, Clustering]) -> DataFrame:
    parts = [m.retained.select(F.lit(k).alias("k"), "entity", "label") for k, m in models.items()]
    return reduce(DataFrame.unionByName, parts)


def _matrix_distances(space: FeatureSpace, metric: str, rows: DataFrame) -> DataFrame:
    """Distances on the full matrix between the rows that were clustered."""
    kept = checked_small(rows.select("entity").distinct())
    triples = space.triples
    if metric == "seuclidean":
        triples = pairs.scale_by_deviation(triples.join(kept, "entity", "left_semi"), kept.count())
    stats = pairs.pair_stats(triples, space.entities, DISTANCES[metric][0])
    table = stats.select("a", "b", distance_column(metric).alias("distance"))
    for side in ("a", "b"):
        table = table.join(kept.select(F.col("entity").alias(side)), side, "left_semi")
    return table


def sweep(
    space: FeatureSpace,
    lowest: int = 2,
    highest: int = 10,
    metric: str = "silhouette",
    distance: str = "euclidean",
    model: str = "kmeans",
    pca: bool = False,
    z_exclude: float = 0.0,
    seed: int | None = None,
    restarts: int = 10,
    gamma: float = 1.0,
) -> DataFrame:
    """``(k, metric, distance, value, seed)`` for every k in the inclusive range."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    if metric == "inertia" and model != "kmeans":
        raise ValueError("inertia goes with k-means only")
    check_metric(distance)
    lowest, highest = sorted((lowest, highest))
    check_options(lowest, model, z_exclude)
    seed = draw_seed(seed)
    ks = range(lowest, highest + 1)
    models = cluster_range(space, ks, model, pca, z_exclude, seed, restarts, gamma)
    data = models[lowest].data
    if metric == "inertia":
        rows = [(k, m.model.cost) for k, m in models.items()]
        scores = data.sparkSession.createDataFrame(rows, "k int, value double")
    elif metric == "calinski_harabasz":
        # distances, and so both sums of squares, are those of the full matrix
        cells = data if space.full is None and not pca else to_triples(data)
        scores = evaluation.calinski_harabasz(cells, _stacked_labels(models))
    elif pca or space.triples is None:
        scores = evaluation.silhouette_vectors(data, _stacked_labels(models), distance)
    else:
        if distance == "mahalanobis":
            raise ValueError("mahalanobis needs fewer dimensions than entities: use pca=True")
        scores = evaluation.silhouette(_matrix_distances(space, distance, data), _stacked_labels(models))
    value = [c for c in scores.columns if c != "k"][0]
    shown = distance if metric == "silhouette" else None
    return scores.select(
        "k",
        F.lit(metric).alias("metric"),
        F.lit(shown).cast("string").alias("distance"),
        F.col(value).alias("value"),
        F.lit(seed).alias("seed"),
    ).orderBy("k")
