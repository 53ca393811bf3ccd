"""Clustering of entities and of items, with outlier handling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from random import SystemRandom

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..settings import cut_lineage
from . import pairs, projection, sparse_kmeans
from .kmeans import KMeansFit, fit_many
from .outliers import mark_retained
from .sparse_kmeans import SparseFit
from .spectral import power_iteration, spectral_features
from .vectors import WIDEST_ROW, as_arrays, as_ml_vectors, dense_rows

MODEL_TYPES = ("kmeans", "spectral")


@dataclass
class FeatureSpace:
    """What is clustered: one row per entity, in full and as a plane, and the source of distances.

    ``full(entity, features)`` keeps the distances of the engagement matrix, ``plane`` is its first
    two principal components. ``triples`` is there when the space came from a sparse matrix.
    """

    full: DataFrame | None
    plane: DataFrame
    triples: DataFrame | None = None
    entities: DataFrame | None = None

    @classmethod
    def from_triples(cls, triples: DataFrame, entities: DataFrame) -> FeatureSpace:
        """From ``(entity, item, rate)``.

        Few entities may have any number of items, and many entities a bounded number of items. When
        both are many there are no full rows; k-means then works on the triples themselves.
        """
        triples = triples.join(entities.select("entity"), "entity", "left_semi")
        if not projection.few_entities(entities):
            if triples.select("item").distinct().limit(WIDEST_ROW + 1).count() <= WIDEST_ROW:
                return cls.from_vectors(dense_rows(triples, "entity", "item"))
            return cls(None, cut_lineage(projection.plane_by_iteration(triples)), triples, entities)
        full = projection.compact_coordinates(triples, entities)
        plane = full.select("entity", F.col("features")[0].alias("pc1"), F.col("features")[1].alias("pc2"))
        return cls(full, plane, triples, entities)

    @classmethod
    def from_vectors(cls, vectors: DataFrame) -> FeatureSpace:
        """From ``(entity, features)`` with vectors of bounded length, any number of entities."""
        vectors = vectors.select("entity", "features").persist(StorageLevel.MEMORY_AND_DISK)
        return cls(vectors, projection.plane_of_vectors(vectors))

    def features(self, pca: bool) -> DataFrame:
        if not pca:
            if self.full is None:
                raise ValueError("many entities with many items: k-means, or the plane (pca=True)")
            return self.full
        return self.plane.select("entity", F.array("pc1", "pc2").alias("features"))


@dataclass
class Clustering:
    labels: DataFrame  # (entity, label), retained and excluded entities alike
    retained: DataFrame  # (entity, label) of the entities the model was fitted on
    data: DataFrame  # (entity, features) the model was fitted on
    seed: int
    model: KMeansFit | SparseFit | None = None


def check_options(k: int, model: str, z_exclude: float) -> None:
    if k < 2:
        raise ValueError("the number of clusters must be at least 2")
    if model not in MODEL_TYPES:
        raise ValueError(f"model must be one of {', '.join(MODEL_TYPES)}")
    if z_exclude > 0 and model != "kmeans":
        raise ValueError("z-score exclusion goes with k-means only")


def draw_seed(seed: int | None) -> int:
    return SystemRandom().randrange(10**6) if seed is None else seed


def split_space(space: FeatureSpace, pca: bool, z_exclude: float) -> tuple[DataFrame, DataFrame | None]:
    """Features to fit on, and those set aside as outliers of the plane (None without a limit)."""
    features = as_arrays(space.features(pca))
    if z_exclude <= 0:
        return features, None
    marks = mark_retained(space.plane, ["pc1", "pc2"], z_exclude).select("entity", "retained")
    marked = features.join(marks, "entity")
    return (
        marked.filter("retained").select("entity", "features"),
        marked.filter(~F.col("retained")).select("entity", "features"),
    )


def cluster_range(
    space: FeatureSpace,
    ks: Sequence[int],
    model: str = "kmeans",
    pca: bool = False,
    z_exclude: float = 0.0,
    seed: int | None = None,
    restarts: int = 10,
    gamma: float = 1.0,
) -> dict[int, Clustering]:
    """One clustering per cluster number. The k-means models of all numbers share their passes.

    Outliers are left out of the fit and then join the nearest centroid.
    """
    for k in ks:
        check_options(k, model, z_exclude)
    seed = draw_seed(seed)
    if not pca and space.full is None and model == "kmeans":
        return _cluster_triples(space, ks, z_exclude, seed, restarts)
    data, excluded = split_space(space, pca, z_exclude)
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    found: dict[int, Clustering] = {}
    if model == "spectral":
        for k in ks:
            rows = spectral_features(data, k, gamma, seed).persist(StorageLevel.MEMORY_AND_DISK)
            labels = fit_many(rows, [k], seed, restarts)[k].labels(rows)
            found[k] = Clustering(labels, labels, data, seed)
        return found
    for k, fitted in fit_many(data, ks, seed, restarts).items():
        retained = fitted.labels(data)
        labels = retained if excluded is None else retained.unionByName(fitted.labels(excluded))
        found[k] = Clustering(labels, retained, data, seed, fitted)
    return found


def _cluster_triples(
    space: FeatureSpace, ks: Sequence[int], z_exclude: float, seed: int, restarts: int
) -> dict[int, Clustering]:
    """Clusterings of a sparse matrix as it is; ``data`` are its triples."""
    data, excluded = space.triples.select("entity", "item", "rate"), None
    if z_exclude > 0:
        marks = mark_retained(space.plane, ["pc1", "pc2"], z_exclude).select("entity", "retained")
        marked = data.join(marks, "entity")
        data, excluded = marked.filter("retained").drop("retained"), marked.filter(~F.col("retained")).drop("retained")
    found = {}
    for k, fitted in sparse_kmeans.fit_many(data, ks, seed, restarts).items():
        labels = fitted.assigned
        if excluded is not None:
            labels = labels.unionByName(fitted.labels(excluded))
        found[k] = Clustering(labels, fitted.assigned, data, seed, fitted)
    return found


def cluster(space: FeatureSpace, k: int, *args, **options) -> Clustering:
    """Cluster the entities into ``k`` groups; the options are those of ``cluster_range``."""
    return cluster_range(space, [k], *args, **options)[k]


def cluster_by_power_iteration(
    vectors: DataFrame, k: int, gamma: float = 1.0, max_iter: int = 20
) -> DataFrame:
    """The cheap spectral variant: k-means of one number per integer entity, found by power iteration of the
    affinity from the degrees, so there is no seed. As Spark's PowerIterationClustering, which keeps every
    pair as an edge; here the pairs are made anew in every step."""
    found = power_iteration(vectors, gamma, max_iter).select(
        F.col("entity").cast("long").alias("entity"), array_to_vector(F.array("v")).alias("features")
    )
    found = found.persist(StorageLevel.MEMORY_AND_DISK)
    model = KMeans(k=k, seed=0, maxIter=100, predictionCol="label").fit(found)
    return model.transform(found).select("entity", "label")


def cluster_items(triples: DataFrame, entities: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """Clusters of the items: ``(item, label)``.

    With up to ``pairs.BLOCK`` entities an item's vector has one place per entity and the clusters are
    hierarchical; with more, items are clustered as sparse rows. There may be any number of items.
    """
    triples = triples.join(entities.select("entity"), "entity", "left_semi")
    if not projection.few_entities(entities):
        rows = triples.select(F.col("item").alias("entity"), F.col("entity").alias("item"), "rate")
        labels = sparse_kmeans.fit_many(rows, [k], seed)[k].assigned
        return labels.select(F.col("entity").alias("item"), "label")
    # read twice: for the entities that occur, and for the rows
    vectors = as_ml_vectors(dense_rows(cut_lineage(triples), "item", "entity"))
    vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    model = BisectingKMeans(k=k, seed=seed, featuresCol="features", predictionCol="label").fit(vectors)
    return model.transform(vectors).select("item", F.col("label").cast("int").alias("label"))
