"""Principal components of the engagement matrix, and the projection table drawn from them."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..settings import checked_small, cut_lineage
from . import krylov, pairs
from .attributes import attach_group_colour, OTHER_COLOUR
from .outliers import mark_retained
from .vectors import as_arrays, as_ml_vectors, to_triples

WIDEST_COVARIANCE = 4096  # beyond this the d x d covariance does not belong on one machine


def _upright(scores: np.ndarray) -> np.ndarray:
    """Turn every component so that its score of largest size is positive."""
    if not len(scores):
        return scores
    lead = scores[np.abs(scores).argmax(axis=0), np.arange(scores.shape[1])]
    return scores * np.where(lead < 0, -1.0, 1.0)


def few_entities(entities: DataFrame, block: int = pairs.BLOCK) -> bool:
    return len(entities.select("entity").distinct().take(block + 1)) <= block


def compact_coordinates(triples: DataFrame, entities: DataFrame, block: int = pairs.BLOCK) -> DataFrame:
    """``(entity, features)``: principal-component scores of all components, largest first.

    The cells of all items are added up into the entities' scalar products by Spark; the entities,
    at most ``block``, then fit in one small matrix. Distances between the rows equal those of the
    full matrix, so clustering the scores is clustering the matrix.
    """
    if not few_entities(entities, block):
        raise ValueError(f"compact coordinates are for at most {block} entities")
    rows = pairs.pair_stats(triples, entities, {"dot"}, block).select("a", "b", "dot", "qa", "qb").collect()
    names = sorted({r["a"] for r in rows} | {r["b"] for r in rows})
    schema = T.StructType(
        [
            T.StructField("entity", triples.schema["entity"].dataType),
            T.StructField("features", T.ArrayType(T.DoubleType())),
        ]
    )
    spark = triples.sparkSession
    if not names:  # one entity has no pairs: it sits in the middle
        return triples.select("entity").distinct().select("entity", F.array(F.lit(0.0), F.lit(0.0)).alias("features"))
    place = {e: i for i, e in enumerate(names)}
    products = np.zeros((len(names), len(names)))
    for r in rows:
        i, j = place[r["a"]], place[r["b"]]
        products[i, j] = products[j, i] = r["dot"]
        products[i, i], products[j, j] = r["qa"], r["qb"]
    centre = products - products.mean(axis=0) - products.mean(axis=1)[:, None] + products.mean()
    values, axes = np.linalg.eigh((centre + centre.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    keep = max(2, int((values > 1e-12 * max(values[0], 1e-300)).sum()))
    scores = _upright(axes[:, :keep] * np.sqrt(np.maximum(values[:keep], 0.0)))
    # one partition: the table is small, and iterations over it cost one task each
    return spark.createDataFrame([(e, s.tolist()) for e, s in zip(names, scores)], schema).coalesce(1)


def _named_plane(vectors: DataFrame) -> DataFrame:
    return as_arrays(vectors).select(
        "entity", F.col("features")[0].alias("pc1"), F.col("features")[1].alias("pc2")
    )


def _sign_fixed(plane: DataFrame) -> DataFrame:
    lead = plane.agg(
        F.struct(*[F.max_by(c, F.abs(c)).alias(c) for c in ("pc1", "pc2")]).alias("lead")
    ).scalar()
    return plane.select(
        "entity", *[(F.col(c) * F.when(lead[c] < 0, -1.0).otherwise(1.0)).alias(c) for c in ("pc1", "pc2")]
    )


def plane_of_vectors(vectors: DataFrame) -> DataFrame:
    """``(entity, pc1, pc2)`` of vectors of bounded length."""
    length = as_arrays(vectors).agg(F.max(F.size("features"))).first()[0] or 0
    if length > WIDEST_COVARIANCE:
        return plane_by_iteration(to_triples(vectors))
    if length < 2:
        padded = F.concat("features", F.array(F.lit(0.0)))
        vectors = as_arrays(vectors).withColumn("features", padded)
    scaled = StandardScaler(inputCol="features", outputCol="centred", withMean=True, withStd=False)
    centred = scaled.fit(as_ml_vectors(vectors)).transform(as_ml_vectors(vectors))
    model = PCA(k=2, inputCol="centred", outputCol="scores").fit(centred)
    scores = model.transform(centred).select("entity", F.col("scores").alias("features"))
    return _sign_fixed(_named_plane(scores))


def plane_by_iteration(triples: DataFrame, max_iter: int = 60, seed: int = 0) -> DataFrame:
    """``(entity, pc1, pc2)`` when entities and items are both many: joins and sums only. Warns if
    ``max_iter`` rounds leave a residual above the tolerance."""
    # every step reads it twice; an item's cells lie together, so that its sums need no shuffle
    triples = cut_lineage(triples.select("entity", "item", "rate").repartition("item").sortWithinPartitions("item"))
    entities = triples.select("entity").distinct()
    width = max(1, min(8, len(entities.take(8))))  # two components and six more for speed of convergence

    def weighted(table: DataFrame, key: str) -> DataFrame:
        # a block has fewer columns than the first one where directions vanish
        sums = [F.sum(F.coalesce(F.get("y", F.lit(i)), F.lit(0.0)) * F.col("rate")).alias(f"y{i}") for i in range(width)]
        summed = table.groupBy(key).agg(*sums, F.max(F.size("y")).alias("width"))
        return summed.select(key, F.slice(F.array(*(f"y{i}" for i in range(width))), 1, F.col("width")).alias("y"))

    def covariance_step(y: DataFrame) -> DataFrame:
        per_item = weighted(triples.join(checked_small(y), "entity"), "item")
        return krylov.centred(weighted(triples.join(per_item, "item"), "entity"))

    start = krylov.centred(krylov.random_start(entities, width, seed))
    found = krylov.leading_eigenvectors(covariance_step, start, min(2, width), max_iter)
    length = np.sqrt(np.maximum(found.values, 0.0)).tolist() + [0.0, 0.0]
    named = [
        (F.coalesce(F.get("y", F.lit(i)), F.lit(0.0)) * length[i]).alias(name) for i, name in enumerate(("pc1", "pc2"))
    ]
    return _sign_fixed(found.vectors.select("entity", *named))


def plane_of_triples(triples: DataFrame, entities: DataFrame, block: int = pairs.BLOCK) -> DataFrame:
    """``(entity, pc1, pc2)`` of the sparse matrix."""
    if few_entities(entities, block):
        return _named_plane(compact_coordinates(triples, entities, block))
    return plane_by_iteration(triples)


def projection_table(
    plane: DataFrame, groups: DataFrame | None = None, z_exclude: float = 0.0
) -> DataFrame:
    """``(entity, pc1, pc2, colour, retained)``: what is drawn, with pc2 across and pc1 upwards.

    Without ``groups(entity, party)`` every label is black.
    """
    marked = mark_retained(plane, ["pc1", "pc2"], z_exclude)
    if groups is None:
        coloured = marked.withColumn("colour", F.lit(OTHER_COLOUR))
    else:
        coloured = attach_group_colour(marked, groups)
    return coloured.select("entity", "pc1", "pc2", "colour", "retained")
