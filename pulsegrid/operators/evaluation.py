"""Scores of a labelling: silhouette, Calinski-Harabasz, inertia.

Every function takes ``labels(entity, label)``; with a further column ``k`` it scores several
labellings in the same pass and returns one row per ``k``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import checked_small
from .vectors import label_distance_sums


def _keyed(labels: DataFrame) -> DataFrame:
    labels = labels if "k" in labels.columns else labels.withColumn("k", F.lit(0))
    return labels.select(F.col("k").cast("int").alias("k"), "entity", F.col("label").cast("int").alias("label"))


def pair_label_sums(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``pairs(a, b, distance)`` to ``(k, entity, own, label, total, n)``."""
    labels = checked_small(_keyed(labels))
    ways = F.array(
        F.struct(F.col("a").alias("entity"), F.col("b").alias("other")),
        F.struct(F.col("b").alias("entity"), F.col("a").alias("other")),
    )
    directed = pairs.select(F.explode(ways).alias("way"), "distance").select("way.*", "distance")
    other = labels.select("k", F.col("entity").alias("other"), "label")
    own = labels.select("k", "entity", F.col("label").alias("own"))
    return (
        directed.join(other, "other")
        .join(own, ["k", "entity"])
        .groupBy("k", "entity", "own", "label")
        .agg(F.sum("distance").alias("total"), F.count("*").alias("n"))
    )


def silhouette_from_sums(sums: DataFrame) -> DataFrame:
    """``(k, silhouette)``: the mean of (b - a) / max(a, b); a lone member scores 0."""
    mean, mine = F.try_divide("total", "n"), F.col("own") == F.col("label")
    per_entity = sums.groupBy("k", "entity").agg(
        F.max(F.when(mine, mean)).alias("a"), F.min(F.when(~mine, mean)).alias("b")
    )
    score = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    score = F.when(F.col("a").isNull() & F.col("b").isNotNull(), 0.0).when(
        F.greatest("a", "b") == 0, 0.0
    ).otherwise(score)
    return per_entity.groupBy("k").agg(F.avg(score).alias("silhouette"))


def silhouette(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Silhouette from a distance table; null when there is only one label."""
    return silhouette_from_sums(pair_label_sums(pairs, labels))


def silhouette_vectors(
    vectors: DataFrame, labels: DataFrame, metric: str = "euclidean", block: int | None = None
) -> DataFrame:
    """Silhouette of dense vectors, block by block, under any of the 24 distances."""
    return silhouette_from_sums(label_distance_sums(vectors, labels, metric, block))


def _sums_of_squares(triples: DataFrame, labels: DataFrame) -> DataFrame:
    """``(k, within, between, clusters, members)`` from sparse triples: absent cells are zeros.

    Labelled entities are the rows of the matrix, so only those that occur should be labelled. Gaps to
    the means are squared, not values, so scores do not depend on where the origin is.
    """
    labels = checked_small(_keyed(labels))
    sizes = labels.groupBy("k", "label").agg(F.count("*").alias("size"))
    sizes = checked_small(sizes)
    totals = checked_small(sizes.groupBy("k").agg(F.sum("size").alias("members"), F.count("*").alias("clusters")))
    cells = triples.join(labels, "entity").select("k", "label", "item", "rate")
    # Clusters without a cell in an item have mean 0 there.
    means = (
        cells.groupBy("k", "label", "item")
        .agg(F.sum("rate").alias("s"), F.count("*").alias("here"))
        .join(sizes, ["k", "label"])
        .withColumn("mean", F.col("s") / F.col("size"))
    )
    gap = F.col("rate") - F.col("mean")
    near = cells.join(means.select("k", "label", "item", "mean"), ["k", "label", "item"])
    near = near.groupBy("k").agg(F.sum(gap * gap).alias("near"))
    absent = (F.col("size") - F.col("here")) * F.col("mean") * F.col("mean")
    overall = means.groupBy("k", "item").agg(
        F.sum("s").alias("s"), F.sum("size").alias("present"), F.sum(absent).alias("absent")
    )
    overall = overall.join(totals, "k").withColumn("overall", F.col("s") / F.col("members"))
    away = F.col("mean") - F.col("overall")
    apart = means.join(overall.select("k", "item", "overall"), ["k", "item"])
    apart = apart.groupBy("k").agg(F.sum(F.col("size") * away * away).alias("apart"))
    rest = (F.col("members") - F.col("present")) * F.col("overall") * F.col("overall")
    zeros = overall.groupBy("k").agg(F.sum("absent").alias("absent"), F.sum(rest).alias("rest"))
    return zeros.join(near, "k").join(apart, "k").join(totals, "k").select(
        "k",
        (F.col("near") + F.col("absent")).alias("within"),
        (F.col("apart") + F.col("rest")).alias("between"),
        "clusters",
        "members",
    )


def within_sum_of_squares(triples: DataFrame, labels: DataFrame) -> DataFrame:
    """``(k, inertia)``: squared distances to the cluster means."""
    return _sums_of_squares(triples, labels).select("k", F.greatest("within", F.lit(0.0)).alias("inertia"))


def calinski_harabasz(triples: DataFrame, labels: DataFrame) -> DataFrame:
    """``(k, calinski_harabasz)``; 1 when there is no spread within clusters."""
    sums = _sums_of_squares(triples, labels)
    between = F.try_divide(F.col("between"), F.col("clusters") - 1)
    within = F.try_divide(F.col("within"), F.col("members") - F.col("clusters"))
    score = F.when(F.col("within") <= 0, 1.0).otherwise(F.try_divide(between, within))
    return sums.select("k", score.alias("calinski_harabasz"))
