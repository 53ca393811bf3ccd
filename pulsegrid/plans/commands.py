"""The six commands as functions over three tables: load, project, cluster, evaluate, rank, topics.

Every command returns DataFrames; what the rows look like on a screen is left to the caller.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attributes, clustering, clusters, projection, ranking, rates, sweep, terms, topics
from ..sources import catalog, files


@dataclass(frozen=True)
class Tables:
    """Names of the tables: events(item, entity), entities(entity, weight, party),
    items(item, title, body), and the stored matrix(entity, item, rate)."""

    events: str = "engagement_events"
    entities: str = "engagement_entities"
    items: str = "engagement_items"
    matrix: str = "engagement_matrix"

    @property
    def loaded(self) -> list[str]:
        return [self.events, self.entities, self.items]


def load_tables(
    spark: SparkSession,
    events: str,
    locations: str,
    weights: str,
    groups: str,
    items: str,
    tables: Tables = Tables(),
    exclude: Sequence[str] = ("DC",),
    force: bool = False,
    spread_events: bool = False,
) -> bool:
    """Read the five CSV inputs into the three tables; False when they were there already."""
    if not catalog.check_writable(spark):
        raise RuntimeError("the catalog does not accept new tables")
    if not force and not catalog.missing_tables(spark, tables.loaded):
        return False
    located = rates.locate_events(files.read_events(spark, events), files.read_locations(spark, locations))
    catalog.write_table(located, tables.events, "entity" if spread_events else None)
    kept = attributes.exclude_entities(files.read_weights(spark, weights), exclude)
    grouped = attributes.attach_group(kept, files.read_groups(spark, groups))
    catalog.write_table(grouped, tables.entities)
    catalog.write_table(files.read_items(spark, items), tables.items)
    return True


def engagement_matrix(spark: SparkSession, tables: Tables = Tables(), force: bool = False) -> DataFrame:
    """The stored long matrix, built on first use and again when events or entities have changed."""
    catalog.require_tables(spark, tables.loaded)
    return catalog.load_or_build(
        spark,
        tables.matrix,
        lambda: rates.engagement_rates(spark.table(tables.events), spark.table(tables.entities)),
        inputs={name: name for name in (tables.events, tables.entities)},
        force=force,
    )


def feature_space(spark: SparkSession, tables: Tables = Tables()) -> clustering.FeatureSpace:
    return clustering.FeatureSpace.from_triples(
        engagement_matrix(spark, tables), catalog.read_table(spark, tables.entities, "entity")
    )


def project(
    spark: SparkSession, show_groups: bool = False, z_exclude: float = 0.0, tables: Tables = Tables()
) -> DataFrame:
    """Points of the two-dimensional projection."""
    groups = catalog.read_table(spark, tables.entities, "entity", "party") if show_groups else None
    return projection.projection_table(feature_space(spark, tables).plane, groups, z_exclude)


@dataclass
class ClusterReport:
    labels: DataFrame  # (entity, label), sorted
    legend: DataFrame  # (cluster_no, colour_name, cluster_id), sorted
    map_table: DataFrame  # (entity, label, colour_name, colour_hex)
    seed: int


def report(result: clustering.Clustering, ordinals: DataFrame) -> ClusterReport:
    labels = result.labels
    ids = clusters.cluster_ids(labels, ordinals)
    return ClusterReport(
        labels.orderBy("entity"),
        attributes.legend(ids).orderBy("cluster_no"),
        attributes.map_table(labels, ordinals.select("entity")),
        result.seed,
    )


def cluster(
    spark: SparkSession,
    k: int = 2,
    model: str = "kmeans",
    pca: bool = False,
    z_exclude: float = 0.0,
    seed: int | None = None,
    ordinals: DataFrame | None = None,
    tables: Tables = Tables(),
) -> ClusterReport:
    """Cluster the entities and name every cluster by its code."""
    result = clustering.cluster(feature_space(spark, tables), k, model, pca, z_exclude, seed)
    return report(result, ordinals if ordinals is not None else clusters.state_ordinals(spark))


def evaluate(
    spark: SparkSession,
    lowest: int = 2,
    highest: int = 10,
    metric: str = "silhouette",
    distance: str = "euclidean",
    model: str = "kmeans",
    pca: bool = False,
    z_exclude: float = 0.0,
    seed: int | None = None,
    tables: Tables = Tables(),
) -> DataFrame:
    """The metric for every number of clusters in the range."""
    space = feature_space(spark, tables)
    return sweep.sweep(space, lowest, highest, metric, distance, model, pca, z_exclude, seed)


def top_items(
    spark: SparkSession,
    cluster_id: str,
    n: int = 10,
    body: bool = False,
    truncate: int | None = 50,
    by: str = "title",
    ordinals: DataFrame | None = None,
    tables: Tables = Tables(),
) -> DataFrame:
    """The most engaged items of a cluster, named by its code."""
    catalog.require_tables(spark, tables.loaded)
    ordinals = ordinals if ordinals is not None else clusters.state_ordinals(spark)
    best = ranking.top_items_for_cluster(
        spark.table(tables.events), spark.table(tables.items), cluster_id, ordinals, n, by=by, body=body
    )
    shown = [c for c in best.columns if c != "signatures"]
    for c in shown:
        best = best.withColumn(c, attributes.display_text(F.col(c), truncate))
    return best


def cluster_corpora(
    events: DataFrame, items: DataFrame, cluster_ids: Sequence[str], ordinals: DataFrame, sample: int = 500
) -> DataFrame:
    """``(cluster_id, doc, text)``: title and body of every cluster's most engaged items, from one
    pass over the events for all clusters."""
    if sample < 1:
        raise ValueError("sample must be at least 1")
    for code in cluster_ids:
        ranking.members_of(code, ordinals)  # refuses a bad code before any job
    ids = events.sparkSession.createDataFrame([(c,) for c in dict.fromkeys(cluster_ids)], "cluster_id string")
    members = clusters.cluster_members(ids, ordinals)
    best = ranking.top_items_per_cluster(events, items, members, sample)
    return terms.corpus(best.select("cluster_id", F.col("title").alias("doc"), "title", "body"))


def cluster_topics(docs: DataFrame, cluster_ids: Sequence[str], **options) -> DataFrame:
    """Topics of each cluster's part of ``docs``, which holds at most a sample per cluster and is
    kept while the models read it again and again."""
    docs = docs.persist()
    corpora = {c: docs.filter(F.col("cluster_id") == c).select("doc", "text") for c in cluster_ids}
    found = topics.topics_per_cluster(corpora, **options)
    if options.get("number_of_topics", 10) > 1:  # models are fitted by now; a single topic is a plain query
        docs.unpersist()
    return found


def topic_extraction(
    spark: SparkSession,
    cluster_ids: Sequence[str],
    method: str = "lda",
    number_of_topics: int = 10,
    words_per_topic: int = 10,
    sample: int = 500,
    stop_words: Sequence[str] | None = None,
    ordinals: DataFrame | None = None,
    tables: Tables = Tables(),
) -> DataFrame:
    """Topics of several clusters side by side, each from its own top items."""
    catalog.require_tables(spark, tables.loaded)
    ordinals = ordinals if ordinals is not None else clusters.state_ordinals(spark)
    docs = cluster_corpora(
        spark.table(tables.events), spark.table(tables.items), cluster_ids, ordinals, sample
    )
    return cluster_topics(
        docs,
        cluster_ids,
        method=method,
        number_of_topics=number_of_topics,
        words_per_topic=words_per_topic,
        stop_words=terms.default_stop_words() if stop_words is None else stop_words,
    )
