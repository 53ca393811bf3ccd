"""k-means on triples against the dense one, and the routes that use it."""

import numpy as np
import pytest

from pulsegrid.operators import clustering, projection, sparse_kmeans
from pulsegrid.operators.kmeans import fit_many
from pulsegrid.operators.sweep import sweep

from .test_pairs import as_triples, as_vectors


def groups(labels):
    out = {}
    for r in labels.collect():
        out.setdefault(r["label"], set()).add(r[0])
    return sorted(map(sorted, out.values()))


def blobs(seed=0, each=8):
    rng = np.random.default_rng(seed)
    data = np.zeros((3 * each, 12))
    for c in range(3):
        data[c * each : (c + 1) * each, 4 * c : 4 * c + 4] = rng.random((each, 4)) + 3 * (c + 1)
    return data


def test_same_as_dense(spark):
    data = blobs()
    data[3, :] = 0
    data[3, 11] = -2.0  # few common items, and a negative value
    dense = fit_many(as_vectors(spark, data), [3], 1, 6)[3]
    sparse = sparse_kmeans.fit_many(as_triples(spark, data), [3], 1, 6)[3]
    assert groups(sparse.assigned) == groups(dense.labels(as_vectors(spark, data)))
    assert sparse.cost == pytest.approx(dense.cost) and sparse.converged
    assert groups(sparse.labels(as_triples(spark, data))) == groups(sparse.assigned)


def test_many_entities_and_items_are_clustered_in_full(spark, monkeypatch):
    data = blobs(2)
    triples = as_triples(spark, data)
    monkeypatch.setattr(clustering, "WIDEST_ROW", 3)
    monkeypatch.setattr(projection, "few_entities", lambda entities, block=0: False)
    space = clustering.FeatureSpace.from_triples(triples, triples.select("entity").distinct())
    assert space.full is None
    result = clustering.cluster(space, 3, seed=1, restarts=2)
    assert groups(result.labels) == [list(range(8)), list(range(8, 16)), list(range(16, 24))]
    scores = sweep(space, 2, 3, "calinski_harabasz", seed=1, restarts=2).collect()
    assert scores[1]["value"] > scores[0]["value"]
    items = clustering.cluster_items(triples, triples.select("entity").distinct(), 3, seed=1)
    assert groups(items) == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]


def test_nothing_to_cluster(spark):
    with pytest.raises(ValueError, match="nothing to cluster"):
        sparse_kmeans.fit_many(as_triples(spark, np.zeros((2, 2))), [2], 0)


def test_cells_do_not_grow_with_the_centres(spark, monkeypatch):
    """Nothing written by cell or item has more rows than the matrix has cells; empty clusters keep their centre."""
    data, written = blobs(3), []
    keep = sparse_kmeans.cut_lineage

    def counted(df):
        kept = keep(df)
        written.append((kept.columns, kept.count()))
        return kept

    monkeypatch.setattr(sparse_kmeans, "cut_lineage", counted)
    monkeypatch.setattr(sparse_kmeans, "_CENTRES_AT_ONCE", 16)
    triples = as_triples(spark, data)
    fitted = sparse_kmeans.fit_many(triples, [3], 1, 9)
    assert groups(fitted[3].assigned) == [list(range(8)), list(range(8, 16)), list(range(16, 24))]
    assert max(n for columns, n in written if "item" in columns) <= triples.count()
    labels = spark.createDataFrame([(0, 0, 0), (1, 0, 0)], "entity int, model int, label int")
    rows = spark.createDataFrame([(0, 0, 5, 1.0), (0, 1, 6, 4.0)], "model int, label int, item int, value double")
    cells = spark.createDataFrame([(0, 5, 2.0), (1, 5, 4.0), (1, 7, 6.0)], "entity int, item int, rate double")
    means = sparse_kmeans._means(cells, labels, sparse_kmeans._side_by_side(rows))
    assert sorted(map(tuple, means.spelled_out().collect())) == [(0, 0, 5, 3.0), (0, 0, 7, 3.0), (0, 1, 6, 4.0)]
    assert means.norms == [18.0, 16.0]


def test_item_clusters_evaluate_the_matrix_once(spark):
    cells = as_triples(spark, blobs(4))
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    triples = cells.mapInArrow(watched, cells.schema)
    got = clustering.cluster_items(triples, cells.select("entity").distinct(), 3, seed=1)
    assert groups(got) == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]
    assert seen.value == cells.count()
