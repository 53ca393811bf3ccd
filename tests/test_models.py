import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import clustering, evaluation, krylov, projection, spectral
from pulsegrid.operators.kmeans import fit_many
from pulsegrid.operators.sweep import sweep
from pulsegrid.operators.vectors import nearest_centroid
from pulsegrid.queries import checked

from .test_pairs import as_triples, as_vectors, brute_silhouette, sparse


def svd_scores(data, k=2):
    u, s, _ = np.linalg.svd(data - data.mean(0), full_matrices=False)
    scores = u[:, :k] * s[:k]
    lead = scores[np.abs(scores).argmax(0), range(k)]
    return scores * np.sign(lead)


def plane_array(plane):
    return np.array([[r["pc1"], r["pc2"]] for r in plane.orderBy("entity").collect()])


def test_pca_by_every_route(spark):
    data = sparse(12, 9, 6)
    want = svd_scores(data)
    triples = as_triples(spark, data)
    few = projection.plane_of_triples(triples, triples.select("entity"))
    assert plane_array(few) == pytest.approx(want, abs=1e-8)
    assert plane_array(projection.plane_of_vectors(as_vectors(spark, data))) == pytest.approx(want, abs=1e-8)
    many = projection.plane_of_triples(triples, triples.select("entity"), block=4)
    assert plane_array(many) == pytest.approx(want, abs=1e-3)


def test_pca_does_not_depend_on_partitioning(spark):
    data = sparse(12, 9, 6)
    triples = as_triples(spark, data)
    one, seven = (projection.plane_of_triples(triples.repartition(n), triples.select("entity")) for n in (1, 7))
    assert plane_array(one) == pytest.approx(plane_array(seven), abs=1e-9)


def test_compact_coordinates_keep_distances(spark):
    data = sparse(10, 40, 7)
    triples = as_triples(spark, data)
    rows = projection.compact_coordinates(triples, triples.select("entity")).orderBy("entity").collect()
    scores = np.array([r["features"] for r in rows])
    gaps = lambda x: ((x[:, None] - x[None]) ** 2).sum(-1)
    assert gaps(scores) == pytest.approx(gaps(data), abs=1e-7)


def test_projection_table(spark):
    plane = spark.createDataFrame([(i, float(i), 0.5 * i) for i in range(5)] + [(9, 90.0, 1.0)], "entity int, pc1 double, pc2 double")
    groups = spark.createDataFrame([(0, "R"), (1, "D"), (2, "E")], "entity int, party string")
    rows = {r["entity"]: r for r in projection.projection_table(plane, groups, 1.5).collect()}
    assert [rows[i]["colour"] for i in (0, 1, 2, 3)] == ["red", "blue", "black", "black"]
    assert not rows[9]["retained"] and rows[2]["retained"]
    assert {r["colour"] for r in projection.projection_table(plane).collect()} == {"black"}


BLOBS = np.array([[0, 0], [0, 1], [1, 0], [20, 20], [20, 21], [21, 20]], float)


def labels_of(df):
    return {r["entity"]: r["label"] for r in df.collect()}


def test_two_blobs(spark):
    space = clustering.FeatureSpace.from_vectors(as_vectors(spark, BLOBS))
    result = clustering.cluster(space, 2, seed=0)
    got = labels_of(result.labels)
    assert got[0] == got[1] == got[2] != got[3] and got[3] == got[4] == got[5]
    assert result.seed == 0  # zero is a seed, not "unset"
    inertia = evaluation.within_sum_of_squares(
        as_triples(spark, BLOBS + 1e-300), result.labels
    ).first()["inertia"]
    assert result.model.cost == pytest.approx(inertia)


def test_excluded_entity_joins_its_nearest_blob(spark):
    data = np.vstack([BLOBS, [[60, 50]]])
    space = clustering.FeatureSpace.from_vectors(as_vectors(spark, data))
    result = clustering.cluster(space, 2, z_exclude=2.0, seed=3)
    assert set(labels_of(result.retained)) == set(range(6))
    got = labels_of(result.labels)
    assert got[6] == got[3] != got[0]


def test_options_are_checked(spark):
    space = clustering.FeatureSpace.from_vectors(as_vectors(spark, BLOBS))
    for bad in (
        lambda: clustering.cluster(space, 1),
        lambda: clustering.cluster(space, 2, "ward"),
        lambda: clustering.cluster(space, 2, "spectral", z_exclude=1.0),
        lambda: sweep(space, metric="inertia", model="spectral"),
        lambda: sweep(space, metric="gap"),
        lambda: sweep(space, distance="nonsense"),
    ):
        with pytest.raises(ValueError):
            bad()


def test_more_restarts_never_cost_more(spark):
    vectors = as_vectors(spark, sparse(30, 4, 8))
    costs = [fit_many(vectors, [6], 1, n)[6].cost for n in (1, 4)]
    assert costs[1] <= costs[0] + 1e-9


def test_kmeans_reaches_a_fixed_point_whatever_the_partitions(spark):
    data = sparse(40, 5, 16)
    fits = [fit_many(as_vectors(spark, data).repartition(n), [2, 5], 3, 3) for n in (1, 6)]
    for k in (2, 5):
        one, other = (f[k] for f in fits)
        assert one.cost == pytest.approx(other.cost) and one.centres == pytest.approx(other.centres)
        gaps = ((data[:, None] - one.centres[None]) ** 2).sum(-1)
        assert one.cost == pytest.approx(gaps.min(axis=1).sum())
        for c in range(k):
            assert one.centres[c] == pytest.approx(data[gaps.argmin(axis=1) == c].mean(axis=0), abs=1e-3)


def test_fewer_distinct_rows_than_clusters(spark):
    vectors = as_vectors(spark, np.array([[1.0, 2.0]] * 5))
    assert fit_many(vectors, [3], 0, 2)[3].cost == pytest.approx(0.0)


@pytest.mark.parametrize("pca", [False, True])
def test_sweep_silhouette_equals_brute_force(spark, pca):
    data = sparse(12, 7, 9)
    triples = as_triples(spark, data)
    space = clustering.FeatureSpace.from_triples(triples, triples.select("entity"))
    got = sweep(space, 3, 2, "silhouette", "cityblock", pca=pca, seed=5, restarts=2)
    assert [r["k"] for r in got.collect()] == [2, 3] and got.columns == ["k", "metric", "distance", "value", "seed"]
    labels = labels_of(clustering.cluster(space, 2, pca=pca, seed=5, restarts=2).labels)
    shown = svd_scores(data) if pca else data
    assert got.first()["value"] == pytest.approx(
        brute_silhouette("cityblock", shown, [labels[i] for i in range(12)]), abs=1e-6
    )


def test_sweep_scores_only_retained_rows(spark):
    data = np.vstack([sparse(10, 6, 10), np.full((1, 6), 90.0)])
    triples = as_triples(spark, data)
    space = clustering.FeatureSpace.from_triples(triples, triples.select("entity"))
    got = sweep(space, 2, 2, "silhouette", "seuclidean", z_exclude=2.5, seed=1, restarts=2).first()["value"]
    result = clustering.cluster(space, 2, z_exclude=2.5, seed=1, restarts=2)
    kept = sorted(labels_of(result.retained))
    assert kept == list(range(10)) and len(labels_of(result.labels)) == 11
    labels = labels_of(result.retained)
    assert got == pytest.approx(brute_silhouette("seuclidean", data[:10], [labels[i] for i in kept]), abs=1e-6)


def test_sweep_inertia_falls(spark):
    space = clustering.FeatureSpace.from_vectors(as_vectors(spark, sparse(20, 4, 11)))
    values = [r["value"] for r in sweep(space, 2, 5, "inertia", seed=2, restarts=4).collect()]
    assert values == sorted(values, reverse=True)


def test_spectral_finds_components_by_both_routes(spark):
    rng = np.random.default_rng(12)
    data = np.vstack([rng.normal(0, 0.4, (8, 2)), rng.normal(0, 0.4, (8, 2)) + [9, 0]])
    vectors = as_vectors(spark, data)
    for block in (1024, 5):
        rows = spectral.spectral_features(vectors, 2, 1.0, 0, block, 8).cache()
        got = labels_of(fit_many(rows, [2], 0, 3)[2].labels(rows))
        assert len({got[i] for i in range(8)}) == 1 and len({got[i] for i in range(8, 16)}) == 1
        assert got[0] != got[8]


def test_power_iteration(spark):
    rng = np.random.default_rng(13)
    data = np.vstack([rng.normal(0, 0.2, (6, 2)), rng.normal(0, 0.2, (9, 2)) + [3, 0]])
    got = labels_of(clustering.cluster_by_power_iteration(as_vectors(spark, data), 2, 1.0))
    assert len(got) == 15 and set(got.values()) == {0, 1}


def test_item_clusters(spark):
    data = np.zeros((6, 8))
    data[:3, :4], data[3:, 4:] = 5.0, 7.0
    triples = as_triples(spark, data)
    rows = clustering.cluster_items(triples, triples.select("entity"), 2).collect()
    got = {r["item"]: r["label"] for r in rows}
    assert len(got) == 8 and len({got[i] for i in range(4)}) == 1 and got[0] != got[7]


def test_many_entities_from_triples(spark, monkeypatch):
    data = sparse(12, 9, 14)
    triples = as_triples(spark, data)
    monkeypatch.setattr(clustering.projection, "few_entities", lambda *a: False)
    space = clustering.FeatureSpace.from_triples(triples, triples.select("entity"))
    assert plane_array(space.plane) == pytest.approx(svd_scores(data), abs=1e-8)
    monkeypatch.setattr(clustering, "WIDEST_ROW", 3)
    space = clustering.FeatureSpace.from_triples(triples, triples.select("entity"))
    assert plane_array(space.plane) == pytest.approx(svd_scores(data), abs=1e-3)
    with pytest.raises(ValueError):
        space.features(False)


def test_nearest_centroid(spark):
    centres = spark.createDataFrame([(4, [0.0, 0.0]), (7, [20.0, 20.0])], "label int, features array<double>")
    got = labels_of(nearest_centroid(as_vectors(spark, BLOBS), centres))
    assert got == {0: 4, 1: 4, 2: 4, 3: 7, 4: 7, 5: 7}


def test_krylov_iteration_matches_eigenvectors(spark):
    rng = np.random.default_rng(15)
    for n, widest, decay in ((7, 256, 0.0), (60, 12, 0.1)):  # all blocks fit; the basis is full several times
        axes = np.linalg.qr(rng.normal(size=(n, n)))[0]
        lengths = np.exp(-decay * np.arange(n)) if decay else np.abs(rng.normal(size=n)) + 1
        matrix = (axes * lengths) @ axes.T
        cells = [(i, j, float(matrix[i, j])) for i in range(n) for j in range(n)]
        edges = spark.createDataFrame(cells, "entity int, other int, w double").repartition(3).cache()

        def apply(y):
            rows = edges.join(y.withColumnRenamed("entity", "other"), "other")
            rows = rows.select("entity", "w", F.posexplode("y").alias("at", "x"))
            summed = rows.groupBy("entity", "at").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
            listed = summed.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("l"))
            return listed.select("entity", F.col("l.x").alias("y"))

        start = krylov.random_start(spark.range(n).select(F.col("id").cast("int").alias("entity")), 4, 1)
        found = krylov.leading_eigenvectors(apply, start, 2, widest=widest)
        values, vectors = np.linalg.eigh(matrix)
        assert found.values == pytest.approx(values[::-1][:2], rel=1e-6)
        assert found.residuals.max() <= 1e-8
        got = np.array([r["y"] for r in found.vectors.orderBy("entity").collect()])
        assert np.abs(got.T @ vectors[:, ::-1][:, :2]) == pytest.approx(np.eye(2), abs=1e-5)
        with pytest.warns(UserWarning, match="residuals"):
            krylov.leading_eigenvectors(apply, start, 2, max_rounds=1, tol=1e-13)


def test_spectral_iteration_is_the_exact_solution(spark):
    rng = np.random.default_rng(16)
    data = np.vstack([rng.normal(0, 0.5, (40, 3)) + 2 * c for c in range(4)])
    vectors = as_vectors(spark, data)
    features, found = spectral.eigenfeatures(vectors, 4, 0.7, block=23)
    square = ((data[:, None] - data[None]) ** 2).sum(axis=2)
    affinity = np.exp(-0.7 * square) - np.eye(len(data))
    root = np.sqrt(affinity.sum(axis=1))
    values, axes = np.linalg.eigh(affinity / np.outer(root, root))
    assert found.values == pytest.approx(values[::-1][:4], abs=1e-9) and found.residuals.max() <= 1e-8
    got = np.array([r["features"] for r in features.orderBy("entity").collect()])
    want = axes[:, ::-1][:, :4] / root[:, None]
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-6)


def test_more_languages_than_models_raise(spark, monkeypatch):
    docs = spark.range(1001).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("lang"), F.lit("").alias("text"))
    monkeypatch.setattr(checked.b, "table", lambda *_: docs)
    monkeypatch.setattr(checked, "topics_per_cluster", lambda corpora, **_: pytest.fail(f"{len(corpora)} languages"))
    with pytest.raises(ValueError, match="1000 languages"):
        checked._topic_facts(spark, "", "lda")


def test_plane_of_a_matrix_with_fewer_directions_than_columns(spark):
    """Blocks get narrower where directions vanish; an item's cells are dealt out once."""
    rng = np.random.default_rng(17)
    data = np.abs(rng.normal(size=(30, 2)) @ rng.normal(size=(2, 12)))
    got = plane_array(clustering.projection.plane_by_iteration(as_triples(spark, data)))
    assert got == pytest.approx(svd_scores(data), abs=1e-6)
    low = 3.0 * np.outer(np.arange(1, 9), [1.0, 2.0, 4.0])
    got = plane_array(clustering.projection.plane_by_iteration(as_triples(spark, low)))
    assert np.abs(got[:, 0]) == pytest.approx(np.abs(svd_scores(low)[:, 0]), abs=1e-6) and np.abs(got[:, 1]).max() < 1e-6
