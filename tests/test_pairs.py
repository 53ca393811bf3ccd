import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.distances import DISTANCES, distance_column
from pulsegrid.operators import evaluation, pairs, vectors

GOLDEN = np.array([[1, 0, 2, 0], [1, 3, 0, 0], [0, 0, 0, 4]], float)


def direct(metric, x, y, data):
    """Textbook definitions on dense rows."""
    d = len(x)
    a, b = x != 0, y != 0
    tt, tf, ft = (a & b).sum(), (a & ~b).sum(), (~a & b).sum()
    r, ff = tf + ft, d - tt - tf - ft
    gap = np.abs(x - y)
    if metric in ("euclidean", "l2", "minkowski"):
        return np.sqrt((gap**2).sum())
    if metric == "sqeuclidean":
        return (gap**2).sum()
    if metric == "seuclidean":
        v = data.var(axis=0, ddof=1)
        return np.sqrt((gap[v > 0] ** 2 / v[v > 0]).sum())
    if metric == "mahalanobis":
        return np.sqrt((x - y) @ np.linalg.inv(np.cov(data.T)) @ (x - y))
    if metric == "cosine":
        return 1 - x @ y / np.sqrt(x @ x * (y @ y))
    if metric == "correlation":
        return 1 - np.corrcoef(x, y)[0, 1]
    if metric in ("cityblock", "manhattan", "l1"):
        return gap.sum()
    if metric == "braycurtis":
        return gap.sum() / np.abs(x + y).sum()
    if metric == "canberra":
        size = np.abs(x) + np.abs(y)
        return (gap[size > 0] / size[size > 0]).sum()
    if metric == "chebyshev":
        return gap.max()
    if metric == "hamming":
        return (x != y).mean()
    return {
        "matching": r / d,
        "jaccard": r / (tt + r) if tt + r else 0,
        "dice": r / (2 * tt + r) if tt + r else 0,
        "kulsinski": (r - tt + d) / (r + d),
        "rogerstanimoto": 2 * r / (tt + ff + 2 * r),
        "sokalmichener": 2 * r / (tt + ff + 2 * r),
        "russellrao": (d - tt) / d,
        "sokalsneath": 2 * r / (tt + 2 * r) if tt + r else 0,
        "yule": 2 * tf * ft / (tt * ff + tf * ft) if tf * ft else 0,
    }[metric]


def expected(metric, data):
    n = len(data)
    return {(i, j): direct(metric, data[i], data[j], data) for i in range(n) for j in range(i + 1, n)}


def as_triples(spark, data):
    cells = [(int(i), int(j), float(data[i, j])) for i, j in zip(*np.nonzero(data))]
    return spark.createDataFrame(cells, "entity int, item int, rate double")


def as_vectors(spark, data):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(data)]
    return spark.createDataFrame(rows, "entity int, features array<double>")


def sparse(n, d, seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(1, 6, (n, d)) * (rng.random((n, d)) < 0.4)
    data[:, 0] = 1 + rng.integers(0, 3, n)  # no empty rows
    return data.astype(float)


def same(got, want):
    got = {(r["a"], r["b"]): r["distance"] for r in got.collect()}
    assert got.keys() == want.keys()
    for pair, value in want.items():
        assert got[pair] == pytest.approx(value, abs=1e-9), pair


@pytest.mark.parametrize("block", [1024, 4])
def test_every_distance_from_triples(spark, block):
    data = sparse(11, 23, 1)
    triples = as_triples(spark, data).repartition(5)
    stats = pairs.pair_stats(triples, triples.select("entity"), block=block).cache()
    assert stats.count() == 55 and stats.filter(F.col("d") != 23).count() == 0
    for metric in DISTANCES:
        if metric not in ("seuclidean", "mahalanobis"):
            same(stats.select("a", "b", distance_column(metric).alias("distance")), expected(metric, data))
    same(pairs.pair_distances(triples, triples.select("entity"), "seuclidean", block), expected("seuclidean", data))


@pytest.mark.parametrize("metric", sorted(DISTANCES))
def test_every_distance_from_vectors_in_small_blocks(spark, metric):
    data = sparse(14, 5, 2)
    same(vectors.vector_pair_distances(as_vectors(spark, data), metric, block=4), expected(metric, data))


def test_golden_values(spark):
    triples = as_triples(spark, GOLDEN)
    stats = pairs.pair_stats(triples, triples.select("entity"))
    first = stats.filter("a = 0 and b = 1")
    want = {"cityblock": 5, "hamming": 0.5, "jaccard": 2 / 3, "braycurtis": 5 / 7, "euclidean": 13**0.5}
    got = first.select(*[distance_column(m).alias(m) for m in want]).first()
    for metric, value in want.items():
        assert got[metric] == pytest.approx(value), metric


def test_listed_entities_without_events_do_not_appear(spark):
    triples = as_triples(spark, GOLDEN)
    got = pairs.pair_distances(triples, spark.range(10).select(F.col("id").cast("int").alias("entity")))
    assert {(r["a"], r["b"]) for r in got.collect()} == {(0, 1), (0, 2), (1, 2)}


def test_mahalanobis_needs_spread_and_few_dimensions(spark):
    with pytest.raises(ValueError):
        vectors.vector_pair_distances(as_vectors(spark, sparse(4, 6, 3)), "mahalanobis")
    line = np.array([[i, 2.0 * i] for i in range(6)])
    with pytest.raises(ValueError):
        vectors.vector_pair_distances(as_vectors(spark, line), "mahalanobis")
    with pytest.raises(ValueError):
        pairs.pair_distances(as_triples(spark, GOLDEN), as_triples(spark, GOLDEN).select("entity"), "nonsense")


def brute_silhouette(metric, data, labels):
    scores = []
    for i in range(len(data)):
        mean = {}
        for label in set(labels):
            rest = [direct(metric, data[i], data[j], data) for j in range(len(data)) if j != i and labels[j] == label]
            if rest:
                mean[label] = np.mean(rest)
        others = [v for label, v in mean.items() if label != labels[i]]
        if labels[i] not in mean:
            scores.append(0.0)
        else:
            a, b = mean[labels[i]], min(others)
            scores.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.mean(scores)


@pytest.mark.parametrize("metric", ["euclidean", "cityblock", "jaccard", "seuclidean", "mahalanobis"])
def test_silhouette_both_ways_with_a_lone_member(spark, metric):
    data = sparse(13, 4, 4)
    data[:, 3] += np.arange(13) % 5
    labels = [0, 1, 2] + [i % 2 for i in range(10)]
    marks = spark.createDataFrame(list(enumerate(labels)), "entity int, label int")
    want = brute_silhouette(metric, data, labels)
    blocks = evaluation.silhouette_vectors(as_vectors(spark, data), marks, metric, block=4)
    assert blocks.first()["silhouette"] == pytest.approx(want)
    table = vectors.vector_pair_distances(as_vectors(spark, data), metric)
    assert evaluation.silhouette(table, marks).first()["silhouette"] == pytest.approx(want)


def test_several_labellings_in_one_pass(spark):
    data = sparse(10, 4, 5)
    labellings = {2: [i % 2 for i in range(10)], 3: [i % 3 for i in range(10)]}
    rows = [(k, i, label) for k, labels in labellings.items() for i, label in enumerate(labels)]
    marks = spark.createDataFrame(rows, "k int, entity int, label int")
    got = {r["k"]: r["silhouette"] for r in evaluation.silhouette_vectors(as_vectors(spark, data), marks).collect()}
    for k, labels in labellings.items():
        assert got[k] == pytest.approx(brute_silhouette("euclidean", data, labels))
    ch = {r["k"]: r["calinski_harabasz"] for r in evaluation.calinski_harabasz(as_triples(spark, data), marks).collect()}
    inertia = {r["k"]: r["inertia"] for r in evaluation.within_sum_of_squares(as_triples(spark, data), marks).collect()}
    for k, labels in labellings.items():
        labels = np.array(labels)
        within = sum(((data[labels == c] - data[labels == c].mean(0)) ** 2).sum() for c in set(labels))
        between = ((data - data.mean(0)) ** 2).sum() - within
        assert inertia[k] == pytest.approx(within)
        assert ch[k] == pytest.approx((between / (k - 1)) / (within / (10 - k)))


def test_calinski_harabasz_without_spread_is_one(spark):
    data = np.array([[1.0, 0], [1, 0], [0, 2], [0, 2]])
    marks = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "entity int, label int")
    assert evaluation.calinski_harabasz(as_triples(spark, data), marks).first()["calinski_harabasz"] == 1.0


def test_one_label_has_no_silhouette(spark):
    marks = spark.createDataFrame([(i, 0) for i in range(3)], "entity int, label int")
    assert evaluation.silhouette_vectors(as_vectors(spark, GOLDEN), marks).first()["silhouette"] is None


@pytest.mark.parametrize("metric", ["euclidean", "l2", "minkowski", "sqeuclidean", "seuclidean", "mahalanobis", "correlation"])
def test_block_distances_do_not_depend_on_an_offset(metric):
    import numpy as np

    from pulsegrid.functions.distances import block_distances

    rows = np.random.default_rng(8).normal(size=(6, 5))
    want = block_distances(metric, rows[:4], rows)
    assert block_distances(metric, rows[:4] + 1e8, rows + 1e8) == pytest.approx(want, abs=2e-6)


@pytest.mark.parametrize("metric, offset", [("sqeuclidean", 0.0), ("sqeuclidean", 1e6), ("cosine", 0.0)])
def test_label_sums_without_pairs(spark, metric, offset):
    """Two labellings at once, a lone member, equal rows and a row of zeros, against all pairs."""
    import numpy as np

    from pulsegrid.functions.distances import block_distances

    rows = np.random.default_rng(4).normal(size=(9, 3)) + offset
    rows[3] = rows[2]
    if not offset:
        rows[5] = 0.0
    marks = {0: [0, 0, 1, 1, 1, 2, 0, 1, 0], 1: [4] * 9}
    labels = spark.createDataFrame([(k, i, x) for k, m in marks.items() for i, x in enumerate(m)], "k int, entity int, label int")
    found = vectors.label_distance_sums(as_vectors(spark, rows), labels, metric).collect()
    pairs = block_distances(metric, rows, rows)
    np.fill_diagonal(pairs, 0.0)
    want = {
        (k, i, m[i], x): (pairs[i][[j for j in range(9) if m[j] == x]].sum(), sum(v == x for v in m) - (m[i] == x))
        for k, m in marks.items() for i in range(9) for x in set(m)
    }
    got = {(r["k"], r["entity"], r["own"], r["label"]): (r["total"], r["n"]) for r in found}
    assert got.keys() == want.keys() and len(found) == len(want)
    for key, (total, n) in want.items():
        assert got[key][0] == pytest.approx(total, abs=1e-6) and got[key][1] == n


@pytest.mark.parametrize("metric", ["correlation", "euclidean", "chebyshev", "canberra", "braycurtis", "cityblock"])
def test_silhouette_in_tiles_and_without_pairs(spark, monkeypatch, metric):
    from pulsegrid.operators import vectors

    monkeypatch.setattr(vectors, "TILE", 5)
    if metric == "correlation":  # the sums of labels tell everything
        monkeypatch.setattr(vectors, "block_pairs", lambda *a, **k: pytest.fail("all pairs"))
    data = np.random.default_rng(31).normal(size=(40, 4))
    data[7] = data[8]
    labels = [i % 3 for i in range(40)]
    marks = spark.createDataFrame(list(enumerate(labels)), "entity long, label int")
    score = evaluation.silhouette_vectors(as_vectors(spark, data), marks, metric, 17).first()["silhouette"]
    assert score == pytest.approx(brute_silhouette(metric, data, labels), abs=1e-9)


def test_columns_give_the_statistics_of_rows():
    from pulsegrid.functions import distances

    rng = np.random.default_rng(32)
    a, b = rng.integers(-2, 3, (9, 4)) * 0.1, rng.integers(-2, 3, (11, 4)) * 0.1
    wanted = {"l1", "neq", "max_diff", "sum_abs", "canberra"}
    got = distances._column_statistics(a, b, wanted)
    for i in range(9):
        want = distances.block_statistics(a[i : i + 1], b, wanted)
        assert all(got[name][i] == pytest.approx(want[name][0], abs=1e-14) for name in wanted)
