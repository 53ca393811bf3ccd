"""Pairs of blocks read where the blocks were written, what is left on disk, and sums over pairs in their task."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import krylov, spectral, vectors
from pulsegrid.settings import cut_lineage, cut_plan, release

from .test_pairs import as_vectors


def checkpoints(spark):
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {x for x in os.listdir(folder) if os.listdir(f"{folder}/{x}")}


def test_rows_are_not_sent_to_every_block(spark):
    packed = vectors.packed_blocks(as_vectors(spark, np.arange(80.0).reshape(40, 2)), 5)
    pairs = vectors.over_block_pairs(packed, lambda found: iter(()), "n long")
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "Broadcast" not in plan
    assert packed.count() <= 8 and packed.selectExpr("sum(size(_with))").first()[0] <= 36


def test_sums_leave_no_blocks(spark):
    data = np.random.default_rng(3).normal(size=(30, 2))
    rows = as_vectors(spark, data).withColumn("y", F.array(F.lit(1.0))).localCheckpoint()
    before = checkpoints(spark)
    sums = spectral.affinity_sums(rows, 0.5, 7, (30, 2))
    assert len(checkpoints(spark) - before) == 1  # the sums
    release(sums)
    assert checkpoints(spark) == before


def test_rows_of_one_entity_are_added(spark):
    data = [(i % 7 if i % 5 else None, [float(i), 1.0]) for i in range(60)]
    rows = spark.createDataFrame(data, "entity long, y array<double>").repartition(3)
    got = {r["entity"]: r["y"] for r in krylov.added_rows(rows).collect()}
    want = {e: [sum(y[0] for k, y in data if k == e), float(sum(k == e for k, _ in data))] for e, _ in data}
    assert got == want and krylov.added_rows(rows.limit(0)).count() == 0


def test_size_guesses_do_not_multiply(spark):
    rows = spark.range(4)
    for _ in range(6):
        rows = cut_plan(rows.join(rows.select("id"), "id"))
    size = rows.join(rows, "id")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert size < 10**60
    assert cut_plan(spark.range(3)).count() == cut_lineage(spark.range(3)).count() == 3


@pytest.mark.parametrize("block", [None, 7])
def test_folded_distances_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "TILE", 4)
    data = np.random.default_rng(5).normal(size=(30, 3))
    rows = as_vectors(spark, data).withColumn("y", F.array(F.col("entity").cast("double"), F.lit(1.0)))
    twice = rows.union(rows.limit(1))

    def fold(one, other, distance, keep):
        return np.array([(distance * keep * np.add.outer(one[:, 0], other[:, 0])).sum(), (keep * (one @ other.T > -1)).sum()])

    for table in (rows, twice):
        parts = vectors.vector_pair_distances(table, "sqeuclidean", block, fold).collect()
        pairs = vectors.vector_pair_distances(table, "sqeuclidean", block).collect()
        want = sum(r["distance"] * (r["a"] + r["b"]) for r in pairs)
        total, number = np.sum([r["sums"] for r in parts], axis=0)
        assert total == pytest.approx(want) and number == len(pairs)
    assert len(pairs) == 30 * 29 / 2 + 29


def test_a_start_in_single_precision_ends_in_full(spark, monkeypatch):
    monkeypatch.setattr(spectral, "ROUGH_ROWS", 50)
    rng = np.random.default_rng(16)
    data = np.vstack([rng.normal(0, 0.5, (40, 3)) + 2 * c for c in range(4)])
    square = ((data[:, None] - data[None]) ** 2).sum(axis=2)
    affinity = np.exp(-0.7 * square) - np.eye(len(data))
    root = np.sqrt(affinity.sum(axis=1))
    values, axes = np.linalg.eigh(affinity / np.outer(root, root))
    before = checkpoints(spark)
    features, found = spectral.eigenfeatures(as_vectors(spark, data), 4, 0.7, block=53)
    assert found.residuals.max() <= 1e-8 and found.values == pytest.approx(values[::-1][:4], abs=1e-12)
    got = np.array([r["features"] for r in features.orderBy("entity").collect()])
    assert np.abs(got) == pytest.approx(np.abs(axes[:, ::-1][:, :4] / root[:, None]), abs=1e-7)
    assert len(checkpoints(spark) - before) <= 6  # not one a round


def test_absolute_differences_need_no_pairs(spark, monkeypatch):
    """Equal values, columns in several parts, two labellings, an entity with two rows; against all pairs."""
    from pulsegrid.functions.distances import block_distances

    monkeypatch.setattr(vectors, "over_block_pairs", lambda *a: pytest.fail("all pairs"))
    monkeypatch.setattr(vectors, "_CELLS_AT_ONCE", 9)
    rng = np.random.default_rng(6)
    data = np.round(rng.normal(size=(40, 3)), 1) + [1e6, 0, 0]
    data[:, 2] = 7.3
    entity = [*range(39), 5]
    marks = {2: [i % 3 for i in range(39)], 3: [i // 20 for i in range(39)]}
    table = spark.createDataFrame([(e, x.tolist()) for e, x in zip(entity, data)], "entity long, features array<double>")
    labels = spark.createDataFrame([(k, i, x) for k, m in marks.items() for i, x in enumerate(m)], "k int, entity long, label int")
    found = vectors.label_distance_sums(table, labels, "cityblock").collect()
    distance = block_distances("cityblock", data, data)
    want = {}
    for k, m in marks.items():
        for i, e in enumerate(entity):
            for label in set(m):
                of = [j for j, other in enumerate(entity) if m[other] == label]
                total, n = want.get((k, e, m[e], label), (0.0, 0))
                want[k, e, m[e], label] = total + distance[i][of].sum(), n + len(of) - (m[e] == label)
    got = {(r["k"], r["entity"], r["own"], r["label"]): (r["total"], r["n"]) for r in found}
    assert got.keys() == want.keys() and len(found) == len(want)
    for key, (total, n) in want.items():
        assert got[key] == (pytest.approx(total, abs=1e-9), n)


def test_absolute_differences_of_equal_rows_are_none(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "entity int, label int")
    rows = as_vectors(spark, np.full((9, 2), 0.1))
    assert {r["total"] for r in vectors.label_distance_sums(rows, labels, "l1").collect()} == {0.0}
