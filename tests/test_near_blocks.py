"""Blocks by place: what is out of reach is skipped, what is within reach is not."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import spectral, vectors
from pulsegrid.operators.kmeans import fit_many

from .test_pairs import as_vectors


def blobs(number=6, size=20, gap=100.0, offset=0.0):
    rng = np.random.default_rng(21)
    centres = rng.permutation(number)[:, None] * np.array([[gap, -gap, 0.0]])
    return np.vstack([rng.normal(0, 0.5, (size, 3)) + c for c in centres]) + offset


def sums_of(placed, gamma, block, shape, near):
    y = F.array(F.lit(1.0), F.col("entity").cast("double"))
    rows = spectral.affinity_sums(placed.rows.withColumn("y", y), gamma, block, shape, near).collect()
    return np.array([r["y"] for r in sorted(rows)])


@pytest.mark.parametrize("gamma, most", [(1.0, 0.4), (1e-9, 1.0)])
def test_sums_are_those_of_all_pairs(spark, gamma, most):
    data = blobs()
    table = as_vectors(spark, data)
    placed = vectors.near_blocks(table, spectral._reach(gamma), 8)
    assert placed.pairs_kept <= most * placed.pairs and (most < 1 or placed.pairs_kept == placed.pairs)
    sizes = [r["count"] for r in placed.rows.groupBy("_mine").count().collect()]
    assert sum(sizes) == len(data) and max(sizes) <= 3 * 8  # dealt by a hash within a ball
    affinity = np.exp(-gamma * ((data[:, None] - data[None]) ** 2).sum(-1))
    np.fill_diagonal(affinity, 0.0)
    want = affinity @ np.stack([np.ones(len(data)), np.arange(len(data))], axis=1)
    got = sums_of(placed, gamma, 8, (len(data), 3), placed.near)
    assert got == pytest.approx(want, rel=1e-12, abs=1e-300)


def test_pairs_at_the_reach_are_kept(spark):
    """Rows in a line: every block meets the next ones, and only those."""
    data = np.arange(200.0)[:, None] * np.array([[1.0, 0.0]])
    placed = vectors.near_blocks(as_vectors(spark, data), 10.0, 4)
    ball = {r["entity"]: (r["_ball"], r["_mine"]) for r in placed.rows.collect()}
    met = {r["_ball"]: {b for x in r["_near"] for b in range(x["first"], x["last"] + 1)} for r in placed.near.collect()}
    for i in range(200):
        for j in range(i, min(200, i + 11)):
            assert ball[j][1] in met[ball[i][0]] and ball[i][1] in met[ball[j][0]]
    assert placed.pairs_kept < placed.pairs / 2


def test_equal_rows_one_row_and_none(spark):
    same = vectors.near_blocks(as_vectors(spark, np.ones((50, 2))), 1.0, 5)
    assert same.rows.select("_ball").distinct().count() == 1 and same.rows.select("_mine").distinct().count() > 5
    assert same.pairs_kept == same.pairs
    one = vectors.near_blocks(as_vectors(spark, np.ones((1, 2))), 1.0, 5)
    assert one.rows.count() == 1 and one.pairs == one.pairs_kept == 1
    none = vectors.near_blocks(as_vectors(spark, np.ones((1, 2))).limit(0), 1.0, 5)
    assert none.rows.count() == 0 and none.pairs == 0


def test_spectral_clusters_of_far_blobs(spark):
    data = blobs(4, 12)
    found = spectral.eigenfeatures(as_vectors(spark, data), 4, 0.5, 3, block=6)[0].cache()
    labels = {r["entity"]: r["label"] for r in fit_many(found, [4], 1, 4)[4].labels(found).collect()}
    groups = [{labels[i] for i in range(12 * b, 12 * b + 12)} for b in range(4)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 4


@pytest.mark.parametrize("number", [3, 25])
def test_tiles_of_a_block_add_up_to_all_pairs(spark, monkeypatch, number):
    """Several tiles in a block, several blocks: the sums are those of the whole affinity."""
    monkeypatch.setattr(vectors, "TILE", 4)
    data = blobs(3, number)
    table, shape = as_vectors(spark, data), (len(data), 3)
    placed = vectors.near_blocks(table, spectral._reach(1e-5), 11, shape)
    affinity = np.exp(-1e-5 * ((data[:, None] - data[None]) ** 2).sum(-1))
    np.fill_diagonal(affinity, 0.0)
    want = affinity @ np.stack([np.ones(len(data)), np.arange(len(data))], axis=1)
    assert sums_of(placed, 1e-5, 11, shape, placed.near) == pytest.approx(want, rel=1e-12)


def test_summed_blocks_are_few_and_bounded():
    """Rows are sent to every other block, so blocks grow with the rows up to what a task holds."""
    assert vectors.summed_room(2_000, 64) == 1024 and vectors.summed_room(600_000, 64) == 16_384
    assert vectors.summed_room(10**6, 4096) * 4096 <= 1 << 22
    assert -(-100_000 // vectors.summed_room(100_000, 64)) <= 13


def test_power_iteration_is_that_of_all_pairs(spark):
    data = blobs(3, 12, 1.0)
    got = {r["entity"]: r["v"] for r in spectral.power_iteration(as_vectors(spark, data), 0.3, 6).collect()}
    affinity = np.exp(-0.3 * ((data[:, None] - data[None]) ** 2).sum(-1)) - np.eye(len(data))
    degree = affinity.sum(axis=1)
    v = degree / degree.sum()
    for _ in range(6):
        v = affinity @ v / degree
        v /= np.abs(v).sum()
    assert [got[i] for i in range(len(data))] == pytest.approx(v, rel=1e-9)
