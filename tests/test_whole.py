"""Nothing is dropped, cut off or taken from a stale copy in silence."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import clusters, evaluation, pairs, rates
from pulsegrid.operators.clustering import FeatureSpace
from pulsegrid.plans import commands
from pulsegrid.settings import spread_rows
from pulsegrid.sources import catalog, dump


@pytest.mark.parametrize("block", [1024, 2])
def test_unlisted_entities_do_not_count_in_d(spark, block):
    cells = [(e, i, 1.0 + e * i) for e in range(5) for i in range(4)] + [(99, 7, 3.0)]
    triples = spark.createDataFrame(cells, "entity int, item int, rate double")
    listed = spark.range(5).select(F.col("id").cast("int").alias("entity"))
    got = pairs.pair_stats(triples, listed, block=block).collect()
    assert len(got) == 10 and {r.d for r in got} == {4}


def test_unlisted_entities_are_no_rows_of_a_space(spark):
    triples = spark.createDataFrame([(e, i, float(e + i + 1)) for e in range(4) for i in range(3)], "entity int, item int, rate double")
    listed = spark.range(3).select(F.col("id").cast("int").alias("entity"))
    space = FeatureSpace.from_triples(triples, listed)
    assert sorted(r.entity for r in space.full.collect()) == [0, 1, 2]


@pytest.mark.parametrize("tail", [",(2,'b", ",(2,'b');x", ",(2,'b')) ;", " and more"])
def test_cut_off_dump_raises(spark, tail):
    lines = spark.createDataFrame([(f"INSERT INTO `t` VALUES (1,'a'){tail}",)], "value string")
    with pytest.raises(Exception, match="outside the rows"):
        dump.dump_rows(lines, "t", ["id", "text"]).collect()


@pytest.mark.parametrize("end", ["", ";", " ; ", ", (2,'b');"])
def test_whole_dump_is_read(spark, end):
    lines = spark.createDataFrame([(f"INSERT INTO `t` VALUES (1,'a'){end}",)], "value string")
    assert dump.dump_rows(lines, "t", ["id", "text"]).count() == (2 if "b" in end else 1)


def test_code_of_an_unlisted_entity_raises(spark):
    labels = spark.createDataFrame([("UT", 0), ("PR", 0)], "entity string, label int")
    with pytest.raises(Exception, match="no ordinal for entity PR"):
        clusters.cluster_ids(labels, clusters.state_ordinals(spark)).collect()


@pytest.mark.parametrize("rows", [[("a", 0), ("b", 0)], [("a", 0), ("a", 1)], [("a", 0), ("b", 2)]])
def test_bad_ordinals_raise(spark, rows):
    ordinals = spark.createDataFrame(rows, "entity string, ord int")
    labels = spark.createDataFrame([("a", 0)], "entity string, label int")
    with pytest.raises(ValueError, match="once, from 0 on"):
        clusters.cluster_ids(labels, ordinals)


def test_items_with_small_gaps_keep_their_spread(spark):
    cells = [(e, 0, 1e7 + e) for e in range(3)] + [(e, 1, 5.0) for e in range(3)] + [(0, 2, 5.0)]
    triples = spark.createDataFrame(cells, "entity int, item int, rate double")
    got = {(r.entity, r.item): r.rate for r in pairs.scale_by_deviation(triples, 3).collect()}
    assert {i for _, i in got} == {0, 2}  # item 1 has one value only, item 2 differs from its zeros
    assert got[1, 0] - got[0, 0] == pytest.approx(1.0)
    assert got[0, 2] == pytest.approx(5.0 / (25 / 3) ** 0.5)


def test_scores_do_not_change_with_a_shift(spark):
    points = [(i, float(i % 2) * 10 + (i // 2) * 0.5, i % 2) for i in range(12)]
    scores = []
    for shift in (0.0, 1e8):
        triples = spark.createDataFrame([(e, 0, x + shift) for e, x, _ in points] + [(e, 1, 1.0) for e, _, _ in points], "entity int, item int, rate double")
        labels = spark.createDataFrame([(e, c) for e, _, c in points], "entity int, label int")
        scores.append(
            (
                evaluation.calinski_harabasz(triples, labels).first()["calinski_harabasz"],
                evaluation.within_sum_of_squares(triples, labels).first()["inertia"],
            )
        )
    assert scores[1] == pytest.approx(scores[0], rel=1e-6)


def test_stored_matrix_follows_its_inputs(spark):
    tables = commands.Tables("w_events", "w_entities", "w_items", "w_matrix")
    spark.createDataFrame([("x", 1)], "entity string, weight long").write.mode("overwrite").saveAsTable("w_entities")
    spark.createDataFrame([(1, "t")], "item long, title string").write.mode("overwrite").saveAsTable("w_items")
    for n in (1, 5):
        spark.range(n).select(F.lit(1).cast("long").alias("item"), F.lit("x").alias("entity")).write.mode("overwrite").saveAsTable("w_events")
        assert [r.rate for r in commands.engagement_matrix(spark, tables).collect()] == [1000.0 * n]
    for t in ("w_events", "w_entities", "w_items", "w_matrix"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def test_fingerprint_tells_rows_apart(spark):
    def mark(rows, schema="a string, b string"):
        return catalog.fingerprint_text({"t": spark.createDataFrame(rows, schema)})

    assert mark([("a|b", "c")]) != mark([("a", "b|c")])
    assert mark([(None, "c")]) != mark([("null", "c")]) != mark([("", "c")])
    assert mark([("a", "b"), ("c", "d")]) == mark([("c", "d"), ("a", "b")])
    assert mark([([1, 2],)], "a array<int>") != mark([([1, 3],)], "a array<int>")


def test_wide_tables_take_every_item(spark):
    items = spark.createDataFrame([(i,) for i in "cab"] + [("a",), (None,)], "item string")
    assert rates.pivot_items(items) == ["a", "b", "c"]
    spark.conf.set("spark.sql.pivotMaxValues", "2")
    try:
        with pytest.raises(ValueError, match="more than 2"):
            rates.pivot_items(items)
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def test_a_scan_keeps_its_tasks(spark):
    plan = spread_rows(spark.range(0, 100, 1, 4), 100)._jdf.queryExecution().toString()
    assert "Coalesce" not in plan and spread_rows(spark.range(100), 100).rdd.getNumPartitions() == 1


def test_every_row_can_be_a_first_centre(spark):
    """A far blob whose rows are among the last of any hash order still gets its own cluster."""
    from pulsegrid.operators.kmeans import fit_many

    n = 5000
    order = F.xxhash64("entity", F.lit(3))
    near = spark.range(n).select(F.col("id").cast("int").alias("entity"))
    late = [r.entity for r in near.orderBy(order, "entity").collect()][-4:]
    far = F.when(F.col("entity").isin(late), 1e6).otherwise(0.0)
    rows = near.select("entity", F.array(far + F.col("entity") % 7, F.lit(0.0)).alias("features")).repartition(6)
    fitted = fit_many(rows, [2], 3, restarts=2)[2]
    assert fitted.converged
    assert sorted(c[0] > 5e5 for c in fitted.centres.tolist()) == [False, True]


def test_round_limit_is_reported(spark):
    from pulsegrid.operators.kmeans import fit_many

    rows = spark.range(200).select("id", F.array((F.col("id") * F.col("id")).cast("double")).alias("features"))
    with pytest.warns(UserWarning, match="still moved"):
        assert not fit_many(rows.withColumnRenamed("id", "entity"), [5], 0, restarts=1, max_iter=1)[5].converged


def lda_docs(spark, count):
    word = F.col("id") % 5
    text = F.concat(F.lit("common w"), word, F.lit(" w"), word, F.lit(" v"), word)
    return spark.range(count).select(F.col("id").alias("doc"), text.alias("text"))


def test_lda_reads_every_document_once_per_pass(spark):
    from pulsegrid.operators import lda, terms

    tracker = spark.sparkContext.statusTracker()
    jobs = []
    for count in (450, 4500):
        docs = lda_docs(spark, count)
        vocab = terms.fit_vocabulary(docs)
        seen = {}
        spark.sparkContext.setJobGroup(f"lda-{count}", "")
        fitted = lda.fit(
            terms.count_vectors(docs, vocab), len(vocab.terms), 5, count, passes=3,
            on_update=lambda turn, update, n: seen.setdefault((turn, update), n),
        )
        jobs.append(len(tracker.getJobIdsForGroup(f"lda-{count}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(seen) == 3 * lda.UPDATES
        assert all(sum(n for (t, _), n in seen.items() if t == turn) == count for turn in range(3))
        assert fitted.documents == [count] * 3
        assert fitted.weights.shape == (5, len(vocab.terms)) and (fitted.weights > 0).all()
        assert fitted.likelihoods[-1] > fitted.likelihoods[0]
    assert jobs[0] == jobs[1]  # the number of jobs does not depend on the documents


def test_lda_models_together_are_those_one_by_one(spark):
    import numpy as np

    from pulsegrid.operators import lda, terms

    corpora = [lda_docs(spark, 300), lda_docs(spark, 120).withColumn("text", F.concat("text", F.lit(" other thing")))]
    vocabs = [terms.fit_vocabulary(d, max_df=1.0) for d in corpora]
    counts = [terms.count_vectors(d, v) for d, v in zip(corpora, vocabs)]
    sizes = [len(v.terms) for v in vocabs], [300, 120]
    together = lda.fit_many(
        counts[0].withColumn("model", F.lit(0)).unionByName(counts[1].withColumn("model", F.lit(1))), sizes[0], 3, sizes[1]
    )
    for one, width, documents, found in zip(counts, *sizes, together):
        alone = lda.fit(one, width, 3, documents)
        assert np.allclose(alone.weights, found.weights, rtol=1e-6) and alone.documents == found.documents


def test_singular_start_is_no_worse_than_a_random_one(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from pulsegrid.operators import nmf

    rng = np.random.default_rng(4)
    data = rng.random((60, 3)) @ rng.random((3, 25)) * (rng.random((60, 25)) < 0.8)
    rows = [(i, Vectors.sparse(25, [(j, float(x)) for j, x in enumerate(r) if x])) for i, r in enumerate(data)]
    vectors = spark.createDataFrame(rows, ["doc", "features"])
    singular = nmf.factorise(vectors, 25, 3)
    random = nmf.factorise(vectors, 25, 3, start="random")
    assert singular.objective[-1] <= random.objective[-1] * 1.01
    assert (singular.topics >= 0).all()
    with pytest.warns(UserWarning, match="still moved"):
        nmf.factorise(vectors, 25, 3, tol=-1.0, max_iter=2)


def test_lda_expectation_works_on_the_terms_of_a_document_only():
    import tracemalloc

    import numpy as np

    from pulsegrid.operators import lda

    rng = np.random.default_rng(5)
    width, lengths = 20_000, np.array([3, 0, 40, 1, 7] * 20, np.int32)
    indices = np.concatenate([rng.choice(width, n, replace=False) for n in lengths]).astype(np.int32)
    values = rng.integers(1, 5, len(indices)).astype(float)
    word_weights = np.exp(lda._expected_log(rng.gamma(100.0, 0.01, (3, width))))
    tracemalloc.start()
    sums, likelihood, words = lda.expectation(lengths, indices, values, word_weights, 0.3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4 << 20  # the dense rows of these documents alone have 16 MB
    want, said = np.zeros((3, width)), 0.0
    for stop, n in zip(np.cumsum(lengths), lengths):  # one document after the other
        own, counts = indices[stop - n : stop], values[stop - n : stop]
        here, gamma = word_weights[:, own], np.ones(3)
        for _ in range(100):
            theta = np.exp(lda._expected_log(gamma))
            new = 0.3 + theta * (here @ (counts / (theta @ here)))
            gamma, moved = new, np.abs(new - gamma).mean()
            if moved < 1e-3:
                break
        theta = np.exp(lda._expected_log(gamma))
        want[:, own] += here * np.outer(theta, counts / (theta @ here))
        said += (counts * np.log(theta @ here)).sum()
    assert np.allclose(sums, want, rtol=1e-8, atol=1e-12)
    assert np.isclose(likelihood, said) and words == values.sum()
