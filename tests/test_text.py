import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.text import words
from pulsegrid.operators import nmf, terms, topics

TEXTS = ["Cats and cats, a DOG!", "cats eat_fish été", "the dog eats fish", "", None]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc int, text string")


def test_words(spark):
    got = [r[0] for r in docs(spark).select(words(F.col("text"), ["and"])).collect()]
    assert got == [["cats", "cats", "dog"], ["cats", "eat_fish", "été"], ["the", "dog", "eats", "fish"], [], []]


def test_term_counts(spark):
    got = {(r["doc"], r["term"]): r["n"] for r in terms.term_counts(docs(spark), ["and", "the"]).collect()}
    assert got == {
        (0, "cats"): 2, (0, "dog"): 1, (1, "cats"): 1, (1, "eat_fish"): 1, (1, "été"): 1,
        (2, "dog"): 1, (2, "eats"): 1, (2, "fish"): 1,
    }


def test_vocabulary_pruning_and_ties(spark):
    texts = ["aa bb cc dd", "aa bb cc", "aa bb cc", "aa ee ee ee"]
    every = terms.vocabulary(docs(spark, texts), max_df=0.95, min_df=2).collect()
    assert [(r["idx"], r["term"], r["n"], r["df"]) for r in every] == [(0, "bb", 3, 3), (1, "cc", 3, 3)]
    first = terms.vocabulary(docs(spark, texts), max_df=0.95, min_df=2, max_features=1).collect()
    assert [r["term"] for r in first] == ["bb"]
    with pytest.raises(ValueError):
        terms.fit_vocabulary(docs(spark, ["one text", "other words"]))


def test_tfidf_formula(spark):
    texts = ["aa bb bb", "aa cc", "bb cc cc", "dd"]
    vocab = terms.fit_vocabulary(docs(spark, texts), min_df=1, max_df=1.0)
    rows = terms.vector_terms(terms.tfidf_vectors(docs(spark, texts), vocab), vocab).collect()
    got = {(r["doc"], r["term"]): r["weight"] for r in rows}
    idf = np.log(5 / 3) + 1
    row = np.array([1 * idf, 2 * idf])
    assert [got[0, "aa"], got[0, "bb"]] == pytest.approx(list(row / np.linalg.norm(row)))
    assert got[3, "dd"] == pytest.approx(1.0)


def test_corpus_leaves_nulls_out(spark):
    df = spark.createDataFrame([(1, "Title", "body"), (2, "Only", None)], "item int, title string, body string")
    assert [tuple(r) for r in terms.corpus(df).collect()] == [(1, "Title body"), (2, "Only")]


def mixed(n=60):
    rng = np.random.default_rng(0)
    sets = [["tax", "money", "budget", "debt"], ["forest", "river", "animal", "climate"]]
    return [" ".join(rng.choice(sets[i % 2], 12)) for i in range(n)]


@pytest.mark.parametrize("method", ["lda", "nmf"])
def test_topics_separate_two_themes(spark, method):
    got = topics.topics(docs(spark, mixed()), method, 2, 4).collect()
    found = {}
    for r in got:
        found.setdefault(r["topic"], []).append((r["rank"], r["term"]))
        assert r["weight"] >= 0
    assert {r["rank"] for r in got} == {1, 2, 3, 4}
    sets = sorted(sorted(term for _, term in ranked) for ranked in found.values())
    assert sets == [["animal", "climate", "forest", "river"], ["budget", "debt", "money", "tax"]]


def test_one_topic(spark):
    got = topics.topics(docs(spark, mixed()), "lda", 1, 3).collect()
    assert len(got) == 3 and {r["topic"] for r in got} == {0}


def test_topic_options(spark):
    for options in ({"method": "lsa"}, {"number_of_topics": 0}, {"words_per_topic": 0}):
        with pytest.raises(ValueError):
            topics.topics(docs(spark, mixed()), **options)
    with pytest.raises(ValueError):
        topics.topics_per_cluster({})


def test_nmf_objective_falls_and_factors_are_not_negative(spark):
    rng = np.random.default_rng(3)
    data = rng.random((30, 2)) @ rng.random((2, 12))
    from pyspark.ml.linalg import Vectors

    rows = [(i, Vectors.sparse(12, {j: float(x) for j, x in enumerate(row)})) for i, row in enumerate(data)]
    vectors = spark.createDataFrame(rows, ["doc", "features"]).repartition(4)
    got = nmf.factorise(vectors, 12, 2, tol=1e-7, max_iter=30)
    assert (got.topics >= 0).all()
    assert all(b <= a + 1e-9 for a, b in zip(got.objective, got.objective[1:])) and len(got.objective) > 2
    # the reported objective is the stated one
    l1 = l2 = 0.05
    w = nmf.descend(np.zeros((30, 2)), got.topics @ got.topics.T, data @ got.topics.T, l1, l2, 200)
    h = got.topics
    direct = 0.5 * ((data - w @ h) ** 2).sum() + l1 * (w.sum() + h.sum()) + 0.5 * l2 * ((w**2).sum() + (h**2).sum())
    assert direct == pytest.approx(got.objective[-1], rel=1e-3)
    exact = nmf.factorise(vectors, 12, 2, alpha=0.0, tol=1e-9, max_iter=40)
    assert exact.objective[-1] < 0.01 * 0.5 * (data**2).sum()
