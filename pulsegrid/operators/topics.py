"""Topics of document groups: LDA on counts or NMF on tf-idf, as a ranked table of terms."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import spread_rows
from . import lda, nmf, terms
from .ranking import top_terms
from .terms import Vocabulary

METHODS = ("lda", "nmf")


def topic_terms(topic_weights: np.ndarray, vocab: Vocabulary, words_per_topic: int, spark) -> DataFrame:
    """``(topic, rank, term, weight)``; equal weights rank the later term first."""
    rows = [
        (t, term, i, float(weights[i])) for t, weights in enumerate(topic_weights) for i, term in enumerate(vocab.terms)
    ]
    weights = spark.createDataFrame(rows, "topic int, term string, idx int, weight double")
    return top_terms(weights, words_per_topic).select("topic", "rank", "term", "weight")


def _check(method: str, number_of_topics: int, words_per_topic: int) -> None:
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    if number_of_topics < 1 or words_per_topic < 1:
        raise ValueError("ask for at least one topic and one word")


def shares(weights: np.ndarray) -> np.ndarray:
    return weights / weights.sum(axis=1, keepdims=True)


def topics(
    docs: DataFrame,
    method: str = "lda",
    number_of_topics: int = 10,
    words_per_topic: int = 10,
    stop_words: Sequence[str] = (),
    updates: int = lda.UPDATES,
    passes: int = lda.PASSES,
    **limits,
) -> DataFrame:
    """Topics of ``docs(doc, text)`` with a vocabulary of their own: ``(topic, rank, term, weight)``.

    LDA reads every document ``passes`` times, each time in ``updates`` updates.
    """
    _check(method, number_of_topics, words_per_topic)
    vocab = terms.fit_vocabulary(docs, stop_words, **limits)
    spark = docs.sparkSession
    if method == "lda":
        counts = terms.count_vectors(docs, vocab, stop_words)
        if number_of_topics == 1:  # one topic is the term distribution
            return _single_topic(counts, vocab, words_per_topic)
        fitted = lda.fit(counts, len(vocab.terms), number_of_topics, vocab.documents, updates=updates, passes=passes)
        return topic_terms(shares(fitted.weights), vocab, words_per_topic, spark)
    vectors = spread_rows(terms.tfidf_vectors(docs, vocab, stop_words), vocab.documents)
    factors = nmf.factorise(vectors, len(vocab.terms), number_of_topics)
    return topic_terms(factors.topics, vocab, words_per_topic, spark)


def _single_topic(counts: DataFrame, vocab: Vocabulary, words_per_topic: int) -> DataFrame:
    totals = terms.vector_terms(counts, vocab, "n").groupBy("idx", "term").agg(F.sum("n").alias("n"))
    mass = totals.agg(F.sum("n")).scalar()
    weights = totals.select(F.lit(0).alias("topic"), "term", "idx", (F.col("n") / mass).alias("weight"))
    return top_terms(weights, words_per_topic).select("topic", "rank", "term", "weight")


def topics_per_cluster(corpora: dict[str, DataFrame], **options) -> DataFrame:
    """Side by side for a few clusters: ``(cluster_id, topic, rank, term, weight)``.

    LDA models of all clusters are fitted in the same jobs; other jobs of the clusters run next to each other.
    """
    if not corpora:
        raise ValueError("name at least one cluster")
    method, number = options.get("method", "lda"), options.get("number_of_topics", 10)
    _check(method, number, options.get("words_per_topic", 10))
    together = method == "lda" and number > 1 and len(corpora) > 1

    def one(entry: tuple[str, DataFrame]) -> DataFrame:
        cluster_id, docs = entry
        listed = topics(docs, **options)
        return listed.select(F.lit(cluster_id).alias("cluster_id"), "topic", "rank", "term", "weight")

    with ThreadPoolExecutor(max_workers=min(len(corpora), 8)) as pool:
        if together:
            listed = _lda_together(corpora, pool, **options)
        else:
            listed = list(pool.map(one, corpora.items()))
    return reduce(DataFrame.unionByName, listed)


def _lda_together(
    corpora: dict[str, DataFrame],
    pool: ThreadPoolExecutor,
    method: str = "lda",
    number_of_topics: int = 10,
    words_per_topic: int = 10,
    stop_words: Sequence[str] = (),
    updates: int = lda.UPDATES,
    passes: int = lda.PASSES,
    **limits,
) -> list[DataFrame]:
    """The same topics as one by one."""
    vocabs = list(pool.map(lambda docs: terms.fit_vocabulary(docs, stop_words, **limits), corpora.values()))
    counts = reduce(
        DataFrame.unionByName,
        (
            terms.count_vectors(docs, vocab, stop_words).withColumn("model", F.lit(m))
            for m, (docs, vocab) in enumerate(zip(corpora.values(), vocabs))
        ),
    )
    widths, documents = [len(v.terms) for v in vocabs], [v.documents for v in vocabs]
    fitted = lda.fit_many(counts, widths, number_of_topics, documents, updates=updates, passes=passes)
    return [
        topic_terms(shares(f.weights), vocab, words_per_topic, counts.sparkSession).select(
            F.lit(cluster_id).alias("cluster_id"), "topic", "rank", "term", "weight"
        )
        for cluster_id, vocab, f in zip(corpora, vocabs, fitted)
    ]
