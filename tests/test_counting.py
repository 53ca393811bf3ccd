"""NMF's steps at size: words counted for many texts at once, rows of W that come to rest each for itself."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import text as expressions
from pulsegrid.functions.text import words
from pulsegrid.operators import nmf, terms

STOP = ["the", "été"]
TEXTS = [
    "The cat, the CAT\tand_a dog's x 42 7", "Été à l'été – naïve ŒUVRE œuvre", "İstanbul ΣΟΦΟΣ ΣΟΦΟΣ, ½ ¾½ 漢字漢字",
    "", None, " \n", "x y z", "a\x1cbb\x00cc\x7fdd ee ff the", "été zwölf", "\U0001d7d8\U0001d7d9 \U0001f600\U0001f600 ok",
    "ࡰࡱ ᲉᲉ new",  # letters of a later Unicode than Spark's
]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc int, text string")


@pytest.mark.parametrize("at_once", [1, 40, 16 << 20])
def test_terms_are_those_of_the_word_expressions(spark, monkeypatch, at_once):
    monkeypatch.setattr(expressions, "_BYTES_AT_ONCE", at_once)
    docs = table(spark, TEXTS * 3).repartition(2)
    found = {r["doc"]: r["words"] for r in docs.select("doc", words(F.col("text"), STOP).alias("words")).collect()}
    every = sorted({w for ws in found.values() for w in ws})
    got = terms.vocabulary(docs, STOP, max_df=1.0, min_df=1).collect()
    want = [(w, sum(ws.count(w) for ws in found.values()), sum(w in ws for ws in found.values())) for w in every]
    assert sorted((r["term"], r["n"], r["df"]) for r in got) == want
    # terms that are stop words, single characters or in no text are never counted
    vocab = terms.Vocabulary([*every, "the", "x", "", "absent"], [1] * (len(every) + 4), len(found))
    rows = terms.count_vectors(docs, vocab, STOP).collect()
    assert len(rows) == len(found)
    for r in rows:
        counts = [float(found[r["doc"]].count(w)) for w in every] + [0.0] * 4
        assert r["features"].toArray().tolist() == counts


def test_every_letter_is_what_spark_takes_for_one(spark):
    texts = spark.createDataFrame(
        [(i, " ".join(chr(c) * 2 for c in range(i, min(i + 97, 0x110000)) if not 0xD800 <= c < 0xE000)) for i in range(0, 0x110000, 97)],
        "doc int, text string",
    )
    want = texts.select(F.explode(words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    got = terms.vocabulary(texts, max_df=1.0, min_df=1, max_features=1 << 21).select("term", "n")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert got.count() > 100_000


def test_rows_at_rest_are_not_worked_on():
    square = np.array([[1.0, 0.9999, 0.2], [0.9999, 1.0, 0.2], [0.2, 0.2, 1.0]])
    easy, slow = np.full((200_000, 3), -1.0), np.array([[0.9, 0.95, 0.3]])
    took = []
    for cross in (easy, np.vstack([easy, slow])):
        began = time.perf_counter()
        got = nmf.descend(np.zeros(cross.shape), square, cross, 0.0, 0.0, 1000)
        took.append(time.perf_counter() - began)
    assert (got[:-1] == 0).all()
    assert got[-1] == pytest.approx(nmf.descend(np.zeros((1, 3)), square, slow, 0.0, 0.0, 1000)[0], abs=1e-9)
    assert took[1] < 100 * took[0]  # 1000 rounds of all rows before
