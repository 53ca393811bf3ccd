"""The pipeline on the smallest tables against the stages by hand, and queries against their SQL."""

import os
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pulsegrid.llm import toxicity
from pulsegrid.llm.common import table

from .test_near_and_sketch import fingerprint, linked

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")


def test_every_operator_is_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert names["pipeline"] is corpus_pipeline.run and 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("name", ["op6_exact_dedup", "op7_mixing", "op12_prefix_trie"])
def test_same_rows_as_sql(spark, name):
    duck = duckdb.connect()
    for file in os.listdir(SF_DIR):
        duck.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    df = entry.queries()[name](spark, SF_DIR)
    relation = duck.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns

    def canon(row, names):
        return tuple(repr(round(v, 6)) if isinstance(v, float) else repr(v) for v in (row[names.index(c)] for c in columns))

    assert sorted(canon(r, df.columns) for r in df.collect()) == sorted(canon(r, relation.columns) for r in relation.fetchall())


def test_stages_by_hand(spark):
    docs = table(spark, SF_DIR, "documents")
    rows = docs.collect()
    model = toxicity.train(docs, table(spark, SF_DIR, "labels"))
    clean = [r for r in rows if model.score(r.text or "") < 0.5]
    got = corpus_pipeline.drop_toxic(spark, docs, SF_DIR)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in clean)

    texts = {}
    for r in sorted(clean, key=lambda r: r.doc_id):
        texts.setdefault(re.sub("[\x20\x09-\x0d]+", " ", r.text or ""), r)
    got = corpus_pipeline.drop_copies(spark, spark.createDataFrame(clean, docs.schema), SF_DIR)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in texts.values())

    once = list(texts.values())
    prints = {r.doc_id: fingerprint(r.text or "") for r in once}
    root = linked(prints.values())
    first = {}
    for r in sorted(once, key=lambda r: r.doc_id):
        first.setdefault(root[prints[r.doc_id]], r.doc_id)
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(once, docs.schema), SF_DIR)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(first.values())


def test_run_encodes_what_the_mix_takes(spark):
    docs = table(spark, SF_DIR, "documents")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, SF_DIR)
        assert kept.columns == docs.columns
    want = Counter(r.doc_id for r in kept.collect())
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert Counter(r.doc_id for r in got) == want
    assert max(want.values()) == 2 and np.mean([r.n_tokens for r in got]) > 0
