"""Registered queries against DuckDB on the smallest tables (tools/check.py runs all of them)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
SOME = [
    "rates",
    "matrix_pivot",
    "top_items",
    "top_items_multi",
    "members_of_id",
    "pair_stats",
    "silhouette_jaccard",
    "calinski_harabasz_vectors",
    "compact_distances",
    "vocabulary",
    "tfidf",
    "dump_rows_html",
    "table_fingerprint",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the given tables are not here")


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) >= 85


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["cluster_id", "rank", "title", "signatures", "body"]
    assert df.count() > 0


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in os.listdir(SF_DIR):
        connection.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    return connection


def canon(value):
    return repr(round(value, 9) + 0.0) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", SOME)
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    relation = duck.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(relation.columns) == columns
    order = [relation.columns.index(c) for c in columns]
    want = sorted(tuple(canon(r[i]) for i in order) for r in relation.fetchall())
    got = sorted(tuple(canon(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == want
