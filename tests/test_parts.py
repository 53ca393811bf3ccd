"""Fingerprints of stored tables that are kept file by file."""

import os
from urllib.parse import unquote, urlparse

import pytest
from pyspark.sql import functions as F

from pulsegrid.plans import commands
from pulsegrid.sources import catalog


@pytest.fixture
def events(spark):
    name = "p_events"
    for t in (name, catalog.parts_table(name)):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    rows = spark.range(0, 300, 1, 3).select("id", (F.col("id") % 3).cast("string").alias("entity"))
    catalog.write_table(rows, name, "entity")
    yield name
    for t in (name, catalog.parts_table(name)):
        spark.sql(f"DROP TABLE IF EXISTS {t}")


def files_of(spark, name):
    paths = [r["path"] for r in catalog.table_files(spark, catalog.table_location(spark, name)).collect()]
    return [unquote(urlparse(p).path) for p in paths]


def made_unreadable(paths):
    """The same size and time of change, but whoever opens the file fails."""
    for path in paths:
        stat = os.stat(path)
        with open(path, "r+b") as file:
            file.write(b"\0" * stat.st_size)
        os.utime(path, ns=(stat.st_atime_ns, stat.st_mtime_ns))
        folder, base = os.path.split(path)
        crc = os.path.join(folder, f".{base}.crc")
        if os.path.exists(crc):
            os.remove(crc)


def print_of(spark, name):
    return tuple(catalog.stored_fingerprint(spark, name).first())


def test_same_as_of_the_whole_table(spark, events):
    assert print_of(spark, events) == tuple(catalog.table_fingerprint(spark.table(events)).first())
    spark.sql(f"INSERT INTO {events} VALUES (1000, 'new value / here'), (1, '1')")
    assert print_of(spark, events) == tuple(catalog.table_fingerprint(spark.table(events)).first())
    assert print_of(spark, events)[0] == 302


def test_noted_files_are_not_opened_again(spark, events):
    first = print_of(spark, events)
    made_unreadable(files_of(spark, events))
    with pytest.raises(Exception):
        catalog.table_fingerprint(spark.table(events)).collect()
    assert print_of(spark, events) == first
    spark.sql(f"INSERT INTO {events} VALUES (1000, '1')")
    second = print_of(spark, events)  # opens the new file alone
    assert second[0] == 301 and second[1] != first[1]


def test_changed_and_removed_files_count(spark, events):
    before = print_of(spark, events)
    rows = [(r.id if r.id != 7 else 8, r.entity) for r in spark.table(events).collect()]
    catalog.write_table(spark.createDataFrame(rows, "id long, entity string"), events, "entity")
    after = print_of(spark, events)
    assert after[0] == before[0] and after[1] != before[1]
    assert after == tuple(catalog.table_fingerprint(spark.table(events)).first())
    assert spark.table(catalog.parts_table(events)).count() == len(files_of(spark, events))
    spark.sql(f"ALTER TABLE {events} DROP PARTITION (entity = '2')")
    assert print_of(spark, events) == tuple(catalog.table_fingerprint(spark.table(events)).first())


def test_empty_tables_views_and_other_columns(spark, events):
    spark.sql(f"TRUNCATE TABLE {events}")
    assert print_of(spark, events) == print_of(spark, events) == (0, "0-0")
    spark.range(4).createOrReplaceTempView("p_view")
    assert print_of(spark, "p_view") == tuple(catalog.table_fingerprint(spark.range(4)).first())
    spark.catalog.dropTempView("p_view")


def test_matrix_is_reused_without_reading_events(spark):
    tables = commands.Tables("r_events", "r_entities", "r_items", "r_matrix")
    rows = spark.range(40).select((F.col("id") % 4).alias("item"), F.lit("x").alias("entity"))
    catalog.write_table(rows, tables.events)
    catalog.write_table(spark.createDataFrame([("x", 1)], "entity string, weight long"), tables.entities)
    catalog.write_table(spark.createDataFrame([(1, "t")], "item long, title string"), tables.items)
    first = sorted(commands.engagement_matrix(spark, tables).collect())
    asked = []
    real = catalog.write_table
    catalog.write_table = lambda df, name, *more: (asked.append(name), real(df, name, *more))
    try:
        assert sorted(commands.engagement_matrix(spark, tables).collect()) == first and not asked
        spark.sql(f"INSERT INTO {tables.events} VALUES (1, 'x')")
        again = {r["item"]: r["rate"] for r in commands.engagement_matrix(spark, tables).collect()}
    finally:
        catalog.write_table = real
    assert again[1] == 11_000.0 and again[0] == 10_000.0
    assert asked == [catalog.parts_table(tables.events), tables.matrix]
    for t in (*tables.loaded, tables.matrix, catalog.parts_table(tables.events), catalog.parts_table(tables.entities)):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
