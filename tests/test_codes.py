import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import base58
from pulsegrid.functions.base58 import STATE_ORDER, decode_positions, decode_sql, encode_sql
from pulsegrid.operators import attributes, clusters, ranking


def members(code):
    return [STATE_ORDER[i] for i in decode_positions(code, 50)]


def test_known_codes():
    assert members("27") == ["UT"]
    assert members("8y7nF3D1") == ["CO", "OH", "UT"]
    assert members("9nvUvJfca") == STATE_ORDER


@pytest.mark.parametrize("code", ["0", "O", "I", "l", "", "2 7", "zzzzzzzzzzz"])
def test_bad_codes_are_refused(code):
    with pytest.raises(ValueError):
        decode_positions(code, 50)


def test_expressions_invert_each_other(spark):
    masks = [1, 57, 58, 64, 17592186077248, 2**50 - 1, 2**62, 2**63 - 1]
    df = spark.createDataFrame([(m,) for m in masks], "mask long")
    df = df.withColumn("code", F.expr(encode_sql("mask"))).withColumn("back", F.expr(decode_sql("code")))
    rows = df.collect()
    assert all(r["mask"] == r["back"] for r in rows)
    codes = {r["mask"]: r["code"] for r in rows}
    assert codes[64] == "27" and codes[17592186077248] == "8y7nF3D1" and codes[2**50 - 1] == "9nvUvJfca"


def test_overflow_and_foreign_characters_decode_to_null(spark):
    df = spark.createDataFrame([("zzzzzzzzzzzz",), ("a0",), ("",)], "code string")
    assert [r[0] for r in df.select(F.expr(decode_sql("code"))).collect()] == [None, None, None]


def test_labels_to_codes_to_members(spark):
    ordinals = clusters.state_ordinals(spark)
    labels = [(s, i % 3) for i, s in enumerate(reversed(STATE_ORDER))]
    ids = clusters.cluster_ids(spark.createDataFrame(labels, "entity string, label int"), ordinals)
    back = clusters.cluster_members(ids.select("cluster_id"), ordinals).join(ids, "cluster_id")
    assert {(r["entity"], r["label"]) for r in back.collect()} == set(labels)
    some = ids.first()["cluster_id"]
    assert len(ranking.members_of(some, ordinals)) in (16, 17)


def test_bad_code_in_a_table_raises(spark):
    bad = spark.createDataFrame([("zzzzzzzzzzz",)], "cluster_id string")
    with pytest.raises(Exception, match="not a cluster code"):
        clusters.cluster_members(bad, clusters.state_ordinals(spark)).collect()


def test_more_entities_than_the_widest_code_are_refused(spark):
    ordinals = spark.range(base58.WIDEST + 1).select(F.col("id").alias("entity"), F.col("id").cast("int").alias("ord"))
    with pytest.raises(ValueError):
        clusters.cluster_ids(ordinals.select("entity", F.lit(0).alias("label")), ordinals)


def test_small_reports(spark):
    labels = spark.createDataFrame([("AL", 0), ("AK", 20), ("ZZ", 1)], "entity string, label int")
    regions = spark.createDataFrame([("AL",), ("AK",), ("WY",)], "entity string")
    rows = {r["entity"]: r for r in attributes.map_table(labels, regions).collect()}
    assert set(rows) == {"AL", "AK"}
    assert rows["AK"]["colour_hex"] == "#800000" and rows["AL"]["colour_name"] == "Red"
    ids = spark.createDataFrame([(0, "27"), (14, "28")], "label int, cluster_id string")
    assert [tuple(r) for r in attributes.legend(ids).orderBy("cluster_no").collect()] == [
        (1, "Red", "27"),
        (15, "Maroon", "28"),
    ]
    assert clusters.label_map(labels).first()["labels"] == {"AL": 0, "AK": 20, "ZZ": 1}
    assert [r[0] for r in clusters.distinct_labels(labels).collect()] == [0, 1, 20]


def test_group_colour(spark):
    df = spark.createDataFrame([("R",), ("D",), ("E",), (None,)], "party string")
    got = [r[0] for r in df.select(attributes.group_colour(F.col("party"))).collect()]
    assert got == ["red", "blue", "black", "black"]


def test_display_text(spark):
    df = spark.createDataFrame([("x" * 60,), ("y" * 50,)], "t string")
    assert [r[0] for r in df.select(attributes.display_text(F.col("t"))).collect()] == ["x" * 47 + "...", "y" * 50]
    assert df.select(attributes.display_text(F.col("t"), None)).first()[0] == "x" * 60


@pytest.mark.parametrize("width", [5, 63, 64, 100, 500])
def test_wide_codes_are_those_of_a_big_integer(spark, width):
    import random

    pick = random.Random(width)
    ordinals = spark.createDataFrame([(f"e{i}", i) for i in range(width)], "entity string, ord int")
    members = {0: [0], 1: [width - 1], 2: list(range(width))}
    members |= {k: pick.sample(range(width), pick.randint(1, width)) for k in range(3, 8)}
    labels = spark.createDataFrame([(f"e{i}", k) for k, m in members.items() for i in m], "entity string, label int")
    ids = clusters.cluster_ids(labels, ordinals)
    got = {r["label"]: r["cluster_id"] for r in ids.collect()}
    want = {k: base58.decimal_to_code(sum(1 << (width - 1 - i) for i in m)) for k, m in members.items()}
    assert got == want
    assert {k: base58.decode_positions(c, width) for k, c in got.items()} == {k: sorted(m) for k, m in members.items()}
    back = {}
    for r in clusters.cluster_members(ids.select("cluster_id").distinct(), ordinals).collect():
        back.setdefault(r["cluster_id"], []).append(int(r["entity"][1:]))
    assert {c: sorted(m) for c, m in back.items()} == {want[k]: sorted(m) for k, m in members.items()}


@pytest.mark.parametrize("code", ["0", "", base58.decimal_to_code(1 << 100), base58.decimal_to_code(1 << 140)])
def test_wide_codes_that_do_not_fit_raise(spark, code):
    ordinals = spark.createDataFrame([(i, i) for i in range(100)], "entity int, ord int")
    with pytest.raises(Exception, match="not a cluster code here"):
        clusters.cluster_members(spark.createDataFrame([(code,)], "cluster_id string"), ordinals).collect()


def test_codes_of_many_entities_whose_keys_have_gaps(spark):
    """More entities than a short code holds, numbered by their order, not by their keys."""
    rows = spark.range(9001).select((F.col("id") * 7 + 5).alias("entity"), (F.col("id") % 4).alias("label"))
    ordinals = clusters.numbered(rows.repartition(5))
    assert [r["ord"] for r in ordinals.orderBy("entity").collect()] == list(range(9001))
    ids = clusters.cluster_ids(rows, ordinals)
    got = {r["label"]: r["cluster_id"] for r in ids.collect()}
    assert got == {k: base58.decimal_to_code(sum(1 << (9000 - i) for i in range(k, 9001, 4))) for k in range(4)}
    back = clusters.cluster_members(ids.select("label", "cluster_id"), ordinals)
    assert sorted(back.select("label", "entity").collect()) == sorted(rows.select("label", "entity").collect())


@pytest.mark.parametrize("rows", [[(0, 0), (1, 2)], [(0, 0), (0, 1)], [(0, 0), (None, 1)]])
def test_large_ordinal_tables_are_checked(spark, monkeypatch, rows):
    monkeypatch.setattr(clusters, "SMALL_ROWS", 1)
    with pytest.raises(ValueError, match="number every entity once"):
        clusters._pinned(spark.createDataFrame(rows, "entity int, ord int"))
