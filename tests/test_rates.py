import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import attributes, outliers, ranking, rates
from pulsegrid.settings import checked_small


@pytest.fixture
def events(spark):
    rows = [("AL", "p1")] * 3 + [("AL", "p2")] + [("AK", "p1")] * 2 + [("DC", "p1")] * 5
    return spark.createDataFrame(rows, "entity string, item string")


def test_rate_per_thousand_and_unlisted_entities(spark, events):
    entities = spark.createDataFrame([("AL", 2000), ("AK", 500)], "entity string, weight long")
    got = {(r["entity"], r["item"]): r["rate"] for r in rates.engagement_rates(events, entities).collect()}
    assert got == {("AL", "p1"): 1.5, ("AL", "p2"): 0.5, ("AK", "p1"): 4.0}


def test_missing_or_zero_weight_rates_zero(spark, events):
    entities = spark.createDataFrame([("AL", None), ("AK", 0)], "entity string, weight long")
    assert {r["rate"] for r in rates.engagement_rates(events, entities).collect()} == {0.0}


def test_pivot_fills_zeros(spark, events):
    entities = spark.createDataFrame([("AL", 1000), ("AK", 1000)], "entity string, weight long")
    triples = rates.engagement_rates(events, entities)
    for items in (None, ["p1", "p2"]):
        rows = {r["entity"]: (r["p1"], r["p2"]) for r in rates.rate_matrix(triples, items).collect()}
        assert rows == {"AL": (3.0, 1.0), "AK": (2.0, 0.0)}
    vector = {r["entity"]: list(r["features"]) for r in rates.rate_vectors(triples, ["p1", "p2"]).collect()}
    assert vector == {"AL": [3.0, 1.0], "AK": [2.0, 0.0]}


def test_locating_drops_unknown_and_does_not_multiply(spark):
    raw = spark.createDataFrame([("01234", "p1"), ("99999", "p1")], "location string, item string")
    lookup = spark.createDataFrame([("01234", "MA"), ("01234", "MA")], "location string, entity string")
    assert [tuple(r) for r in rates.locate_events(raw, lookup).collect()] == [("p1", "MA")]
    assert tuple(rates.location_report(raw, lookup).first()) == (1, 1, 1)


def test_excluded_entities(spark):
    df = spark.createDataFrame([("DC", 1), ("AL", 2)], "entity string, weight long")
    assert [r["entity"] for r in attributes.exclude_entities(df, ["DC"]).collect()] == ["AL"]
    assert attributes.exclude_entities(df, []).count() == 2


def items(spark):
    rows = [("p1", "Same", "low"), ("p2", "Same", "high"), ("p3", "Other", None)]
    return spark.createDataFrame(rows, "item string, title string, body string")


def test_titles_merge_and_ties_break_by_title(spark):
    rows = [("AL", "p2")] * 2 + [("AL", "p1")] + [("AL", "p3")] * 3 + [("AK", "p3")] * 9
    events = spark.createDataFrame(rows, "entity string, item string")
    got = [tuple(r) for r in ranking.top_items(events, items(spark), ["AL"], 10).collect()]
    assert got == [("Other", 3, None), ("Same", 3, "low")]
    by_item = ranking.top_items(events, items(spark), ["AL"], 2, by="item").collect()
    assert [(r["title"], r["signatures"], r["body"]) for r in by_item] == [("Other", 3, None), ("Same", 2, "high")]
    assert ranking.top_items(events, items(spark), None, 1, body=False).columns == ["title", "signatures"]
    with pytest.raises(ValueError):
        ranking.top_items(events, items(spark), ["AL"], 0)


@pytest.mark.parametrize("n", [3, 1500])
def test_top_per_group_is_exact_on_a_hot_group(spark, n):
    df = spark.range(5000).select(
        F.when(F.col("id") < 4500, "hot").otherwise("cold").alias("g"), (F.col("id") * 7919 % 5003).alias("v")
    )
    got = ranking.top_per_group(df, ["g"], [F.desc("v")], n).collect()
    rows = df.collect()
    for group in ("hot", "cold"):
        want = sorted((r["v"] for r in rows if r["g"] == group), reverse=True)[:n]
        assert [r["v"] for r in sorted(got, key=lambda r: r["rank"]) if r["g"] == group] == want


def test_term_ties_go_to_the_later_index(spark):
    rows = [(0, "a", 0, 1.0), (0, "b", 1, 1.0), (0, "c", 2, 0.5)]
    weights = spark.createDataFrame(rows, "topic int, term string, idx int, weight double")
    got = ranking.top_terms(weights, 2).orderBy("rank").collect()
    assert [r["term"] for r in got] == ["b", "a"]


def test_zscore_is_strict_and_constant_columns_exclude_all(spark):
    df = spark.createDataFrame([(i, float(x), 1.0) for i, x in enumerate([-1, 1, -1, 1])], "entity int, x double, c double")
    assert [r["x_z"] for r in outliers.zscores(df, ["x"]).orderBy("entity").collect()] == [-1, 1, -1, 1]
    assert outliers.outlier_split(df, ["x"], 1.0)[0].count() == 0
    assert outliers.outlier_split(df, ["x"], 1.01)[0].count() == 4
    kept, out = outliers.outlier_split(df, ["x", "c"], 1.01)
    assert (kept.count(), out.count()) == (0, 4)
    assert outliers.outlier_split(df, ["x", "c"], 0.0)[0].count() == 4


def test_a_dimension_over_the_limit_is_not_pinned(spark):
    df = spark.range(5)
    assert checked_small(df, 4) is df
    pinned = checked_small(df, 5)
    assert sorted(r[0] for r in pinned.collect()) == list(range(5)) and pinned.schema == df.schema


def test_rates_with_a_shuffled_dimension_and_hot_keys(spark, monkeypatch):
    """A third of the events in one entity and one item, and weights too many to broadcast."""
    events = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).cast("int").alias("entity"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 70).cast("int").alias("item"),
    )
    entities = spark.range(50).select(F.col("id").cast("int").alias("entity"), (F.col("id") + 10).alias("weight"))
    got = {(r["entity"], r["item"]): r["rate"] for r in rates.engagement_rates(events, entities).collect()}
    monkeypatch.setattr(rates, "checked_small", lambda df, *a: df)
    again = {(r["entity"], r["item"]): r["rate"] for r in rates.engagement_rates(events, entities).collect()}
    want = {}
    for r in events.collect():
        want[tuple(r)] = want.get(tuple(r), 0) + 1
    want = {k: n * 1000 / (k[0] + 10) for k, n in want.items()}
    assert got == again and got == pytest.approx(want)


def test_hot_location_is_spread(spark):
    """Nine events in ten are at one location, and its lookup row is there twice."""
    place = F.when(F.col("id") % 10 < 9, F.lit("hot")).otherwise(F.concat(F.lit("p"), F.col("id") % 97))
    events = spark.range(40_000).select(place.alias("location"), (F.col("id") % 1009).alias("item"))
    known = [("hot", "A"), ("hot", "B")] + [(f"p{i}", "AB"[i % 2]) for i in range(90)]
    lookup = spark.createDataFrame(known, "location string, entity string").repartition(4)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = rates.locate_events(events, lookup, salts=256).withColumn("task", F.spark_partition_id())
        sizes = sorted(r["count"] for r in found.groupBy("task").count().collect())
        assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = {}
    entity = dict(reversed(known))
    for i in range(40_000):
        location = "hot" if i % 10 < 9 else f"p{i % 97}"
        if location in entity:
            key = entity[location], i % 1009
            want[key] = want.get(key, 0) + 1
    got = {(r["entity"], r["item"]): r["n"] for r in rates.located_counts(events, lookup).collect()}
    assert got == want
