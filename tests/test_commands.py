import numpy as np
import pytest

from pulsegrid.functions.base58 import STATE_ORDER
from pulsegrid.operators import clusters
from pulsegrid.plans import commands
from pulsegrid.sources import catalog

STATES = STATE_ORDER[:8]


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    """Small CSV inputs in the stated layouts: two blocs of states with different tastes."""
    folder = tmp_path_factory.mktemp("inputs")
    rng = np.random.default_rng(1)
    lines = []
    for i, state in enumerate([*STATES, "DC"]):
        for n in range(60):
            item = rng.integers(0, 4) + (4 if i % 2 else 0)
            lines.append(f"{len(lines)},p{item},signature,AB,0{i}{n % 3}00,2014")
    lines.append("x,p1,signature,ZZ,99999,2014")  # unknown place
    files = {
        "events": "\n".join(lines),
        "locations": "Place,Postal Code,State Abbreviation\n"
        + "\n".join(f"Town,0{i}{z}00,{s}" for i, s in enumerate([*STATES, "DC"]) for z in range(3)),
        "weights": "name,abb,population\n" + "\n".join(f"n,{s},{1000 + i}" for i, s in enumerate([*STATES, "DC"])),
        "groups": "\n".join(f"{s},a,b,c,{'R+5' if i % 2 else 'D+3'}" for i, s in enumerate([*STATES, "DC"])),
        "items": "\n".join(
            f'1,p{i},x,"Title {i // 2}, theme{"ab"[i // 4]}","body words number{i} theme{"ab"[i // 4]} shared"' for i in range(8)
        ),
    }
    paths = {}
    for name, text in files.items():
        path = folder / f"{name}.csv"
        path.write_text(text + "\n")
        paths[name] = str(path)
    return paths


TABLES = commands.Tables("t_events", "t_entities", "t_items", "t_matrix")


@pytest.fixture(scope="module")
def loaded(spark, inputs):
    assert commands.load_tables(spark, **inputs, tables=TABLES)
    return spark


def test_load_types_exclusion_and_skip(loaded, inputs):
    entities = loaded.table("t_entities")
    assert dict(entities.dtypes) == {"entity": "string", "weight": "bigint", "party": "string"}
    assert {r["entity"] for r in entities.collect()} == set(STATES)
    assert {r["party"] for r in entities.collect()} == {"R", "D"}
    assert loaded.table("t_events").count() == 540  # the unknown place is gone, DC is still here
    assert not commands.load_tables(loaded, **inputs, tables=TABLES)
    assert commands.load_tables(loaded, **inputs, tables=TABLES, force=True, spread_events=True)
    assert loaded.table("t_events").count() == 540
    assert {"t_events", "t_items"} <= set(catalog.table_names(loaded))


def test_missing_tables_are_named(spark):
    with pytest.raises(catalog.MissingTables, match="nowhere"):
        catalog.require_tables(spark, ["nowhere"])
    assert catalog.check_writable(spark)


def test_matrix_is_stored_and_reused(loaded):
    first = commands.engagement_matrix(loaded, TABLES, force=True).count()
    assert loaded.catalog.tableExists("t_matrix") and first == loaded.table("t_matrix").count()
    assert {r["entity"] for r in loaded.table("t_matrix").select("entity").distinct().collect()} == set(STATES)


def test_fingerprint_ignores_order_and_sees_changes(spark):
    rows = [(i, None if i % 3 else str(i)) for i in range(50)]
    one = spark.createDataFrame(rows, "a int, b string")
    two = spark.createDataFrame(rows[::-1], "a int, b string").repartition(5)
    other = spark.createDataFrame([*rows[:-1], (49, "")], "a int, b string")
    prints = [tuple(catalog.table_fingerprint(df).first()) for df in (one, two, other)]
    assert prints[0] == prints[1] != prints[2]


def test_rebuild_only_when_inputs_change(spark):
    calls = []

    def build(df):
        calls.append(1)
        return df

    one, two = spark.range(5), spark.range(6)
    for source in (one, one, two, two):
        got = catalog.load_or_build(spark, "t_reuse", lambda: build(source), {"source": source})
    assert len(calls) == 2 and got.count() == 6


def test_project_cluster_evaluate(loaded):
    points = commands.project(loaded, show_groups=True, tables=TABLES).collect()
    assert len(points) == 8 and {r["colour"] for r in points} == {"red", "blue"}
    report = commands.cluster(loaded, 2, seed=1, tables=TABLES)
    labels = [(r["entity"], r["label"]) for r in report.labels.collect()]
    assert [e for e, _ in labels] == sorted(STATES)
    found = dict(labels)
    assert len({found[s] for s in STATES[::2]}) == 1 and found[STATES[0]] != found[STATES[1]]
    legend = report.legend.collect()
    assert [r["cluster_no"] for r in legend] == [1, 2]
    assert report.map_table.count() == 8 and report.seed == 1
    scores = commands.evaluate(loaded, 2, 3, seed=1, tables=TABLES).collect()
    assert scores[0]["value"] > scores[1]["value"] > -1


def test_top_items_and_topics(loaded):
    code = next(
        r["cluster_id"] for r in commands.cluster(loaded, 2, seed=1, tables=TABLES).legend.collect()
    )
    best = commands.top_items(loaded, code, 3, body=True, tables=TABLES)
    assert best.columns == ["title", "signatures", "body"] and best.count() == 2  # titles merge in pairs
    counts = [r["signatures"] for r in best.collect()]
    assert counts == sorted(counts, reverse=True) and sum(counts) == 240
    everyone = loaded.createDataFrame([(s, 0) for s in STATES], "entity string, label int")
    code = clusters.cluster_ids(everyone, clusters.state_ordinals(loaded)).first()["cluster_id"]
    got = commands.topic_extraction(loaded, [code], "nmf", 2, 2, stop_words=[], tables=TABLES)
    assert got.columns == ["cluster_id", "topic", "rank", "term", "weight"]
    rows = got.collect()
    assert {r["cluster_id"] for r in rows} == {code} and {r["term"] for r in rows} == {"themea", "themeb"}
    with pytest.raises(ValueError):
        commands.top_items(loaded, "0OIl", tables=TABLES)
