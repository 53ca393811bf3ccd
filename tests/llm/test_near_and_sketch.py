import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from pulsegrid.llm import simhash, sketch

from .test_exact_and_mixing import prose


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(values, radius=3):
    """Smallest reachable value, by looking at all pairs."""
    values = sorted(set(values))
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {v: root(v) for v in values}


def near_values(seed, centres, each):
    rng = random.Random(seed)
    out = []
    for _ in range(centres):
        value = rng.getrandbits(64)
        for _ in range(each):
            out.append(value)
            for _ in range(rng.randint(1, 3)):
                value ^= 1 << rng.randrange(64)
    return out


def signed(values):
    return np.array(values, np.uint64).view(np.int64).tolist()


def test_links_keep_all_groups(spark):
    values = near_values(1, 12, 25) + [0, (1 << 64) - 1, 7, 56]
    distinct = spark.createDataFrame([(v,) for v in set(signed(values))], "fp long")
    want = linked(values)
    for size in (simhash.TREE_SIZE, 3):  # one tree for each shard, and many trees for a hot one
        edges = simhash.links(distinct, tree_size=size)
        labels = {r.node: r.label for r in simhash.components(edges).collect()}
        groups = defaultdict(set)
        for v in set(values):
            groups[labels.get(signed([v])[0], signed([v])[0])].add(v)
        by_hand = defaultdict(set)
        for v, r in want.items():
            by_hand[r].add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, by_hand.values()))


def test_a_dense_group_gives_few_links(spark):
    values = [sum(1 << b for b in bits) for bits in [(i, j) for i in range(30) for j in range(i)]]
    distinct = spark.createDataFrame([(v,) for v in values], "fp long")
    assert simhash.links(distinct).count() <= 11 * len(values)


def test_bk_tree_finds_all_within(spark):
    values = sorted(set(near_values(2, 20, 10)))
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[::7] + [0]:
        for radius in (0, 1, 3):
            got = sorted(tree.values[i] for i in tree.within(q, radius))
            assert got == [v for v in values if (v ^ q).bit_count() <= radius]
    assert list(simhash.BKTree().within(3, 3)) == []


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    edges = spark.createDataFrame(chain + star + [(5, 5), (2000, 1999)], "a long, b long")
    labels = {r.node: r.label for r in simhash.components(edges).collect()}
    assert {labels[i] for i in range(61)} == {0}
    assert {labels[1000 + i] for i in range(300)} == {1000}
    assert labels[2000] == labels[1999] == 1999
    assert simhash.components(edges.limit(0)).count() == 0


def near_rows():
    base = prose(3, 3000)
    words = base.split()
    rows = [(10, base), (4, base + " one more"), (30, " ".join(words[:1500] + ["swap"] + words[1501:]))]
    rows += [(50, None), (51, ""), (49, " \t"), (60, "two words"), (61, "TWO words"), (None, "two  words")]
    rows += [(70, prose(70, 40)), (70, prose(70, 40)), (None, prose(71, 40)), (1, "Ä Ä Ä b"), (2, "ä ä ä b")]
    return rows


def test_groups_as_by_hand(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, fp long, id long")
    got = sorted([tuple(r) for r in simhash.near_duplicate_groups(docs).collect()], key=repr)
    prints = [fingerprint(t or "") for _, t in rows]
    root = linked(prints)
    lowest = {}
    for (i, _), p in zip(rows, prints):
        known = lowest.setdefault(root[p], i)
        lowest[root[p]] = i if known is None else known if i is None else min(i, known)
    want = sorted([(i, f"{p:016x}", lowest[root[p]]) for (i, _), p in zip(rows, prints)], key=repr)
    assert got == want
    assert len({g[2] for g in got if g[0] in (10, 4, 30)}) == 1
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for *_, c in want if c is not None})
    assert ids.count(None) == 1
    assert simhash.near_duplicate_groups(docs.limit(0)).count() == 0


def test_very_long_text_is_hashed_in_parts():
    text = prose(8, 500) + " same words again" * 70_000
    assert simhash.fingerprint(text.encode()) == fingerprint(text)


def sketch_rows():
    rng = random.Random(4)
    rows = [(i, prose(i, rng.randint(0, 300))) for i in range(120)]
    rows += [(500, prose(3, 200)), (501, prose(3, 200)), (7000, "漢字 😀 é " * 50), (6000, None), (6001, "one two")]
    return rows


def test_edits_follow_descending_ids(spark):
    rows = sketch_rows()
    docs = spark.createDataFrame([(i, t, "x", True) for i, t in rows], "doc_id long, text string, block string, guest boolean")
    ids = sorted((i for i, _ in rows), reverse=True)
    text = {i: t or "" for i, t in rows}
    for per_block in (4000, 7):
        default, sketch.with_next.__defaults__ = sketch.with_next.__defaults__, (per_block,)
        try:
            got = {r.doc_id: r for r in sketch.fingerprints_and_edits(docs.repartition(5)).collect()}
        finally:
            sketch.with_next.__defaults__ = default
        assert len(got) == len(rows)
        for k, i in enumerate(ids):
            own, following = text[i], text[ids[(k + 1) % len(ids)]]
            half = len(own) // 2
            edited = own[: len(own) - half] + following[:half]
            assert got[i].n_chars == len(own)
            assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
        assert got[500].fingerprint == got[501].fingerprint and got[501].near_next == 1.0


def test_sketch_is_what_it_says(spark):
    rows = [(1, prose(1, 2000)), (2, " ".join(prose(1, 2000).split()[:1000])), (3, prose(9, 2000)), (4, ""), (5, "a b")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r for r in df.select("id", sketch.shingle_hashes(df.text).alias("all"), sketch.sketch(df.text).alias("s")).collect()}
    for r in got.values():
        lowest = min(r["all"], key=lambda h: h % (1 << 64))
        assert r.s == sorted({h for h in r["all"] if 0 <= h < 1 << 61} | {lowest})
    assert len(got[1]["all"]) == 1996 and len(got[4].s) == 1
    text = dict(rows)
    pairs = spark.createDataFrame([(x, y, text[x], text[y]) for x in text for y in text], "x long, y long, s string, t string")
    near = {(r.x, r.y): r.n for r in pairs.select("x", "y", sketch.containment(sketch.sketch(pairs.s), sketch.sketch(pairs.t)).alias("n")).collect()}
    assert near[1, 2] > 0.95 and near[2, 1] == near[1, 2] and near[1, 1] == 1 and near[1, 3] < 0.05


def test_sketches_merge(spark):
    a, b = prose(1, 600), prose(2, 80)
    df = spark.createDataFrame([(a, b)], "a string, b string")
    merged = sketch.merge(sketch.sketch(df.a), sketch.sketch(df.b))
    both = sketch.F.array_distinct(sketch.F.concat(sketch.shingle_hashes(df.a), sketch.shingle_hashes(df.b)))
    got, hashes = df.select(merged, both).first()
    lowest = min(hashes, key=lambda h: h % (1 << 64))
    assert got == sorted({h for h in hashes if 0 <= h < 1 << 61} | {lowest})


def test_sketch_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "no id"), (None, "nor here"), (3, "x y"), (3, "x y")], "doc_id long, text string")
    assert sketch.fingerprints_and_edits(docs).count() == 4
    assert sketch.fingerprints_and_edits(docs.where("doc_id is null")).count() == 2
    assert sketch.fingerprints_and_edits(docs.limit(0)).count() == 0
    one = sketch.fingerprints_and_edits(docs.where("doc_id = 3").limit(1)).first()
    assert one.near_next == 1.0


def test_blocks_are_cut_at_counted_places(spark, monkeypatch):
    """Null, repeated and outlying ids, and rows repeated more often than a block has rows."""
    monkeypatch.setattr(sketch, "COPIES", 4)
    monkeypatch.setattr(sketch.with_next, "__defaults__", (5,))
    rows = [(i, prose(i, 30)) for i in range(40)] + [(1 << 60, prose(99, 30)), (-(1 << 63), "far"), ((1 << 63) - 1, None)]
    rows += [(None, prose(200 + i, 20)) for i in range(17)] + [(7, prose(300 + i, 20)) for i in range(16)]
    rows += [(12, prose(12, 30))] * 18 + [(1000 + i, prose(i, 25)) for i in range(12) for _ in range(4)] + [(None, "twice over")] * 9 + [(3, prose(3, 30))] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    laid, _ = sketch.with_next(docs)
    assert max(r["count"] for r in laid.groupBy("block").count().collect()) <= 3 * 5 + 2
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in sketch.fingerprints_and_edits(docs).collect()), key=repr)
    ties = docs.select("doc_id", "text", sketch.F.xxhash64(sketch.whole_text()).alias("tie")).collect()
    order = sorted(ties, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.tie))
    want = []
    for row, after in zip(order, order[1:] + order[:1]):
        own, following = row.text or "", after.text or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        want.append((row.doc_id, len(own), hashlib.sha256(edited.encode()).hexdigest()))
    assert got == sorted(want, key=repr)
