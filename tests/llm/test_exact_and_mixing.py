import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import mixing, recipes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Rows of (doc_id, text, source) as a documents table."""
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("aeiounrstld") for _ in range(rng.randint(1, 9))) for _ in range(words))


LONG = prose(1, 4000)
CASES = [
    (5, LONG, "a"),
    (3, LONG.replace(" ", "\t \n"), "b"),  # equal after blanks become one space
    (9, LONG[:-1] + "§", "a"),  # differs in its last chunk
    (8, LONG[1:], "a"),
    (7, None, None),
    (6, "", "b"),
    (4, " ", "b"),
    (2, "short", None),
    (2, "short", None),  # a repeated row
    (None, "short", "c"),
    (None, "nobody's", "c"),
    (None, "nobody's", "c"),
    (1, "x" * 50_000, "c"),  # no place to cut by content
]


def brute(rows):
    import re

    groups = defaultdict(list)
    for i, text, _ in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", text or "")].append(i)
    out = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        keep, done = min(known) if known else None, False
        for i in ids:
            kept = i == keep and not done
            done = done or kept
            out.append((i, keep, len(ids), kept))
    return sorted(out, key=repr)


def test_exact_duplicates_as_by_hand(spark):
    got = recipes.exact_duplicates(documents(spark, CASES).repartition(3))
    assert sorted([tuple(r)[:4] for r in got.collect()], key=repr) == brute(CASES)


def test_chunks_join_to_the_text_and_resist_shifts(spark):
    shifted = "An insertion in front. " + LONG
    df = spark.createDataFrame([(0, LONG), (1, shifted), (2, "")], "doc_id long, text string")
    got = {r[0]: r[1] for r in df.select("doc_id", recipes.chunks(recipes.normalised())).collect()}
    assert "".join(got[0]) == LONG and "".join(got[1]) == shifted and got[2] == [""]
    assert len(set(got[0]) & set(got[1])) >= len(got[0]) - 6 > 10


def test_identifiers_tell_colliding_digests_apart(spark):
    rows = [(1, bytearray(b"a")), (1, bytearray(b"b")), (2, bytearray(b"a")), (2, bytearray(b"a"))]
    df = spark.createDataFrame(rows, "short long, full binary")
    got = recipes.chunk_identifiers(df).collect()
    assert len(got) == 3 and len({r.chunk_id for r in got}) == 3
    assert {r.uses for r in got if r.short == 2} == {2}


def test_keep_first_keeps_all_columns_even_clashing_ones(spark):
    names = {"lang": "key", "source": "kept"}
    docs = documents(spark, CASES).withColumnsRenamed(names)
    kept = recipes.keep_first(docs)
    assert kept.columns == docs.columns
    # A group without any id keeps one row as well.
    want = sorted((i for i, _, _, k in brute(CASES) if k), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == want


def test_exact_duplicates_of_nothing(spark):
    assert recipes.exact_duplicates(documents(spark, [])).count() == 0
    assert recipes.keep_first(documents(spark, [])).count() == 0


def filled(sizes, weights):
    """Targets by resharing the excess round by round."""
    total, targets = 1.5 * sum(sizes), [0.0] * len(sizes)
    free = set(range(len(sizes)))
    left = total
    while True:
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] > 2 * sizes[i] + 1e-9]
        if not over:
            for i in free:
                targets[i] = share[i]
            return targets
        for i in over:
            targets[i] = 2.0 * sizes[i]
            left -= targets[i]
            free.discard(i)
        if not free:
            return targets


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 10, 10], [5, 0, 7, 900, 3, 3, 3], [10], [1000, 1, 1]])
def test_targets_are_what_resharing_comes_to(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    df = spark.createDataFrame(list(zip(names, sizes)), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    weights = [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sizes))]
    for name, want in zip(names, filled(sizes, weights)):
        assert math.isclose(got[name], want, rel_tol=1e-9, abs_tol=1e-9)


def mixed_rows():
    rng = random.Random(5)
    rows = [(i, prose(i, rng.randint(0, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    return rows + [rows[0], rows[0], (None, "no id here", "a"), (None, None, "b")]


def test_mix_meets_targets(spark):
    docs = documents(spark, mixed_rows())
    got = mixing.mix_documents(docs).collect()
    assert len(got) == 404
    taken, target = defaultdict(int), {}
    for r in got:
        words = r.epochs * r.size + r.rest
        assert 0 <= r.rest <= r.size and words <= 2 * r.size
        taken[r.target] += words
        target[r.target] = r.target
    assert all(abs(taken[t] - t) <= 1 for t in target)
    again = mixing.mix_documents(docs.repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)


def test_few_bins_give_the_same_mix(spark):
    sizes = mixing.sized(documents(spark, mixed_rows()))
    targets = mixing.source_targets(sizes)
    fine, coarse = (sorted(map(tuple, mixing.mix(sizes, targets, b).collect()), key=repr) for b in (1 << 16, 2))
    assert fine == coarse


def test_quality_weights_favour_documents(spark):
    rows = [(i, "one two three four", "a") for i in range(2000)] + [(5000, "x " * 4000, "b")]
    weights = spark.createDataFrame([(i, 9.0 if i < 500 else 1.0) for i in range(2000)], "doc_id long, weight double")
    got = mixing.mix_documents(documents(spark, rows), weights).where("doc_id < 2000").collect()
    epochs = {r.epochs for r in got}
    assert len(epochs) == 1
    part = sum(r.rest > 0 for r in got) / len(got)
    heavy = sum(r.rest > 0 for r in got if r.doc_id < 500) / 500
    assert part in (0.0, 1.0) or heavy > part


def test_repeat_documents_gives_whole_documents(spark):
    docs = documents(spark, mixed_rows())
    mixed = mixing.mix_documents(docs)
    got = mixing.repeat_documents(docs, mixed)
    assert got.columns == docs.columns
    texts = {(i, t) for i, t, _ in mixed_rows()}
    rows = got.collect()
    assert all((r.doc_id, r.text) in texts for r in rows)
    want = sum(r.epochs + (2 * r.rest >= max(r.size, 1)) for r in mixed.collect())
    assert len(rows) == want


def test_mix_of_nothing(spark):
    assert mixing.mix_documents(documents(spark, [])).count() == 0
    only_empty = mixing.mix_documents(documents(spark, [(1, "", "a"), (2, None, None)])).collect()
    assert [(r.epochs, r.rest) for r in only_empty] == [(0, 0), (0, 0)]


def test_word_counts_split_at_ascii_blanks_only(spark):
    df = spark.createDataFrame([("a b\x0bc\x1cd e",), ("",), (" \t",)], "text string")
    assert [r[0] for r in df.select(mixing.word_count(F.col("text"))).collect()] == [3, 0, 0]
