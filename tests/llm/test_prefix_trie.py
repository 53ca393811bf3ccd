"""The prefix trie against a dictionary of prefixes."""

import hashlib
import random
import re
import zlib

import pytest

from pulsegrid.llm import prefix_trie

COLUMNS = "conv_id long, turn long, role string, text string, sequence string, name string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], COLUMNS)


def brute(rows):
    """Nodes as a dictionary of prefixes of rebuilt conversations."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda t: t[:2])
    members = {}
    for conv in own:
        h = zlib.crc32(str(conv).encode()) % 4
        turns = [t[2:] for t in own.get(conv - conv % 20, [])[:h] + own[conv][h:]]
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append((conv, d == len(turns)))
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    sums = {}
    for path in sorted(members, key=len, reverse=True):
        below = children.get(path, [])
        leaves = sum(sums[c][0] for c in below) or 1
        words = len(re.findall("[^\x20\x09-\x0d]+", path[-1][1])) if path else 0
        sums[path] = leaves, sum(sums[c][1] for c in below) + (len(members[path]) - 1) * words
    found = []
    for path, convs in members.items():
        ended = ",".join(str(c) for c in sorted(c for c, last in convs if last))
        found.append(
            (
                min(convs)[0],
                len(path),
                min(members[path[:-1]])[0] if path else None,
                len(convs),
                len(children.get(path, [])),
                *sums[path],
                hashlib.sha256(ended.encode()).hexdigest(),
            )
        )
    return sorted(found, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def conversations(seed, count, roles=("user", "assistant"), pool=6, longest=9):
    pick = random.Random(seed)
    rows = []
    for conv in pick.sample(range(count * 2), count):
        for turn in range(pick.randint(1, longest)):
            text = pick.choice(["same", f"text {pick.randrange(pool)} of  more\n words", "", f"{pick.randrange(pool)}"])
            rows.append((conv, turn, roles[turn % len(roles)], text))
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("per_task", [3, 17, 1000])
def test_same_nodes_as_a_dictionary(spark, per_task):
    rows = conversations(per_task, 150)
    df = prefix_trie.trie(prefix_trie.rebuilt(table(spark, rows).repartition(4)), per_task)
    assert got(df) == brute(rows)


def test_nulls_repeats_and_turnless(spark):
    rows = [
        (0, 1, "user", "b c"),
        (0, None, "user", "a"),  # null first
        (0, 1, "user", "b c"),  # a repeated row is a turn of its own
        (1, 0, None, None),
        (2, 0, "", ""),  # as null
        (3, 0, "user", None),
        (4, None, None, "x y z"),
        (None, 0, "user", "no conversation"),
        (1000003, 5, "user", "no base"),  # h may exceed its turns: then it has none
        (21, 7, "us", "er a"),
        (23, 7, "user", " a"),  # not the same as the one before
        (41, 0, "user", "w " * 20_000),
        (45, 0, "user", "w " * 20_000),
    ]
    rows += [(c, 0, "user", "turn") for c in range(60, 130)]
    assert got(prefix_trie.conversation_trie(table(spark, rows))) == brute(rows)
    assert any(n[1] == 0 and n[7] != prefix_trie.NO_ENDS for n in brute(rows))  # a turnless one is among them


def test_hot_conversation_and_long_ones(spark):
    """A third of all conversations is one sequence, another third shares its first turn; one is very long."""
    rows = []
    for c in range(600):
        rows += [(c, 0, "user", "hello there"), (c, 1, "assistant", "hi"), (c, 2, "user", f"{c}" if c % 3 else "bye")]
        if c % 3 == 1:
            rows += [(c, 3 + k, "user", f"{c // 30} {k}") for k in range(4)]
    rows += [(2001, k, "user", f"{k % 7} words") for k in range(1500)] + [(2002, k, "user", f"{k % 7} words") for k in range(900)]
    df = prefix_trie.trie(prefix_trie.rebuilt(table(spark, rows).repartition(16)), per_task=40, turns_per_task=500)
    assert got(df) == brute(rows)


def test_empty_table_and_one_row(spark):
    assert got(prefix_trie.conversation_trie(table(spark, []))) == []
    rows = [(7, 0, "user", "only")]
    assert got(prefix_trie.conversation_trie(table(spark, rows))) == brute(rows)


def test_ends_of_many_blocks(spark):
    ids = [c * 1000 + 7 for c in range(300)] + [-5, -5000]
    members = spark.createDataFrame([(b"n", c) for c in ids] + [(b"m", 1)], "name binary, conv_id long").repartition(7)
    want = hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    found = {bytes(r.name): r.ends for r in prefix_trie.ends(members).collect()}
    assert found == {b"n": want, b"m": hashlib.sha256(b"1").hexdigest()}


def sequence(*turns):
    return b"".join(t.encode().ljust(prefix_trie.DIGEST, b".") + (3).to_bytes(4, "big") for t in turns)


def test_merges_create_branching_nodes_only_where_neighbours_part():
    keys = sorted([sequence("a", "b", "c"), sequence("a", "b", "d"), sequence("a", "b"), sequence("e")])
    items = [(k, i, 1, 0, 0, 0, None) for i, k in enumerate(keys)]
    nodes, _ = prefix_trie.forest(items, True)
    prefix_trie.finish(nodes, keys)
    assert sorted((n.depth, n.convs, n.children, n.leaves, n.saved) for n in nodes) == [
        (0, 4, 2, 3, 12),
        (1, 1, 0, 1, 0),
        (1, 3, 1, 2, 12),
        (2, 3, 2, 2, 6),
        (3, 1, 0, 1, 0),
        (3, 1, 0, 1, 0),
    ]
    nodes, _ = prefix_trie.forest(items, False)
    prefix_trie.finish(nodes, keys)
    # Open are the prefixes of the first (a, b) and of the last sequence (e); what is below them is final.
    assert sorted((n.depth, n.convs, n.children) for n in nodes if n.open) == [(0, 0, 0), (1, 0, 0), (1, 1, 0), (2, 3, 2)]
    assert [prefix_trie.common_prefix(a, b) for a, b in zip(keys, keys[1:])] == [2, 2, 0]
