"""Near-duplicates by SimHash, searched with BK-trees.

A fingerprint has a bit for each bit position that is set in over half of the text's shingle hashes.
Fingerprints that differ in at most RADIUS bits are linked, documents are grouped by the links.

Search. Two fingerprints at distance 3 or less agree on at least two of five blocks of bits, so the
distinct fingerprints are put into shards, one for every pair of blocks and value of it (ten for each
fingerprint). Each shard has BK-trees: a child hangs under its parent at their Hamming distance, and a
search follows only the edges within the radius around the distance it measured. A tree is sent to all
tasks that search it. A shard with more than TREE_SIZE fingerprints has several trees, and every pair of
(tree, block of searching fingerprints) is a task of its own, so no task holds a whole hot shard and no
link is lost. Trees travel by shard through a shuffle: the driver never sees fingerprints or links.

A search reports links that connect something new only (a union-find per tree), so a group of n
near copies gives about n links, not n * n.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..settings import cut_lineage
from .common import released, whole_text

SHINGLE = 3
RADIUS = 3
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
TREE_SIZE = 2048
SEED = 42
# Shingle hashes held at once while bits are counted.
HELD = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text: ASCII letters lower-cased, words between ASCII blanks; no words: 0."""
    words = text.lower().split()
    count = len(words) - shingle + 1
    if not words:
        return 0
    if count < 1:
        words, count, shingle = [b" ".join(words)], 1, 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, count, HELD):
        some = words[at : min(at + HELD, count) + shingle - 1]
        if shingle == 3:
            joined = [b"%b %b %b" % t for t in zip(some, some[1:], some[2:])]
        else:
            joined = [b" ".join(some[i : i + shingle]) for i in range(len(some) - shingle + 1)]
        hashes = np.fromiter((digest(s, SEED) for s in joined), np.uint64, len(joined))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << bit for bit in np.flatnonzero(2 * ones > count).tolist())


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and fp (the 64 bits as a signed long) of every row; null texts are empty."""
    schema = docs.select(*keep).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(found.view(np.int64))], names=[*keep, "fp"]
            )

    rows = docs.select(*keep, whole_text(text_col).alias("text_of"))
    return rows.mapInArrow(released(run), StructType([*schema.fields, StructField("fp", LongType())]))


class BKTree:
    """Distinct 64-bit integers; ``kids[i]`` maps a Hamming distance to the child of node i there."""

    def __init__(self):
        self.values: list[int] = []
        self.kids: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.kids.append({})
        at = 0
        while at < len(self.values) - 1:
            distance = (self.values[at] ^ value).bit_count()
            child = self.kids[at].get(distance)
            if child is None:
                self.kids[at][distance] = len(self.values) - 1
                return
            at = child

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Node numbers at most radius away."""
        if not self.values:
            return
        stack, values, kids = [0], self.values, self.kids
        while stack:
            at = stack.pop()
            distance = (values[at] ^ value).bit_count()
            if distance <= radius:
                yield at
            below = kids[at]
            if len(below) <= 2 * radius + 1:
                stack.extend(c for d, c in below.items() if -radius <= d - distance <= radius)
            else:
                stack.extend(below[d] for d in range(distance - radius, distance + radius + 1) if d in below)


def links_between(tree_values: list[int], others: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links that connect: within the tree's values (others None), or between them and the others."""
    tree = BKTree()
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    found = []

    def search(value: int) -> None:
        for node in tree.within(value, radius):
            a, b = root(value), root(tree.values[node])
            if a != b:
                parent[a] = b
                found.append((value, tree.values[node]))

    for value in tree_values:
        if others is None:
            search(value)
        tree.add(value)
    for value in others or ():
        search(value)
    return found


def shard_keys(fp: Column) -> Column:
    """The shards of a fingerprint: one string of bits for every pair of blocks, with the pair's number."""
    def bits(block: tuple[int, int]) -> Column:
        return F.shiftrightunsigned(fp, block[0]).bitwiseAND(F.lit((1 << block[1]) - 1))

    keys = [
        F.shiftleft(bits(a), 13).bitwiseOR(bits(b)).bitwiseOR(F.lit(n << 26))
        for n, (a, b) in enumerate(combinations(BLOCKS, 2))
    ]
    return F.array(*keys)


def links(distinct: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that hold the linked groups together."""
    if radius > 3:
        raise ValueError("five blocks of bits find distances up to 3")
    members = distinct.select("fp", F.explode(shard_keys(F.col("fp"))).alias("shard"))
    sizes = members.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = sizes.select(F.col("shard").alias("of"), F.ceil(F.col("n") / tree_size).cast("int").alias("trees"))
    members = members.join(sizes, F.col("shard") == F.col("of"))
    own = F.pmod(F.xxhash64("fp", "shard"), F.col("trees")).cast("int")
    members = members.select("fp", "shard", "trees", own.alias("own"))
    # Tree t meets the blocks t, t + 1, ...: as a tree in (t, u), as searching in (u, t) for u < t.
    as_tree = F.transform(
        F.sequence(F.col("own"), F.col("trees") - 1), lambda u: F.struct(F.col("own").alias("t"), u.alias("u"), F.lit(True).alias("in_tree"))
    )
    as_query = F.when(
        F.col("own") > 0,
        F.transform(
            F.sequence(F.lit(0), F.col("own") - 1), lambda t: F.struct(t.alias("t"), F.col("own").alias("u"), F.lit(False).alias("in_tree"))
        ),
    )
    empty = F.array().cast("array<struct<t:int,u:int,in_tree:boolean>>")
    roles = members.select("fp", "shard", F.explode(F.concat(as_tree, F.coalesce(as_query, empty))).alias("role"))
    roles = roles.select("shard", F.col("role.t").alias("t"), F.col("role.u").alias("u"), "fp", F.col("role.in_tree").alias("in_tree"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found):
            a, b = (np.array(x, np.uint64).view(np.int64) for x in (zip(*found) if found else ((), ())))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        current, tree, others, found = None, [], [], []

        def finish():
            t, u = current[1], current[2]
            found.extend(links_between(tree, None if t == u else others, radius))

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            keys = zip(*(c.tolist() for c in columns[:3]))
            values = columns[3].view(np.uint64).tolist()
            for key, value, in_tree in zip(keys, values, columns[4].tolist()):
                if key != current:
                    if current is not None:
                        finish()
                    current, tree, others = key, [], []
                (tree if in_tree else others).append(value)
            yield out(found)
            found.clear()
        if current is not None:
            finish()
            yield out(found)

    dealt = roles.repartition("shard", "t", "u").sortWithinPartitions("shard", "t", "u")
    return dealt.mapInArrow(released(run), "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, label: the smallest node that can be reached, for every node of a link (a, b).

    Stars on both sides by turns: each round hangs larger neighbours, then smaller ones, under the
    smallest neighbour. Minima are summed map-side, so a hub is no group in one task; each round is
    checkpointed. Raises if it has not come to rest after max_rounds.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    edges = cut_lineage(edges.where("a <> b").select(most.alias("a"), least.alias("b")).distinct())
    state = _state(edges)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("low"))
        low = low.select("of", F.least("of", "low").alias("low"))
        # Large star: every larger neighbour of a node goes under the node's smallest neighbour.
        large = both.where("b > a").join(low, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # Small star: a node and its smaller neighbours go under the smallest of them.
        low = large.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("low"))
        met = large.join(low, F.col("a") == F.col("of"))
        small = met.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            met.select("a", F.col("low").alias("b"))
        )
        edges = cut_lineage(small.where("a <> b").distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"links have not come to rest after {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Number of links and a digest of them all."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _group_labels(rows: DataFrame) -> DataFrame:
    """of, label: the group of every distinct fingerprint of rows (fp)."""
    per = rows.select("fp").distinct()
    labels = components(links(per))
    per = per.join(labels, F.col("fp") == F.col("node"), "left")
    return per.select(F.col("fp").alias("of"), F.coalesce("label", "fp").alias("label"))


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hexadecimal digits), component_id of every document.

    component_id is the smallest doc_id that links of at most RADIUS differing bits reach. Texts without
    words, null ones too, have fingerprint zero and are linked like any other. Rows without an id take
    part; component_id is null only where no row of the group has an id. Repeated rows stay; an empty
    table gives no rows; other columns are not read.
    """
    rows = cut_lineage(fingerprints(docs, ["doc_id"]))
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    per = cut_lineage(_group_labels(rows).join(first, F.col("of") == F.col("fp")).select("of", "label", "first_id"))
    lowest = per.groupBy(F.col("label").alias("group")).agg(F.min("first_id").alias("component_id"))
    per = per.join(lowest, F.col("label") == F.col("group")).select("of", "component_id")
    return rows.join(per, F.col("fp") == F.col("of")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The documents with one row left of each group, with all their columns: the smallest doc_id.

    Of several rows with that id, and of a group without ids, the one with the lowest text hash stays.
    """
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64(whole_text()).alias("tie"))
    rows = cut_lineage(fingerprints(docs.select(key.alias("key"), "text"), ["key"]))
    first = rows.groupBy("fp").agg(F.min("key").alias("key"))
    kept = first.join(_group_labels(rows), F.col("fp") == F.col("of")).groupBy("label").agg(F.min("key").alias("key"))
    kept = kept.select(_flat(F.col("key")).alias("kept"))
    once = Window.partitionBy("flat").orderBy("flat")
    keyed = docs.select(F.struct("*").alias("row"), _flat(key).alias("flat"))
    met = keyed.join(kept, F.col("flat") == F.col("kept"), "left_semi")
    return met.withColumn("n", F.row_number().over(once)).where("n = 1").select("row.*")


def _flat(key: Column) -> Column:
    """A key as one string, null ids included."""
    return F.concat_ws(":", F.coalesce(key["id"].cast("string"), F.lit("null")), key["no_id"].cast("string"), key["tie"].cast("string"))
