"""Prefix trie of conversations by union-find over sorted neighbours.

Conversations become sequences of turn digests. In sorted order all conversations below a trie node stand
together, so the trie is decided by the common prefix lengths (LCP) of neighbours: taken in descending
depth, every edge between two neighbours merges two components, and a merge at depth d creates the
branching node at depth d (or joins the one that is there). Nodes with one child lie between a branching
node and its components.

Sorted sequences are dealt out by ranges. A task builds the forest of its range. What lies below no
prefix of its first or last sequence is final and leaves the task as nodes; the prefixes of those two may
go on in neighbouring ranges, so they are contracted: those that gathered something (members, finished
children) become prefix sequences with partial sums, and these are sorted and built again, ranges beside
each other merging where their prefixes agree, until one task holds all that is left. A round keeps at
most two paths of each task, so rounds shrink by thousands.

Texts never move: a turn is 20 bytes (digest and word count). Equal conversations are one sequence with
counts, summed map-side. Tasks are bounded by sequences (SEQUENCES), not by groups; the one long sequential
thing is the SHA-256 of the members that end at a node, which is streamed in blocks of ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import checked_small, cut_lineage
from .common import released, whole_text, word_count

# Sequences, and turns of them, that one task sorts and builds, roughly.
SEQUENCES, TURNS = 1 << 15, 1 << 18
# Conversation ids that one row holds when the ids of a node are listed.
BLOCK = 4096
# A turn: 16 bytes of digest, then its words as an unsigned 32-bit integer, big-endian.
TURN, DIGEST = 20, 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: of every conversation the turn records in the order of turn, null first.

    Null role or text becomes empty; equal turn numbers are ordered by the record. Rows without conv_id
    take no part.
    """
    role, text = whole_text("role"), whole_text("text")
    # The length tells where the role ends.
    said = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    record = F.concat(
        F.substring(F.sha2(said, 256), 1, 2 * DIGEST), F.lpad(F.hex(word_count(text)), 2 * (TURN - DIGEST), "0")
    )
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", record.alias("record"))
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "record"))).alias("list"))
    return listed.select("conv_id", F.col("list.record").alias("turns"))


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the one its group of 20 begins with: 0 to 3."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 4).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, sequence (binary): every conversation, its first turns replaced by those of the
    conversation conv_id - conv_id % 20 (all if it has fewer, none if there is none)."""
    turns = turns_of(conversations)
    heads = turns.where("conv_id % 20 = 0").select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head")
    )
    joined = turns.join(heads, F.col("base") == F.col("conv_id") - F.col("conv_id") % 20, "left")
    none = F.array().cast("array<string>")
    n = shared_turns(F.col("conv_id"))
    own = F.slice("turns", n + 1, F.greatest(F.size("turns") - n, F.lit(0)))
    sequence = F.concat(F.slice(F.coalesce("head", none), F.lit(1), n), own)
    return joined.select("conv_id", F.unhex(F.array_join(sequence, "")).alias("sequence"))


def ends(members: DataFrame) -> DataFrame:
    """name, ends: for each name of (name, conv_id) rows the SHA-256 of the ids, ascending, joined by commas.

    The ids of a name come in blocks of at most BLOCK, sorted by Spark, and are hashed one after the other,
    so a name that a third of all conversations share is a stream and not a list.
    """
    block = F.shiftright("conv_id", BLOCK.bit_length() - 1)
    blocks = members.groupBy("name", block.alias("block")).agg(
        F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )
    blocks = blocks.repartition("name").sortWithinPartitions("name", "block").select("name", "ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            names, hashes = [], []
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != current:
                    if state is not None:
                        names.append(current)
                        hashes.append(state.hexdigest())
                    current, state = name, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(hashes, pa.string())], ["name", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_pydict({"name": [current], "ends": [state.hexdigest()]})

    return blocks.mapInArrow(released(run), "name binary, ends string")


@dataclass(slots=True)
class Node:
    """A trie node while its forest is built. Sums hold what is attached here and what finished children
    handed up; ``item`` is a sequence below it."""

    depth: int
    item: int
    conv: int | None = None
    convs: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str | None = None
    parent: "Node | None" = None
    open: bool = False

    def attach(self, conv, convs, children, leaves, saved, ends=None) -> None:
        if conv is not None and (self.conv is None or conv < self.conv):
            self.conv = conv
        self.convs += convs
        self.children += children
        self.leaves += leaves
        self.saved += saved
        if ends is not None:
            self.ends = ends


def common_prefix(a: bytes, b: bytes) -> int:
    """Turns that two sequences have in common at the beginning."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * TURN : middle * TURN] == b[low * TURN : middle * TURN]:
            low = middle
        else:
            high = middle - 1
    return low


def forest(items: list[tuple], whole: bool) -> tuple[list[Node], list[Node]]:
    """The nodes of sorted (sequence, conv, convs, children, leaves, saved, ends) items, the deepest first,
    and the terminal node of each item. Unless the items are ``whole``, the prefixes of the first and the last are open."""
    keys = [item[0] for item in items]
    nodes: list[Node] = []
    terminals: list[Node] = []
    for i, (key, *sums) in enumerate(items):
        node = Node(len(key) // TURN, i)
        node.attach(*sums)
        nodes.append(node)
        terminals.append(node)
    top = list(terminals)  # of a component, at its root
    same: dict[int, Node] = {}  # nodes that a merge has joined to another one, by identity
    above = list(range(len(items)))

    def root(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    def raised(node: Node, depth: int) -> Node:
        """The component's node at a depth, with a chain of nodes of one child down to its top."""
        while node.depth > depth:
            node.parent = Node(node.depth - 1, node.item)
            node = node.parent
            nodes.append(node)
        return node

    shared = [common_prefix(a, b) for a, b in zip(keys, keys[1:])]
    for edge in sorted(range(len(shared)), key=shared.__getitem__, reverse=True):
        a, b = root(edge), root(edge + 1)
        left, right = raised(top[a], shared[edge]), raised(top[b], shared[edge])
        # Both are the node at this depth: one stays.
        left.attach(right.conv, right.convs, right.children, right.leaves, right.saved, right.ends)
        same[id(right)] = left
        above[b] = a
        top[a] = left
    raised(top[root(0)], 0)

    def kept(node: Node | None) -> Node | None:
        while node is not None and id(node) in same:
            node = same[id(node)]
        return node

    nodes = [n for n in nodes if id(n) not in same]
    for node in nodes:
        node.parent = kept(node.parent)
    if not whole:
        for node in (kept(terminals[0]), kept(terminals[-1])):
            while node is not None:
                node.open, node = True, node.parent
    nodes.sort(key=lambda n: -n.depth)
    return nodes, terminals


def finish(nodes: list[Node], keys: list[bytes]) -> None:
    """Hand the sums of finished nodes to their parents, the deepest first."""
    for node in nodes:
        if node.open:
            continue
        if node.children == 0:
            node.leaves = 1
        if node.depth:
            record = keys[node.item][(node.depth - 1) * TURN : node.depth * TURN]
            node.saved += (node.convs - 1) * int.from_bytes(record[DIGEST:], "big")
        if node.parent is not None:
            node.parent.attach(node.conv, node.convs, 1, node.leaves, node.saved)


NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, name binary, parent binary, sequence binary"
)
NODE_SCHEMA = pa.schema(
    [(n, pa.int64()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("name", pa.binary()), ("parent", pa.binary()), ("sequence", pa.binary())]
)


def name_of(prefix: bytes) -> bytes:
    return hashlib.blake2b(prefix, digest_size=16).digest()


def forests(items: DataFrame, whole: bool, again: bool) -> DataFrame:
    """The forest of every partition of sorted items: finished nodes (``sequence`` is null) and contracted
    open ones. Finished nodes below an open one name it as ``parent``; in later rounds (``again``) nodes
    have a name by which they are found."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            rows += zip(*(c.to_pylist() for c in batch.columns))
        if not rows:
            return
        keys = [row[0] for row in rows]
        nodes, _ = forest(rows, whole)
        finish(nodes, keys)
        held = []
        for node in nodes:
            prefix = keys[node.item][: node.depth * TURN]
            if node.open:
                if not (node.convs or node.children):
                    continue  # made again from the sequences below it
                held.append((node.conv, node.depth, None, node.convs, node.children, node.leaves, node.saved, node.ends, None, None, prefix))
            else:
                up = node.parent
                waits = up is not None and up.open
                held.append(
                    (
                        node.conv,
                        node.depth,
                        None if up is None or waits else up.conv,
                        node.convs,
                        node.children,
                        node.leaves,
                        node.saved,
                        node.ends or NO_ENDS,
                        name_of(prefix) if again else None,
                        name_of(keys[up.item][: up.depth * TURN]) if waits else None,
                        None,
                    )
                )
            if len(held) == 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), NODE_SCHEMA)], schema=NODE_SCHEMA)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), NODE_SCHEMA)], schema=NODE_SCHEMA)

    return items.mapInArrow(released(run), NODES)


def trie(sequences: DataFrame, per_task: int = SEQUENCES, turns_per_task: int = TURNS) -> DataFrame:
    """The prefix trie of (conv_id, sequence) rows, one for each conversation: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    A node is the set of sequences that begin with its turns; conv_id is the smallest of them, so conv_id
    and depth name a node. The root has depth 0 and no parent. An empty table gives no rows.
    """
    spark = sequences.sparkSession
    # Read by several uses; 20 bytes a turn.
    sequences = cut_lineage(sequences.withColumn("name", F.unhex(F.md5("sequence"))))
    items = sequences.groupBy("sequence", "name").agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("convs"))
    listed = ends(sequences.select("name", "conv_id")).withColumnRenamed("name", "of")
    zero = F.lit(0).cast("long")
    items = items.join(listed, F.col("name") == F.col("of")).select(
        "sequence", "conv", "convs", zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), "ends"
    )
    items = cut_lineage(items)
    again, rounds, before = False, [], 0
    while True:
        count, turns = items.agg(F.count(F.lit(1)), F.sum(F.octet_length("sequence")) / TURN).first()
        if not count:
            break
        tasks = max(-(-count // per_task), int((turns or 0) // turns_per_task))
        if not again:
            tasks = max(tasks, min(spark.sparkContext.defaultParallelism, count))
        else:
            tasks = max(1, min(tasks, before // 2))  # so that rounds end, however long the paths are
        before = tasks
        if tasks == 1:
            items = items.coalesce(1).sortWithinPartitions("sequence")
        else:
            items = items.repartitionByRange(tasks, "sequence").sortWithinPartitions("sequence")
        built = cut_lineage(forests(items, tasks == 1, again))
        rounds.append(built.where("sequence is null").drop("sequence"))
        if tasks == 1:
            break
        items = built.where("sequence is not null").select(
            "sequence", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
        )
        again = True
    if not rounds:
        return spark.createDataFrame([], NODES).drop("name", "parent", "sequence")
    nodes, *later = rounds
    for more in later:
        nodes = nodes.unionByName(more)
    if later:
        # Nodes below an open one learn its conversation from the round that finished it: of a task's nodes
        # two paths at most, so few that they are broadcast if a look at them shows it.
        late = later[0]
        for more in later[1:]:
            late = late.unionByName(more)
        late = checked_small(late.select(F.col("name").alias("known"), F.col("conv_id").alias("late_conv_id")))
        waiting = nodes.where("parent is not null").join(late, F.col("parent") == F.col("known"))
        waiting = waiting.withColumn("parent_conv_id", F.col("late_conv_id")).select(nodes.columns)
        nodes = nodes.where("parent is null").unionByName(waiting)
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations (see ``rebuilt`` and ``trie``)."""
    return trie(rebuilt(conversations))
