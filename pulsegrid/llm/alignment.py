"""Alignment of two tokenizers' tokens by products of incidence matrices.

A token covers a range of bytes, so the tokens of a text are the rows of a sparse 0/1 matrix over its bytes.
With A and B for the two tokenizers, A times B transposed has an entry where two tokens overlap, and its
value is the number of shared bytes; the same product of last bytes tells which tokens end together. Places
where tokens of both end cut the tokens into groups; the product of the group incidences links all tokens
of a group. Matrices are in CSR (row starts, columns, values), written out here, and multiplied row by row:
a row of the product is the sum of the rows of the right matrix that the left row names (Gustavson).

Both tokenizers work on a text word by word: no token of either spans a place between a character that is
no blank and a following space, and the tokens on both sides do not depend on each other (``Aligner`` checks
the vocabulary for that). Such a unit therefore has the same tokens and links wherever it stands; a task
keeps those of units it has seen and puts texts together from them. The matrices of all new units of a
batch stand on one diagonal, so a batch needs one product of each kind.

Tokens that end together are suffixes of one another, so the pairs of ids that can be linked are a table
that follows from the two vocabularies (a few hundred thousand pairs, at most a vocabulary's tokens times
their length). Corpus counts have this size whatever the corpus has; they are summed in each task first and
are broadcast, one number for each pair.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import cut_lineage
from .bpe import _batches, _rows
from .chunk_bpe import Codec
from .common import released

UNIT = re.compile(r"(?<=[\w!-/:-@\[-`{-~])(?= )")
SAFE = re.compile(r"[\w!-/:-@\[-`{-~]\Z")
# Units that a task remembers (as many again while they were used lately), and the longest it does.
REMEMBERED, LONGEST = 200_000, 48
# Entries of a product that are expanded at once.
EXPANDED = 1 << 20
TEXTS_AT_ONCE = 64

Csr = tuple[np.ndarray, np.ndarray, np.ndarray]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, … for lengths[0] steps, then the same of the next."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def incidence(starts: np.ndarray, lengths: np.ndarray) -> Csr:
    """Rows that have a 1 in the columns starts[i] to starts[i] + lengths[i] - 1."""
    indptr = np.concatenate([[0], np.cumsum(lengths)])
    columns = ranges(starts, lengths)
    return indptr, columns, np.ones(len(columns), np.int64)


def transposed(matrix: Csr, columns: int) -> Csr:
    indptr, at, values = matrix
    rows = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    order = np.argsort(at, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=columns))])
    return starts, rows[order], values[order]


def product(left: Csr, right: Csr, columns: int) -> Csr:
    """left times right, by Gustavson's rows: every entry (i, k) of the left adds its multiple of row k of
    the right to row i. Rows are taken in blocks of about EXPANDED entries to be added."""
    indptr, at, values = left
    size = np.diff(right[0])
    work = np.concatenate([[0], np.cumsum(size[at])])[indptr]  # entries to be added before each row
    counts, found, sums = [np.zeros(1, np.int64)], [], []
    low, rows = 0, len(indptr) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(work, work[low] + EXPANDED, "right")) - 1)
        entries = slice(indptr[low], indptr[high])
        taken = size[at[entries]]
        terms = ranges(right[0][at[entries]], taken)
        row = np.repeat(np.repeat(np.arange(low, high), np.diff(indptr[low : high + 1])), taken)
        key = row * columns + right[1][terms]
        value = np.repeat(values[entries], taken) * right[2][terms]
        if np.any(key[1:] < key[:-1]):
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        found.append(key[first] % columns)
        sums.append(np.add.reduceat(value, first) if len(first) else value)
        counts.append(np.bincount(key[first] // columns - low, minlength=high - low))
        low = high
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, sums)]
    return np.cumsum(np.concatenate(counts)), *joined


def rows_of(matrix: Csr) -> np.ndarray:
    return np.repeat(np.arange(len(matrix[0]) - 1), np.diff(matrix[0]))


class Links:
    """The products for tokens given by their lengths in bytes; the tokens of both cover the same bytes."""

    def __init__(self, a_sizes: np.ndarray, b_sizes: np.ndarray):
        a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
        width = int(a_ends[-1]) if len(a_ends) else 0
        a, b = incidence(a_ends - a_sizes, a_sizes), incidence(b_ends - b_sizes, b_sizes)
        #: Overlapping tokens and the bytes they share.
        self.overlaps = product(a, transposed(b, width), len(b_sizes))
        one = np.ones(1, np.int64)
        last_a, last_b = incidence(a_ends - 1, np.repeat(one, len(a_ends))), incidence(b_ends - 1, np.repeat(one, len(b_ends)))
        #: Tokens that end together.
        self.together = product(last_a, transposed(last_b, width), len(b_sizes))
        cut = a_ends[rows_of(self.together)]
        self.groups = len(cut)
        self.a_group, self.b_group = np.searchsorted(cut, a_ends), np.searchsorted(cut, b_ends)

    def shared_groups(self) -> Csr:
        """Tokens of one group."""
        a = incidence(self.a_group, np.ones(len(self.a_group), np.int64))
        b = incidence(self.b_group, np.ones(len(self.b_group), np.int64))
        return product(a, transposed(b, self.groups), len(self.b_group))


class Aligner:
    """Tokens, links and groups of texts; ``a`` is the content of a byte-level BPE tokenizer file, ``b`` the
    bytes of a sentencepiece model."""

    def __init__(self, a: str, pattern: str, b: bytes):
        self.a = Codec(a, pattern, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece spans a space, so texts are not words with spaces before them")
        self.a_bytes = self.a.table
        self.b_bytes = {
            i: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        }
        self.a_size, self.b_size = sizes(self.a_bytes), sizes(self.b_bytes)
        # Ids as text with what may follow them: one of the same kind, one of the other kind, another unit.
        self.a_text = np.array([f"{i}{end}" for end in ",|" for i in range(len(self.a_size))], object)
        self.b_text = np.array([f"{i}{end}" for end in ",;\n" for i in range(len(self.b_size))], object)
        self.blank = len(self.b.encode("a"))
        self.recent: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}
        self.codes = pair_codes(self.a_bytes, self.b_bytes)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of both for a text that begins with a space; None if the tokens do not give its bytes."""
        if text.isspace():
            # The model puts a space before what it encodes, but none before blanks alone.
            b = self.b.encode("a" + text, num_threads=1)[self.blank :]
        else:
            b = self.b.encode(text[1:], num_threads=1)
        # Byte-level tokens give the bytes they were made from; the model's may not (a normaliser, U+2581).
        if b"".join(map(self.b_bytes.__getitem__, b)) != text.encode():
            return None
        return self.a.encode(text).astype(np.int64), np.array(b, np.int64)

    def learn(self, units: list[str]) -> dict[str, tuple | None]:
        """Of new units: (groups as text, pair positions as bytes, A tokens * 2**32 + B tokens)."""
        # Units that end as UNIT asks for are a text together; others are tokenised alone.
        plain = [u for u in units if SAFE.search(u)]
        joined = self.tokens("".join(plain)) if plain else None
        if joined is None:
            plain = []
        rest = set(units).difference(plain)
        alone = {u: self.tokens(u) for u in units if u in rest}
        made: dict[str, tuple | None] = {u: None for u in alone}
        good = [u for u, t in alone.items() if t is not None]
        found = [alone[u] for u in good]
        if joined is not None:
            found.insert(0, joined)
        if not found:
            return made
        a, b = (np.concatenate(x) for x in zip(*found))
        links = Links(self.a_size[a], self.b_size[b])
        at_a, at_b = rows_of(links.together), links.together[1]
        pairs = np.searchsorted(self.codes, a[at_a] << 32 | b[at_b]).astype("<i4").tobytes()
        # A unit's end is the end of tokens of both, so units have groups of their own.
        known = plain + good
        ends = np.cumsum([len(u.encode()) for u in known])
        a_end = np.searchsorted(np.cumsum(self.a_size[a]), ends) + 1
        b_end = np.searchsorted(np.cumsum(self.b_size[b]), ends) + 1
        group_end = links.a_group[a_end - 1] + 1
        texts = self.written(links, a, b, b_end).split("\n")
        counts = (np.diff(a_end, prepend=0) << 32) + np.diff(b_end, prepend=0)
        low = 0
        for unit, text, count, high in zip(known, texts, counts.tolist(), (4 * group_end).tolist()):
            made[unit] = text, pairs[low:high], count
            low = high
        return made

    def written(self, links: "Links", a: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> str:
        """Groups as ``a1,a2|b1;a3|b2,b3``, the groups of a unit on a line."""
        a_cut, b_cut = np.cumsum(np.bincount(links.a_group)), np.cumsum(np.bincount(links.b_group))
        a_kind, b_kind = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_kind[a_cut - 1] = 1
        b_kind[b_cut - 1] = 1
        b_kind[b_end - 1] = 2
        words = np.empty(len(a) + len(b), object)
        words[np.arange(len(a)) + np.concatenate([[0], b_cut])[links.a_group]] = self.a_text[a_kind * len(self.a_size) + a]
        words[np.arange(len(b)) + a_cut[links.b_group]] = self.b_text[b_kind * len(self.b_size) + b]
        return "".join(words.tolist())

    def units(self, texts: list[str | None]) -> list[list[tuple] | None]:
        """What is known of the units of each text, in order; None for texts without tokens."""
        split = [UNIT.split(" " + t) if t else [] for t in texts]
        recent, older, new = self.recent, self.older, []
        for unit in {u for units in split for u in units}:
            if unit not in recent:
                if unit in older:
                    recent[unit] = older[unit]
                else:
                    new.append(unit)
        recent.update(self.learn(new) if new else {})
        found = []
        for units in split:
            known = [recent[u] for u in units]
            found.append(known if known and None not in known else None)
        for unit in new:
            if len(unit) > LONGEST:
                del recent[unit]
        if len(recent) > REMEMBERED:
            self.recent, self.older = {}, recent
        return found


def sizes(table: dict[int, bytes]) -> np.ndarray:
    found = np.zeros(max(table) + 1, np.int64)
    for i, token in table.items():
        found[i] = len(token)
    return found


def pair_codes(a_bytes: dict[int, bytes], b_bytes: dict[int, bytes]) -> np.ndarray:
    """Sorted codes (a id * 2**32 + b id) of all pairs of tokens of which one is the end of the other."""
    found = set()
    for short, long, code in (
        (b_bytes, a_bytes, lambda s, x: x << 32 | s),
        (a_bytes, b_bytes, lambda s, x: s << 32 | x),
    ):
        ids: dict[bytes, list[int]] = {}
        for i, token in short.items():
            ids.setdefault(token, []).append(i)
        for x, token in long.items():
            for k in range(len(token)):
                for s in ids.get(token[k:], ()):
                    found.add(code(s, x))
    return np.array(sorted(found), np.int64)


@lru_cache(maxsize=1)
def aligner(a: str, pattern: str, b: bytes) -> Aligner:
    return Aligner(a, pattern, b)


def _vocabularies(spark, a: str, b: str):
    with open(a, encoding="utf-8") as one, open(b, "rb") as two:
        return spark.sparkContext.broadcast((one.read(), two.read()))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def _id_type(docs: DataFrame, id_col: str):
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    return kind.simpleString(), to_arrow_type(kind)


def align(docs: DataFrame, a: str, pattern: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The alignment of every text: id, a_ids, b_ids (arrays), groups (array of the token counts of A and B
    up to each group's end), overlaps (array of a, b, bytes: positions of overlapping tokens and the bytes
    they share), together (array of a, b: those that end together), grouped (array of a, b: those that share
    a group).

    ``a`` is the path of a byte-level BPE tokenizer file, ``b`` that of a sentencepiece model; A encodes
    the text with a space before it, B adds that space. Strings of special tokens are plain text. Null and
    empty texts, and texts whose tokens do not give their bytes, have empty arrays. Texts of any length stay
    in one task each; repeated rows stay; a null id stays null; other columns are not read; an empty table
    gives no rows.
    """
    files = _vocabularies(docs.sparkSession, a, b)
    id_type, arrow_id = _id_type(docs, id_col)
    pair = [("a", pa.int32()), ("b", pa.int32())]
    schema = pa.schema(
        [("id", arrow_id), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32()))]
        + [("groups", pa.list_(pa.struct(pair))), ("overlaps", pa.list_(pa.struct([*pair, ("bytes", pa.int32())])))]
        + [("together", pa.list_(pa.struct(pair))), ("grouped", pa.list_(pa.struct(pair)))]
    )

    def listed(matrix: Csr, values: bool = False):
        columns = [rows_of(matrix).tolist(), matrix[1].tolist()] + [matrix[2].tolist()] * values
        return [dict(zip(("a", "b", "bytes"), entry)) for entry in zip(*columns)]

    def run(batches):
        own = aligner(files.value[0], pattern, files.value[1])

        def aligned():
            for i, text in _rows(batches):
                found = own.tokens(" " + text) if text else None
                if found is None:
                    yield i, [], [], [], [], [], []
                    continue
                links = Links(own.a_size[found[0]], own.b_size[found[1]])
                cuts = (np.cumsum(np.bincount(g)).tolist() for g in (links.a_group, links.b_group))
                groups = [{"a": x, "b": y} for x, y in zip(*cuts)]
                ids = (x.tolist() for x in found)
                yield i, *ids, groups, listed(links.overlaps, True), listed(links.together), listed(links.shared_groups())

        yield from _batches(aligned(), schema)

    pairs = "array<struct<a:int,b:int>>"
    return _texts(docs, id_col, text_col).mapInArrow(
        released(run),
        f"id {id_type}, a_ids array<int>, b_ids array<int>, groups {pairs}, "
        f"overlaps array<struct<a:int,b:int,bytes:int>>, together {pairs}, grouped {pairs}",
    )


def linked_pairs(docs: DataFrame, a: str, pattern: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, groups_sha256, pairs of every text: pairs (binary) has the position of each
    link's ids in the table of possible pairs, as little-endian 32-bit integers (see ``pair_codes``)."""
    files = _vocabularies(docs.sparkSession, a, b)
    id_type, arrow_id = _id_type(docs, id_col)
    schema = pa.schema(
        [("id", arrow_id), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64())]
        + [("groups_sha256", pa.string()), ("pairs", pa.binary())]
    )

    def run(batches):
        own = aligner(files.value[0], pattern, files.value[1])

        def aligned():
            for batch in batches:
                for low in range(0, batch.num_rows, TEXTS_AT_ONCE):
                    part = batch.slice(low, TEXTS_AT_ONCE)
                    for i, known in zip(part.column(0).to_pylist(), own.units(part.column(1).to_pylist())):
                        if known is None:
                            yield i, 0, 0, 0, "", b""
                            continue
                        groups = ";".join([u[0] for u in known])
                        pairs = b"".join([u[1] for u in known])
                        n_a, n_b = divmod(sum([u[2] for u in known]), 1 << 32)
                        yield i, n_a, n_b, len(pairs) // 4, hashlib.sha256(groups.encode()).hexdigest(), pairs

        yield from _batches(aligned(), schema)

    return _texts(docs, id_col, text_col).mapInArrow(
        released(run), f"id {id_type}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary"
    )


def pair_counts(linked: DataFrame) -> DataFrame:
    """pair, links: how many links of all texts have each pair of ids. A task sums its texts first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS_AT_ONCE):
                joined = b"".join(batch.column(0).slice(low, TEXTS_AT_ONCE).to_pylist())
                counted = np.bincount(np.frombuffer(joined, "<i4"), minlength=len(total))
                counted[: len(total)] += total
                total = counted
        pair = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int32()), pa.array(total[pair], pa.int64())], ["pair", "links"])

    counted = linked.select("pairs").mapInArrow(run, "pair int, links long")
    return counted.groupBy("pair").agg(F.sum("links").alias("links"))


def alignment_counts(docs: DataFrame, a: str, pattern: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every text.

    A link joins two tokens that end together; its count is the number of links of all texts between the
    same two ids. n_best are the links whose count is the highest of their B id, ties included; count_sum
    adds up the counts. groups_sha256 is the digest of the groups' ids (``a1,a2|b1;a3|b2``), '' without
    tokens. Nulls, empty texts and so on as in ``align``.

    Every text is tokenised once; its links are written to the checkpoint folder as positions. The counts
    are one number for each possible pair of ids, bounded by the vocabularies, and are broadcast.
    """
    spark = docs.sparkSession
    linked = cut_lineage(linked_pairs(docs, a, pattern, b, id_col, text_col))
    files = _vocabularies(spark, a, b)
    codes = aligner(files.value[0], pattern, files.value[1]).codes
    links = np.zeros(len(codes), np.int64)
    for pair, count in pair_counts(linked).toLocalIterator():
        links[pair] = count
    of_b = codes & 0xFFFFFFFF
    highest = np.zeros(int(of_b.max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, of_b, links)
    table = spark.sparkContext.broadcast((links, links == highest[of_b]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = table.value
        for batch in batches:
            n_links, n_best, sums = [], [], []
            for pairs in batch.column("pairs"):
                at = np.frombuffer(pairs.as_buffer(), "<i4")
                n_links.append(len(at))
                n_best.append(int(np.count_nonzero(best[at])))
                sums.append(int(count[at].sum()))
            more = [pa.array(x, pa.int64()) for x in (n_links, n_best, sums)]
            names = ["id", "n_a", "n_b", "n_groups", "groups_sha256"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), *more], [*names, "n_links", "n_best", "count_sum"])

    id_type = linked.schema["id"].dataType.simpleString()
    return linked.mapInArrow(
        released(run),
        f"id {id_type}, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long",
    )
