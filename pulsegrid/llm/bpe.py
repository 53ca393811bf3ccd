"""Byte-level BPE: encode by overlapping chunks, decode by concatenating raw bytes.

A text longer than CHUNK characters is cut into chunks that overlap by OVERLAP. The chunks are spread
over tasks by (document, chunk) and pre-tokenised independently; a chunk may start in the middle of a
word, so its first boundaries can be wrong. Two neighbours are stitched at the first boundary both have
inside their overlap: a pre-token depends on nothing before it, so from there on both agree. The pieces
between the stitches are encoded where they are, and their ids put in order. If some overlap has no
common boundary (a run of letters or blanks longer than OVERLAP), that text is put together again and
encoded in one go, which gives the same ids. A text that fits a chunk is its only piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import released, whole_text

CHUNK, OVERLAP = 32_768, 1_024
# Boundaries this near to the end of a cut text may be artefacts of the cut.
MARGIN = 32
# Bytes of text in one batch that goes back to the JVM.
BATCH_BYTES = 4 << 20
# Texts that are decoded before they go back to the JVM.
ROWS_AT_ONCE = 256


@lru_cache(maxsize=4)
def encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    """The tokenizer of a rank file's content (lines of a base64 token and its rank)."""
    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def ids_of(tokenizer: tiktoken.Encoding, text: str) -> bytes:
    """The text's ids as little-endian unsigned 32-bit integers."""
    return tokenizer.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def splitter(pattern: str) -> regex.Pattern:
    """The pattern as the tokenizer's own engine reads it: there, blanks are Unicode's White_Space."""
    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def boundaries(pattern: regex.Pattern, text: str, first: int, last: int, cut: bool) -> tuple[list[int], list[int]]:
    """Starts of pre-tokens below ``first``; ends from ``last`` on at which the text may be divided.

    Dividing at an end is safe behind a character that is no blank and if the pre-token before it stays
    the same when the text stops there: patterns look ahead behind blanks only.
    """
    heads, tails = [], []
    usable = len(text) - MARGIN
    for match in pattern.finditer(text):
        start, end = match.span()
        if start < first:
            heads.append(start)
        if cut and last <= end < usable and not text[end - 1].isspace():
            alone = pattern.match(text, start, end)
            if alone and alone.end() == end:
                tails.append(end)
    return heads, tails


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """One row at a time as Python values, so that one text at a time is a Python string."""
    for batch in batches:
        columns = batch.columns
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def encode(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    decoded: bool = False,
) -> DataFrame:
    """Encode every whole text: id, ids (binary, little-endian unsigned 32-bit), one row per row; with
    ``decoded`` also the bytes that the ids decode to (see ``decode``), made in the same Python process.

    ``vocabulary`` is the path of a rank file, ``pattern`` divides texts before merging. The file is
    read once and sent to the tasks (a rank file has about a megabyte). No special tokens. Null texts
    are empty and have no ids; repeated rows stay; an empty table gives no rows.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    length = F.char_length("text")

    def whole(batches):
        tokenizer, table = encoding(ranks.value, pattern), token_bytes(ranks.value)
        schema = pa.schema([("id", arrow_id), ("ids", pa.binary())] + [("decoded", pa.binary())] * decoded)

        def rows():
            for i, text in _rows(batches):
                ids = ids_of(tokenizer, text)
                yield (i, ids, bytes_of(table, ids)) if decoded else (i, ids)

        yield from _batches(rows(), schema)

    arrow_id = _arrow_type(docs, id_col)
    columns = f"id {id_type}, ids binary" + ", decoded binary" * decoded
    short = texts.where(length <= chunk).mapInArrow(released(whole), columns)

    # A key tells rows apart; rows with the same key have the same text, so they share their pieces.
    long = texts.where(length > chunk).withColumn("key", F.sha2("text", 256))

    def cut(batches):
        schema = pa.schema([("key", pa.string()), ("k", pa.int32()), ("last", pa.bool_()), ("part", pa.string())])

        def parts():
            for key, text in _rows(batches):
                count = -(-len(text) // chunk)
                for k in range(count):
                    yield key, k, k == count - 1, text[k * chunk : (k + 1) * chunk + overlap]

        yield from _batches(parts(), schema)

    parts = long.select("key", "text").mapInArrow(released(cut), "key string, k int, last boolean, part string")
    # Equal texts are encoded once: the same part arrives at the same task, in any number of copies.
    parts = parts.repartition("key", "k").dropDuplicates(["key", "k"])

    def pretokenise(batches):
        compiled = splitter(pattern)
        ints = pa.list_(pa.int32())
        schema = pa.schema([("key", pa.string()), ("k", pa.int32()), ("heads", ints), ("tails", ints)])

        def found():
            for key, k, last, part in _rows(batches):
                heads, tails = boundaries(compiled, part, overlap, chunk, not last)
                yield key, k, heads, [p - chunk for p in tails]

        yield from _batches(found(), schema)

    ends = parts.mapInArrow(released(pretokenise), "key string, k int, heads array<int>, tails array<int>")
    # A text's chunks in order: narrow rows, one for each CHUNK characters of it.
    in_order = Window.partitionBy("key").orderBy("k")
    of_text = Window.partitionBy("key")
    ends = ends.withColumn("stitch", F.array_min(F.array_intersect("tails", F.lead("heads").over(in_order))))
    ends = ends.withColumn("is_last", F.col("k") == F.max("k").over(of_text))
    ends = ends.select(
        F.col("key").alias("of"),
        F.col("k").alias("at"),
        F.coalesce(F.lag("stitch").over(in_order), F.lit(0)).alias("begin"),
        F.col("stitch").alias("end"),
        F.max(F.col("stitch").isNull() & ~F.col("is_last")).over(of_text).alias("unstitched"),
    )
    met = parts.join(ends, (F.col("key") == F.col("of")) & (F.col("k") == F.col("at")))

    def pieces(batches):
        tokenizer = encoding(ranks.value, pattern)
        schema = pa.schema([("key", pa.string()), ("k", pa.int32()), ("ids", pa.binary())])

        def encoded():
            for key, k, part, begin, end in _rows(batches):
                upto = len(part) if end is None else chunk + end
                yield key, k, ids_of(tokenizer, part[begin:upto])

        yield from _batches(encoded(), schema)

    stitched = met.where("not unstitched").select("key", "k", "part", "begin", "end")
    stitched = stitched.mapInArrow(released(pieces), "key string, k int, ids binary")
    stitched = stitched.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("list"))
    stitched = stitched.select(
        "key", F.unhex(F.array_join(F.transform("list", lambda x: F.hex(x["ids"])), "")).alias("ids")
    )

    def keyed(batches):
        tokenizer = encoding(ranks.value, pattern)
        schema = pa.schema([("key", pa.string()), ("ids", pa.binary())])
        yield from _batches(((key, ids_of(tokenizer, text)) for key, text in _rows(batches)), schema)

    joined = met.where("unstitched").groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("k", F.substring("part", 1, chunk).alias("part")))).alias("list")
    )
    joined = joined.select("key", F.array_join(F.col("list.part"), "").alias("text"))
    again = joined.mapInArrow(released(keyed), "key string, ids binary")

    done = stitched.unionByName(again)
    done = long.select("id", "key").join(done, "key").select("id", "ids")
    return short.unionByName(decode(done, vocabulary) if decoded else done)


def _arrow_type(docs: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[column].dataType)


@lru_cache(maxsize=4)
def token_bytes(ranks: bytes) -> dict[int, bytes]:
    """The bytes of every id of a rank file's content."""
    return {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, ranks.splitlines())}


def bytes_of(table: dict[int, bytes], ids) -> bytes:
    """The raw bytes of little-endian 32-bit ids, one after the other."""
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Append ``decoded`` (binary): the raw bytes of the ids in the column ``ids``, one after the other."""
    with open(vocabulary, "rb") as file:
        ranks = encoded.sparkSession.sparkContext.broadcast(file.read())
    at = encoded.columns.index("ids")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(ranks.value)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(low, ROWS_AT_ONCE)
                decoded = pa.array([bytes_of(table, x.as_buffer()) for x in part.column(at)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(released(run), StructType([*encoded.schema.fields, StructField("decoded", BinaryType())]))


def encoded_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, decoded from the ids."""
    return encode(docs, vocabulary, pattern, decoded=True).select(
        F.col("id").alias("doc_id"),
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
