"""Repeated passages by content-defined chunking.

A gear hash rolls over the bytes of a text; where its upper bits are 0 the text may be cut. Whether a
place is cut depends on the bytes just before it alone, so an insertion moves the cuts behind it along
and changes none of them. A chunk goes from a cut to the SPAN-th cut after it, so chunks overlap and
have variable sizes; a chunk whose digest several documents have is repeated. Overlapping repeated
chunks join into passages.

Only digests and places move between machines. Digests are summed map-side (a chunk that a third of all
rows share is one row per task), the join back carries no hint, so adaptive execution can split it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, whole_text

# One place in 2 ** CUT_BITS may be cut, none that follows another such place in less than GAP bytes; a
# stretch without a cut is cut every LONGEST bytes.
CUT_BITS, GAP, LONGEST = 4, 8, 48
SPAN = 4
# Passages with fewer whole words are left alone. A repeated passage of 50 words loses some at both ends.
MIN_WORDS = 20
# The hash has 16 bits, so it forgets a byte after 16 steps.
WINDOW = 16
GEAR = np.random.default_rng(42).integers(0, 1 << WINDOW, 256, np.uint16)


def cuts(data: np.ndarray, first: int = 0) -> np.ndarray:
    """Places at which UTF-8 bytes are cut, from 0 to the length."""
    size = len(data)
    hashed = np.zeros(size, np.uint16)
    gears = GEAR[data]
    for k in range(min(WINDOW, size)):
        hashed[k:] += gears[: size - k] << np.uint16(k)
    candidate = (hashed >> np.uint16(WINDOW - CUT_BITS)) == 0
    candidate[: WINDOW - 1] = False
    candidate[:-1] &= (data[1:] & 0xC0) != 0x80
    at = np.flatnonzero(candidate)
    at = at[np.diff(at, prepend=-GAP) >= GAP] + 1
    at = np.unique(np.concatenate([[0], at, [size]]))
    wide = np.flatnonzero(np.diff(at) > LONGEST)
    if len(wide):
        more = [np.arange(at[i] + LONGEST, at[i + 1], LONGEST) for i in wide]
        at = np.unique(np.concatenate([at, *more]))
    return at


def chunks_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Digest and place of every chunk. A place packs start (31 bits), length (11), words that begin in
    the chunk (10) and words that begin before its first inner cut (8)."""
    data = np.frombuffer(text, np.uint8)
    at = cuts(data) if len(data) else np.zeros(1, np.int64)
    count = max(len(at) - SPAN, 0)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    begins = ~blank
    begins[1:] &= blank[:-1]
    before = np.concatenate([[0], np.cumsum(begins)])
    starts, ends = at[:count], at[SPAN : SPAN + count]
    words, first = before[ends] - before[starts], before[at[1 : 1 + count]] - before[starts]
    view, digest = memoryview(text), xxhash.xxh3_64_intdigest
    digests = [digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
    place = (starts << 29) | ((ends - starts) << 18) | (words << 8) | first
    return np.array(digests, np.uint64).view(np.int64), place


def chunk_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest, place of every chunk of every text that has an id."""
    rows = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text")
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for row, text in zip(batch.column(0).to_pylist(), texts):
                digests, places = chunks_of(text.as_py())
                for a in range(0, len(digests), 1 << 16):
                    part = slice(a, a + (1 << 16))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(digests[part]), row)), pa.array(digests[part]), pa.array(places[part])],
                        names=["id", "digest", "place"],
                    )

    return rows.mapInArrow(released(run), "id long, digest long, place long")


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS
) -> DataFrame:
    """id, start, end, n_words, first_ids, kept: passages of at least min_words that several documents have.

    start and end are byte places in the UTF-8 text, first_ids the smallest ids that have the passage's
    chunks. A passage that earlier documents have and one that the document is the first to have are
    rows of their own where they meet (their chunks overlap there): not kept and kept. Fewer than
    min_words of an earlier document between chunks of one's own count as one's own. Documents without
    repeats have no row. Null and empty texts have no passages; rows without an id take no part; rows
    with one id are one document, so a repeated row is no repeat. Other columns are not read.
    """
    chunks = chunk_table(docs, id_col, text_col)
    shared = chunks.groupBy("digest").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    shared = shared.where("first_id < last_id").select(F.col("digest").alias("of"), "first_id")
    found = chunks.join(shared, F.col("digest") == F.col("of")).groupBy("id", "place").agg(
        F.min("first_id").alias("first_id")
    )
    start = F.shiftright("place", 29)
    length = F.shiftright("place", 18).bitwiseAND(F.lit(2047))
    found = found.select(
        "id",
        "first_id",
        start.alias("start"),
        (start + length).alias("end"),
        F.shiftright("place", 8).bitwiseAND(F.lit(1023)).alias("words"),
        F.col("place").bitwiseAND(F.lit(255)).alias("first_words"),
    )
    # One document's chunks in order.
    order = Window.partitionBy("id").orderBy("start", "end")
    begins = F.coalesce(F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    own = F.col("first_id") == F.col("id")
    turns = begins | (own != F.lag(own).over(order))
    found = found.select(
        "*", own.alias("own"), F.sum(begins.cast("int")).over(order).alias("run"), F.sum(turns.cast("int")).over(order).alias("part")
    )
    parts = found.groupBy("id", "run", "part", "own").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.sum("first_words").alias("steps"),
        F.max_by(F.col("words") - F.col("first_words"), "start").alias("rest"),
        F.collect_set("first_id").alias("first_ids"),
    )
    # What earlier documents have stands alone if it is long enough; all else of a run between is one passage.
    parts = parts.withColumn("kept", F.col("own") | (F.col("steps") + F.col("rest") < min_words))
    by_part = Window.partitionBy("id").orderBy("part")
    goes_on = F.col("kept") & F.lag("kept").over(by_part) & (F.col("run") == F.lag("run").over(by_part))
    begins = F.coalesce(~goes_on, F.lit(True))
    parts = parts.withColumn("passage", F.sum(begins.cast("int")).over(by_part))
    passages = parts.groupBy("id", "passage").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        (F.sum("steps") + F.max_by("rest", "part")).alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("first_ids")))).alias("first_ids"),
        F.first("kept").alias("kept"),
    )
    return passages.where(F.col("n_words") >= min_words).select(
        F.col("id").alias(id_col), "start", "end", "n_words", "first_ids", "kept"
    )


def cut_passages(text: str, passages: list[tuple[int, int]]) -> str:
    """The text without whole words of the given byte ranges."""
    data = text.encode()
    blank = b" \t\n\x0b\x0c\r"
    kept, at = [], 0
    for start, end in sorted(passages):
        while 0 < start < end and data[start - 1] not in blank:
            start += 1
        while start < end < len(data) and data[end - 1] not in blank:
            end -= 1
        if start < end:
            kept.append(data[at:start])
            at = max(at, end)
    kept.append(data[at:])
    return b"".join(kept).decode()


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The documents, all columns, without the passages that an earlier document has; words stay whole."""
    found = repeated_passages(docs.select("doc_id", "text")).where("not kept")
    found = found.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("start", "end")).alias("passages"))

    @F.pandas_udf("string")
    def cut(texts, passages):
        import pandas as pd

        return pd.Series([cut_passages(t, [(p["start"], p["end"]) for p in ps]) for t, ps in zip(texts, passages)])

    rows = docs.select(F.struct("*").alias("row")).join(found, F.col("row.doc_id") == F.col("id"), "left")
    text = F.when(F.col("passages").isNull(), F.col("row.text")).otherwise(
        cut(whole_text(F.col("row.text")), F.coalesce("passages", F.array().cast("array<struct<start:bigint,end:bigint>>")))
    )
    return rows.select(F.col("row").withField("text", text).alias("row")).select("row.*")
