"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range is kept.

Sketches of texts of any length compare without a common size, and a union of sketches is the sketch of
the united shingles. The smallest hash is kept as well, so that a short text has a sketch too; a union
keeps the smallest of both, so sketches still merge. Everything here is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import checked_small, cut_lineage
from .common import BLANKS, let, whole_text

WORDS = 5
# Hashes whose top DROPPED_BITS bits are 0 are kept: one in 2 ** DROPPED_BITS.
DROPPED_BITS = 3
# Documents that a task of the neighbour search holds, about; a wider text is on disk, not in memory.
ROWS_PER_BLOCK = 4000
MOST_BLOCKS = 1 << 16
# Copies that one row stands for at most.
COPIES = 10_000


def shingle_hashes(text: Column, n: int = WORDS) -> Column:
    """64-bit hashes of the text's n-word shingles, lower-cased; a shorter text is one shingle."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), BLANKS, " ")), " ")

    def of(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(hashes) - n, F.lit(0)))
        # Beyond the end of a short text F.get gives null, which leaves the hash so far as it is.
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)]))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def sketch(text: Column, n: int = WORDS, dropped_bits: int = DROPPED_BITS) -> Column:
    """Sorted distinct hashes below 2 ** (64 - dropped_bits), and the smallest hash of all (unsigned)."""
    limit = 1 << (64 - dropped_bits)

    def keep(hashes: Column) -> Column:
        # As signed numbers the low ones are 0 to limit, so flipping the sign bit orders them unsigned.
        lowest = F.array_min(F.transform(hashes, lambda h: h.bitwiseXOR(F.lit(-(1 << 63)))))
        lowest = lowest.bitwiseXOR(F.lit(-(1 << 63)))
        small = F.filter(hashes, lambda h: (h >= 0) & (h < F.lit(limit)))
        return F.array_sort(F.array_distinct(F.concat(small, F.array(lowest))))

    return let(shingle_hashes(text, n), keep)


def merge(a: Column, b: Column, dropped_bits: int = DROPPED_BITS) -> Column:
    """The sketch of two texts' shingles together."""
    limit = 1 << (64 - dropped_bits)
    both = F.array_union(a, b)
    small = F.filter(both, lambda h: (h >= 0) & (h < F.lit(limit)))
    sign = F.lit(-(1 << 63))
    lowest = F.array_min(F.transform(both, lambda h: h.bitwiseXOR(sign))).bitwiseXOR(sign)
    return F.array_sort(F.array_distinct(F.concat(small, F.array(lowest))))


def encode(hashes: Column) -> Column:
    """A sketch as a string: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the smaller sketch's shingles that the other has (0 to 1)."""
    return F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated share of all shingles of both that both have (0 to 1)."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def _placed(doc_id: Column, tie: Column) -> Column:
    """Sorts like descending ids, null ids last, rows of one id by the hash of their text."""
    down = F.coalesce(F.bitwise_not(doc_id.cast("long")), F.lit(0).cast("long"))
    return F.struct(doc_id.isNull().alias("no_id"), down.alias("down"), tie.alias("tie"))


def _cuts(keys: DataFrame, size: int) -> list:
    """The places ``at`` where about ``size`` of the ``rows`` are full, and the first one of each range that
    the rows are counted in."""
    ranges = keys.repartitionByRange(max(1, min(4096, -(-keys.count() // 250_000))), "at")
    ordered = Window.partitionBy("part").orderBy("at")
    counted = ranges.withColumn("part", F.spark_partition_id()).select(
        "at",
        F.floor((F.sum("rows").over(ordered) - F.col("rows")) / size).alias("full"),
        F.row_number().over(ordered).alias("n"),
        "part",
    )
    counted = counted.withColumn("before", F.lag("full").over(ordered))
    return sorted(tuple(r["at"]) for r in counted.where("n = 1 or full > before").select("at").collect())


def _block(at: Column, cuts: Column, blocks: int) -> Column:
    """The last cut that is not behind the place, by halving."""

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        here = F.get(cuts, middle) <= at
        low, high = F.when(here, middle).otherwise(state["low"]), F.when(here, state["high"]).otherwise(middle)
        return F.struct(low.alias("low"), high.alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(blocks).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, blocks.bit_length()))), start, halve)["low"]


def with_next(docs: DataFrame, rows_per_block: int = ROWS_PER_BLOCK) -> tuple[DataFrame, object]:
    """doc_id, text, block, guest, copies and order columns: the documents laid out so that the next one in
    descending id order is in the same block; the window to read it; ``guest`` marks rows that are only read.

    Blocks are cut at counted places, whatever the ids are, and the first row of the block that follows
    comes along as a guest, the overall first row after the overall last one. So texts move once. Rows
    without an id come last; rows with one id go by a hash of their text. Where a row is repeated more often
    than a block has rows, rows with a number of ``copies`` stand for it; the last has one copy. At most
    ``MOST_BLOCKS`` blocks, beyond that they grow; a block's texts are sorted on disk.
    """
    text = whole_text()
    at = _placed(F.col("doc_id"), F.xxhash64(text))
    rows = docs.select("doc_id", text.alias("text"), at.alias("at"))
    keys = cut_lineage(rows.groupBy("at").agg(F.count(F.lit(1)).alias("n")))
    total = keys.agg(F.sum(F.least("n", F.lit(rows_per_block)))).first()[0] or 0
    size = max(rows_per_block, -(-total // MOST_BLOCKS))
    hot = keys.where(F.col("n") > size).select("at")
    if hot.isEmpty():
        rows = rows.withColumn("copies", F.lit(1))
    else:
        hot = checked_small(hot, 100_000)
        once = rows.join(hot, "at", "left_semi").groupBy("doc_id", "text", "at").agg(F.count(F.lit(1)).alias("n"))
        full, rest = F.floor((F.col("n") - 1) / COPIES), (F.col("n") - 1) % COPIES
        parts = F.concat(F.array_repeat(F.lit(COPIES), full.cast("int")), F.array(rest.cast("int"), F.lit(1)))
        once = once.withColumn("copies", F.explode(parts)).where("copies > 0").select(*rows.columns, "copies")
        rows = rows.join(hot, "at", "left_anti").select(*rows.columns).withColumn("copies", F.lit(1)).unionByName(once)
    cuts = _cuts(keys.select("at", F.when(F.col("n") > size, 2).otherwise(F.col("n")).alias("rows")), size)
    schema = "one int, cuts array<struct<no_id:boolean,down:bigint,tie:bigint>>"
    listed = docs.sparkSession.createDataFrame([(1, cuts)], schema)
    found = rows.withColumn("one", F.lit(1)).join(F.broadcast(listed), "one")
    found = found.withColumn("block", _block(F.col("at"), F.col("cuts"), len(cuts)))
    own, before = F.col("block"), F.when(F.col("block") == 0, F.lit(len(cuts) - 1)).otherwise(F.col("block") - 1)
    place, guest = F.struct(own.alias("b"), F.lit(False).alias("g")), F.struct(before.alias("b"), F.lit(True).alias("g"))
    first = F.get("cuts", F.col("block")) == F.col("at")
    found = found.withColumn("p", F.explode(F.when(first, F.array(place, guest)).otherwise(F.array(place))))
    found = found.select("doc_id", "text", "at", "copies", F.col("p.b").alias("block"), F.col("p.g").alias("guest"))
    return found, Window.partitionBy("block").orderBy("guest", "at", F.col("copies").desc())


def fingerprints_and_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    resembles_edited of every document.

    The edited text has its last n_chars // 2 code points replaced by as many first ones of the next
    document in descending id order, the first one after the last. near_* are containments. Null texts
    are empty texts; an empty table gives no rows; repeated rows stay; other columns are not read.
    """
    rows, window = with_next(docs)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn(
        "next_text", F.lead("text").over(window)
    )
    # A guest's own next is not here and not needed; without this its null would be sketched.
    rows = rows.withColumn(
        "edited",
        F.concat(
            F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")),
            F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half),
        ),
    )
    rows = rows.select(
        "doc_id",
        "n_chars",
        "block",
        "guest",
        "at",
        "copies",
        F.when(~F.col("guest"), F.sha2("edited", 256)).alias("edited_sha256"),
        sketch(F.col("text")).alias("own"),
        F.when(~F.col("guest"), sketch(F.col("edited"))).alias("changed"),
    )
    rows = rows.withColumn("following", F.lead("own").over(window)).where(~F.col("guest"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        encode(F.col("own")).alias("fingerprint"),
        encode(F.col("changed")).alias("edited_fingerprint"),
        containment(F.col("own"), F.col("changed")).alias("near_edited"),
        containment(F.col("own"), F.col("following")).alias("near_next"),
        resemblance(F.col("own"), F.col("changed")).alias("resembles_edited"),
    )
