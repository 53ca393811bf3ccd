"""Exact duplicates by content-defined chunk recipes.

A text is cut where its own content says so, every distinct chunk gets a verified identifier, and two
texts are equal when their ordered identifier lists are. Only digests move between machines: a long
text stays in the task that read it.

Everything here is DataFrame functions. Hot chunks and hot texts are summed before they move; the two
joins back carry no hint, so adaptive execution can split a chunk or a recipe that a third of the rows
share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import cut_lineage
from .common import BLANKS, whole_text

# A chunk has at least CHUNK_MIN characters and ends behind the first following cut mark: a blank that
# comes after one of these pairs, which are rare enough that two texts with a common part soon choose the
# same mark. Without a mark a chunk ends at CHUNK_MAX characters.
CHUNK_MIN, CHUNK_MAX = 320, 8192
CUT_MARKS = ("st", "la", "t.")


def normalised(text: str | Column = "text") -> Column:
    """The text with each run of ASCII blanks as one space; null is the empty text."""
    return F.regexp_replace(whole_text(text), BLANKS, " ")


def chunk_pattern(shortest: int = CHUNK_MIN, longest: int = CHUNK_MAX) -> str:
    marks = "|".join(m.replace(".", r"\.") for m in CUT_MARKS)
    return rf"(?s).{{{shortest},{longest}}}?(?<={marks}) |.{{1,{longest}}}"


def chunks(text: Column) -> Column:
    """The text in order as content-defined chunks; the empty text is one empty chunk."""
    found = F.regexp_extract_all(text, F.lit(chunk_pattern()), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(found)


def chunk_occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per chunk of each row: id, text_sha256, pos, short (64 bits), full (SHA-256)."""
    texts = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"))
    return texts.select(
        "id", F.sha2("norm", 256).alias("text_sha256"), F.posexplode(chunks(F.col("norm"))).alias("pos", "chunk")
    ).select(
        "id",
        "text_sha256",
        "pos",
        F.xxhash64("chunk").alias("short"),
        F.unhex(F.sha2("chunk", 256)).alias("full"),
    )


def chunk_identifiers(occurrences: DataFrame) -> DataFrame:
    """Each distinct chunk once: short, full, uses, chunk_id.

    A short digest is an identifier only where it is verified to stand for one SHA-256 digest; where
    several share it, they are numbered, so that different chunks never get one identifier.
    """
    distinct = occurrences.groupBy("short", "full").agg(F.count(F.lit(1)).alias("uses"))
    shared = (
        distinct.groupBy("short")
        .agg(F.min("full").alias("first_full"), F.max("full").alias("last_full"))
        .where(F.col("first_full") != F.col("last_full"))
        .select(F.col("short").alias("shared_short"))
    )
    verified = F.when(F.col("shared_short").isNull(), F.struct("short", F.lit(None).cast("binary").alias("told_by")))
    return distinct.join(shared, F.col("short") == F.col("shared_short"), "left").select(
        "short", "full", "uses", verified.otherwise(F.struct("short", F.col("full").alias("told_by"))).alias("chunk_id")
    )


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ordered identifier lists: id, text_sha256, recipe, copies (rows that agree in id and text)."""
    # Written once: three uses would cut and digest every text three times.
    occurrences = cut_lineage(chunk_occurrences(docs, id_col, text_col))
    named = chunk_identifiers(occurrences).select(
        F.col("short").alias("s"), F.col("full").alias("f"), "chunk_id"
    )
    listed = occurrences.join(
        named, (F.col("short") == F.col("s")) & (F.col("full") == F.col("f"))
    ).groupBy("id", "text_sha256")
    return listed.agg(
        F.array_sort(F.collect_set(F.struct("pos", "chunk_id"))).alias("list"),
        F.sum(F.when(F.col("pos") == 0, 1).otherwise(0)).alias("copies"),
    ).select("id", "text_sha256", F.col("list.chunk_id").alias("recipe"), "copies")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are the same after each run of ASCII blanks becomes one space. Of equal
    texts the row with the smallest id stays; of rows that agree in id and text too, one. Null texts
    are empty texts. Rows without an id count in group_size and stay only if no row of the group has
    one; keep_id is null then. An empty table gives no rows; other columns are not read.
    """
    listed = recipes(docs, id_col, text_col)
    groups = listed.groupBy(F.col("recipe").alias("of")).agg(
        F.min("id").alias("keep_id"), F.sum("copies").cast("long").alias("group_size")
    )
    groups = groups.where(F.col("group_size") > 1)
    rows = listed.join(groups, F.col("recipe") == F.col("of"), "left").select(
        "id",
        F.when(F.col("of").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        "text_sha256",
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    )
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return rows.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def row_key(id_col: Column, text_sha256: Column) -> Column:
    """One string for an id, null included, and a text."""
    return F.concat(F.when(id_col.isNull(), "null").otherwise(F.concat(F.lit("="), id_col.cast("string"))), text_sha256)


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: one row of each group of equal texts."""
    kept = exact_duplicates(docs.select("doc_id", "text")).where("kept")
    kept = kept.select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    keyed = docs.select(
        F.struct("*").alias("row"), row_key(F.col("doc_id"), F.sha2(normalised("text"), 256)).alias("key")
    )
    once = Window.partitionBy("key").orderBy("key")
    return keyed.join(kept, "key", "left_semi").withColumn("n", F.row_number().over(once)).where("n = 1").select("row.*")
