"""Documents to terms: counts, a pruned vocabulary, count vectors and tf-idf vectors.

``docs(doc, text)`` is read batch by batch; the only shuffle is the one that adds up the terms of the
vocabulary, and map-side combining shrinks it to one row per term and task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import ElementwiseProduct, Normalizer, StopWordsRemover
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.text import blanked, lowered, numbered_words, text_pieces, word_counts, words


@dataclass(frozen=True)
class Vocabulary:
    """Terms in alphabetical order, with the number of documents holding each."""

    terms: list[str]
    document_counts: list[int]
    documents: int


def default_stop_words() -> list[str]:
    """Spark's English list; any other list can be given instead."""
    return StopWordsRemover.loadDefaultStopWords("english")


def corpus(items: DataFrame) -> DataFrame:
    """``(…, title, body)`` to ``(…, text)``: title and body joined by a blank; a null is left out."""
    keep = [c for c in items.columns if c not in ("title", "body")]
    return items.select(*keep, F.concat_ws(" ", "title", "body").alias("text"))


def term_counts(docs: DataFrame, stop_words: Sequence[str] = ()) -> DataFrame:
    """``(doc, term, n)``, without a shuffle."""
    counted = word_counts(words(F.col("text"), stop_words))
    return docs.select("doc", F.inline(counted))


def vocabulary(
    docs: DataFrame,
    stop_words: Sequence[str] = (),
    max_df: float = 0.95,
    min_df: int = 2,
    max_features: int = 1000,
) -> DataFrame:
    """``(idx, term, n, df)``: terms in at least ``min_df`` documents and at most the share
    ``max_df`` of them; of these the ``max_features`` most frequent, indexed alphabetically."""
    left_out = pa.array(list(stop_words), pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for batch in batches for p in text_pieces(batch)):
            rows, codes, found = numbered_words(piece.column("text"))
            long = pc.greater_equal(pc.utf8_length(found), 2)
            used = pc.and_not(long, pc.is_in(found, value_set=left_out))
            kept = used.to_numpy(zero_copy_only=False)
            mine = kept[codes]
            pairs = np.sort(rows[mine] * len(found) + codes[mine])  # a word's copies in a text lie side by side
            pairs = pairs[np.diff(pairs, prepend=-1) > 0]
            n = np.bincount(codes, minlength=len(found))[kept]
            df = np.bincount(pairs % max(1, len(found)), minlength=len(found))[kept]
            yield pa.RecordBatch.from_pydict({"term": found.filter(used), "n": n, "df": df})

    texts = docs.select(lowered(F.col("text")).alias("text")).select(blanked(F.col("text")).alias("text"))
    per_term = (
        texts.mapInArrow(count, "term string, n long, df long")
        .groupBy("term")
        .agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    )
    documents = docs.agg(F.count("*")).scalar()
    kept = per_term.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * documents))
    best = kept.orderBy(F.desc("n"), F.asc("term")).limit(max_features)
    # at most max_features rows are numbered here
    idx = F.row_number().over(Window.orderBy("term")) - 1
    return best.select(idx.alias("idx"), "term", "n", "df")


def fit_vocabulary(docs: DataFrame, stop_words: Sequence[str] = (), **limits) -> Vocabulary:
    rows = vocabulary(docs, stop_words, **limits).withColumn("documents", docs.agg(F.count("*")).scalar())
    rows = sorted(rows.collect(), key=lambda r: r["idx"])  # at most max_features rows
    if not rows:
        raise ValueError("no terms remain after pruning the vocabulary")
    return Vocabulary([r["term"] for r in rows], [r["df"] for r in rows], rows[0]["documents"])


def count_vectors(docs: DataFrame, vocab: Vocabulary, stop_words: Sequence[str] = ()) -> DataFrame:
    """``(doc, features)``: sparse counts over the vocabulary, row by row."""
    left_out = set(stop_words)
    # a stop word keeps its place and is not counted
    terms = pa.array([None if t in left_out else t for t in vocab.terms], pa.string())
    width = len(vocab.terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (p for batch in batches for p in text_pieces(batch)):
            rows, codes, found = numbered_words(piece.column("text"))
            long = pc.if_else(pc.greater_equal(pc.utf8_length(found), 2), found, pa.scalar(None, pa.string()))
            idx = pc.index_in(long, value_set=terms, skip_nulls=True).fill_null(-1).to_numpy(zero_copy_only=False)[codes]
            mine = idx >= 0
            cells, counts = np.unique(rows[mine] * width + idx[mine], return_counts=True)
            ends = np.searchsorted(cells, np.arange(piece.num_rows + 1) * width).astype(np.int32)
            parts = {
                "type": pa.array(np.zeros(piece.num_rows, np.int8)),
                "size": pa.array(np.full(piece.num_rows, width, np.int32)),
                "indices": pa.ListArray.from_arrays(ends, (cells % width).astype(np.int32)),
                "values": pa.ListArray.from_arrays(ends, counts.astype(float)),
            }
            features = pa.StructArray.from_arrays(list(parts.values()), names=list(parts))
            yield pa.RecordBatch.from_arrays([piece.column("doc"), features], names=["doc", "features"])

    texts = docs.select("doc", lowered(F.col("text")).alias("text")).select("doc", blanked(F.col("text")).alias("text"))
    return texts.mapInArrow(count, StructType([docs.schema["doc"], StructField("features", VectorUDT())]))


def tfidf_vectors(docs: DataFrame, vocab: Vocabulary, stop_words: Sequence[str] = ()) -> DataFrame:
    """``(doc, features)``: tf * (ln((1 + n) / (1 + df)) + 1), each row scaled to length one."""
    scale = [log((1 + vocab.documents) / (1 + df)) + 1 for df in vocab.document_counts]
    counts = count_vectors(docs, vocab, stop_words)
    weighted = ElementwiseProduct(
        scalingVec=Vectors.dense(scale), inputCol="features", outputCol="weighted"
    ).transform(counts)
    return (
        Normalizer(p=2.0, inputCol="weighted", outputCol="scaled")
        .transform(weighted)
        .select("doc", F.col("scaled").alias("features"))
    )


def vector_terms(vectors: DataFrame, vocab: Vocabulary, name: str = "weight") -> DataFrame:
    """``(doc, idx, term, <name>)``: the non-zero entries of sparse vectors, spelled out."""
    parts = F.unwrap_udt("features")
    entries = F.arrays_zip(parts["indices"].alias("idx"), parts["values"].alias(name))
    terms = F.array(*[F.lit(t) for t in vocab.terms])
    return vectors.select("doc", F.inline(entries)).select(
        "doc", "idx", F.get(terms, F.col("idx")).alias("term"), name
    )
