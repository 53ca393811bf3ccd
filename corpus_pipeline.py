"""A training corpus from documents: toxic ones go, copies go, near copies go, sources are mixed, texts
are encoded. ``STAGES`` are (name, function of (spark, docs, sf_dir)); each works on all that the one
before kept, and all but the last return the columns of documents."""

from __future__ import annotations

from pathlib import PurePosixPath

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import bpe, mixing, recipes, simhash, toxicity
from pulsegrid.llm.common import table
from pulsegrid.llm.queries import quality_weights
from pulsegrid.settings import ensure_checkpoint_dir

# A trained model and drawn exponential keys are not SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model scores below 0.5, with all columns. Null and empty texts are scored like
    others, whole texts are read, repeated rows and null ids stay, an empty table stays empty."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (runs of blanks count as one space, null as empty) the row with the smallest id, a null
    id last; one of several rows that agree in id and text."""
    return recipes.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of every group that 3 or fewer differing bits link. Texts
    without words have the fingerprint zero and form a group like others."""
    return simhash.keep_representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes them."""
    weights = quality_weights(table(spark, sf_dir, "labels"))
    return mixing.repeat_documents(docs, mixing.mix_documents(docs, weights))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of every row, repeated ones too; null and empty texts have no tokens."""
    return bpe.encoded_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents. What a stage keeps is written to the shared checkpoint folder and
    read again, so a lost executor repeats work of one stage at most."""
    docs = table(spark, sf_dir, "documents")
    folder = PurePosixPath(f"stages-{spark.sparkContext.applicationId}-{_next_run()}")
    base = ensure_checkpoint_dir(spark)
    for name, stage in STAGES[:-1]:
        path = f"{base}/{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


_runs = 0


def _next_run() -> int:
    global _runs
    _runs += 1
    return _runs
