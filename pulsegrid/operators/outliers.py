"""Population z-scores over a whole table, and the split into retained and excluded rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zscores(df: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Add ``<column>_z``; null where the column has no spread. The moments are one row."""
    moments = df.agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_mean") for c in columns],
            *[F.stddev_pop(c).alias(f"{c}_dev") for c in columns],
        ).alias("m")
    ).scalar()
    for c in columns:
        score = F.try_divide(F.col(c) - moments[f"{c}_mean"], moments[f"{c}_dev"])
        df = df.withColumn(f"{c}{suffix}", score)
    return df


def mark_retained(df: DataFrame, columns: Sequence[str], threshold: float) -> DataFrame:
    """Add ``retained``: every |z| strictly below the threshold; 0 keeps all rows."""
    if threshold <= 0:
        return df.withColumn("retained", F.lit(True))
    scored = zscores(df, columns, "__z")
    inside = F.lit(True)
    for c in columns:
        inside = inside & (F.abs(F.col(f"{c}__z")) < threshold)
    return scored.withColumn("retained", F.coalesce(inside, F.lit(False))).drop(*[f"{c}__z" for c in columns])


def outlier_split(df: DataFrame, columns: Sequence[str], threshold: float) -> tuple[DataFrame, DataFrame]:
    marked = mark_retained(df, columns, threshold)
    return marked.filter("retained").drop("retained"), marked.filter(~F.col("retained")).drop("retained")
