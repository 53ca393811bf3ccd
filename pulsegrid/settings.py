"""Session-level helpers shared by every operator."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A dimension is broadcast only after it is shown to hold at most this many narrow rows.
SMALL_ROWS = 10_000


def checked_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Pin a dimension for broadcasting if, and only if, it is small.

    At most ``max_rows + 1`` rows are fetched. When they are the whole table, they come back as a
    broadcast local table, so the check and the data cost one job. Otherwise the table is returned
    as it is and Spark joins it by shuffle.
    """
    rows = df.take(max_rows + 1)
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder: the one in use, else the one that spark.checkpoint.dir names, else
    one below the warehouse, which all executors share as well."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/pulsegrid_checkpoints"
    context.setCheckpointDir(named)
    return context.getCheckpointDir() or named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the table to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_plan(df: DataFrame) -> DataFrame:
    """``cut_lineage`` for the tables of an iteration. A written table keeps Spark's guess of its size, and a join
    guesses the product of both sides: over the rounds, a number with more digits than can be multiplied."""
    written = cut_lineage(df)
    plan = written._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRDD":
        return written
    session = df.sparkSession
    return DataFrame(session._jsparkSession.internalCreateDataFrame(plan.rdd(), written._jdf.schema(), False), session)


def release(written: DataFrame) -> None:
    """Remove the files of a table that ``cut_lineage`` wrote and that nothing reads any more, and the shuffle
    files of what led to it: the driver's collector of garbage says which shuffles are still in use."""
    plan = written._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRDD":
        file = plan.rdd().getCheckpointFile()
        if file.isDefined():
            context = written.sparkSession.sparkContext
            path = context._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()  # Python's references to tables keep theirs
    written.sparkSession.sparkContext._jvm.java.lang.System.gc()


def use_all_cores(df: DataFrame) -> DataFrame:
    """Spread a table that is about to be iterated over when it has fewer partitions than cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def spread_rows(df: DataFrame, rows: int, per_task: int = 256) -> DataFrame:
    """Partition a table of known size for iterating over it: one partition for each ``per_task`` rows,
    at most one for each core unless that would give large ones. What is read before the shuffle keeps
    its own tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(cores, -(-rows // per_task)), -(-rows // (per_task * 256))))
