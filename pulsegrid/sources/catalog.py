"""Tables of the session catalog: presence, health, writing, fingerprints, reuse."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..settings import cut_lineage

_PROBE = "pulsegrid_write_probe"
_SOURCE = "pulsegrid.source"


class MissingTables(RuntimeError):
    pass


def table_names(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables() if not t.isTemporary)


def missing_tables(spark: SparkSession, names: Sequence[str]) -> list[str]:
    return [n for n in names if not spark.catalog.tableExists(n)]


def check_writable(spark: SparkSession) -> bool:
    """Can a table be created and dropped?"""
    try:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {_PROBE} (id INT) USING parquet")
        spark.sql(f"DROP TABLE IF EXISTS {_PROBE}")
        return True
    except AnalysisException:
        return False


def require_tables(spark: SparkSession, names: Sequence[str]) -> None:
    """All tables are there and can be read, or the names that fail are raised."""
    absent = missing_tables(spark, names)
    if absent:
        raise MissingTables(f"missing tables: {', '.join(absent)}; load the data first")
    for name in names:
        try:
            spark.table(name).take(1)
        except AnalysisException as error:
            raise MissingTables(f"table {name} cannot be read") from error


def read_table(spark: SparkSession, name: str, *columns: str) -> DataFrame:
    table = spark.table(name)
    return table.select(*columns) if columns else table


def write_table(df: DataFrame, name: str, spread_by: str | None = None) -> None:
    """Overwrite a managed Parquet table.

    ``spread_by`` lays the table out by a column, so that filters on it skip the other folders. The
    layout is a rebalance: adaptive execution splits a value that holds much of the data by its size.
    """
    if spread_by is None:
        df.write.mode("overwrite").format("parquet").saveAsTable(name)
        return
    spread = df.hint("rebalance", F.col(spread_by))
    spread.write.mode("overwrite").format("parquet").partitionBy(spread_by).saveAsTable(name)


def _row_digest(kinds: Sequence[tuple[str, str]]) -> Column:
    """MD5 of a row: each field with its length, so that no two rows read alike; timestamps count in
    microseconds, arrays, maps and structs as JSON."""

    def field(name: str, kind: str) -> Column:
        column = F.col(f"`{name}`")
        if kind == "timestamp":
            column = F.unix_micros(column)
        if kind == "timestamp_ntz":
            column = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
        if kind.startswith(("array", "map", "struct")):
            column = F.to_json(F.struct(column))
        text = F.base64(column) if kind == "binary" else column.cast("string")
        return F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("null"))

    return F.md5(F.concat(F.lit(""), *[field(c, kind) for c, kind in kinds]))


def _digest_sums(kinds: Sequence[tuple[str, str]]) -> list[Column]:
    """rows, high, low: the two halves of every row's digest are added up exactly, as decimals, so that no
    number of rows overflows. Sums of parts of a table add up to those of the table."""
    digest = _row_digest(kinds)

    def half(start: int) -> Column:
        part = F.conv(F.substring(digest, start, 16), 16, 10).cast("decimal(20,0)")
        return F.coalesce(F.sum(part), F.lit(0)).cast("decimal(38,0)")

    return [F.count("*").alias("rows"), half(1).alias("high"), half(17).alias("low")]


def _checksum() -> Column:
    return F.concat(F.col("high").cast("string"), F.lit("-"), F.col("low").cast("string")).alias("checksum")


def table_fingerprint(df: DataFrame) -> DataFrame:
    """``(rows, checksum)`` of a table, whatever the order of its rows."""
    return df.agg(*_digest_sums(df.dtypes)).select("rows", _checksum())


_FILE = ("path", "size", "modified")
# With more new files than this a scan of the whole table is simpler than a list of them.
_LISTED_FILES = 10_000


def _file_columns() -> list[Column]:
    metadata = (F.col("_metadata.file_path"), F.col("_metadata.file_size"), F.col("_metadata.file_modification_time"))
    return [column.alias(name) for column, name in zip(metadata, _FILE)]


def table_location(spark: SparkSession, name: str) -> str | None:
    """The folder of a table's files; None for views and tables without files."""
    if spark.catalog.getTable(name).tableType not in ("MANAGED", "EXTERNAL"):
        return None
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'").first()
    return described["data_type"] if described else None


def table_files(spark: SparkSession, location: str) -> DataFrame:
    """``(path, size, modified)`` of the files in a folder and those below; no file is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(location)
    return listed.select(*_file_columns())


def parts_table(name: str) -> str:
    return f"{name}_parts"


def stored_fingerprint(spark: SparkSession, name: str) -> DataFrame:
    """``table_fingerprint`` of a stored table, at the price of its new files only.

    The digest sums of every file are kept in a table beside it, under the file's path, size and time of
    change. Files that are noted there are not opened again, files that are gone are left out. A view,
    or a table without files, is read whole.
    """
    location = table_location(spark, name)
    if location is None:
        return table_fingerprint(spark.table(name))
    spark.catalog.refreshTable(name)
    table, noted = spark.table(name), parts_table(name)
    # What a file's rows amount to depends on the table's columns too.
    layout = F.lit(table.schema.simpleString())
    files = cut_lineage(table_files(spark, location))
    known = None
    if spark.catalog.tableExists(noted):
        known = spark.table(noted).where(F.col("layout") == layout).join(files, [*_FILE], "left_semi")
    fresh = files if known is None else files.join(known, [*_FILE], "left_anti")
    new = [r["path"] for r in fresh.select("path").take(_LISTED_FILES + 1)]
    if new or known is None or known.count() < spark.table(noted).count():
        read = table if len(new) > _LISTED_FILES else table.where(F.col("_metadata.file_path").isin(new))
        own = ["file_path", "file_size", "file_modification_time"]
        named = read.select("*", *[F.col(f"_metadata.{c}").alias(f"{c} of the part") for c in own])
        sums = named.groupBy(*[F.col(f"`{c} of the part`").alias(k) for c, k in zip(own, _FILE)])
        sums = sums.agg(*_digest_sums(table.dtypes))
        # A file without rows is noted as well.
        sums = fresh.join(sums, [*_FILE], "left").na.fill(0, ["rows", "high", "low"]).withColumn("layout", layout)
        parts = sums if known is None else known.select(*sums.columns).unionByName(sums)
        write_table(cut_lineage(parts), noted)
        known = spark.table(noted)
    total = [F.coalesce(F.sum(c), F.lit(0)).cast(kind).alias(c) for c, kind in _SUMS]
    return known.agg(*total).select("rows", _checksum())


_SUMS = (("rows", "long"), ("high", "decimal(38,0)"), ("low", "decimal(38,0)"))


def fingerprint_text(inputs: dict[str, DataFrame]) -> str:
    return _noted({name: table_fingerprint(df) for name, df in inputs.items()})


def _noted(prints: dict[str, DataFrame]) -> str:
    parts = []
    for name in sorted(prints):
        row = prints[name].first()
        parts.append(f"{name}:{row['rows']}:{row['checksum']}")
    return " ".join(parts)


def load_or_build(
    spark: SparkSession,
    name: str,
    build: Callable[[], DataFrame],
    inputs: dict[str, DataFrame | str] | None = None,
    force: bool = False,
) -> DataFrame:
    """The stored table, built first if it is absent, forced, or made from other inputs.

    Without ``inputs`` a stored table is taken as it is; with them their fingerprint is compared
    with the one noted on the table. An input is a table's name, of which only new files are read for
    it, or a DataFrame, which is read whole.
    """
    noted = None
    if inputs:
        noted = _noted(
            {n: stored_fingerprint(spark, i) if isinstance(i, str) else table_fingerprint(i) for n, i in inputs.items()}
        )
    fresh = spark.catalog.tableExists(name) and not force
    if fresh and noted is not None:
        properties = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
        fresh = properties.get(_SOURCE) == noted
    if not fresh:
        write_table(build(), name)
        if noted is not None:
            spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{_SOURCE}' = '{noted}')")
    return spark.table(name)
