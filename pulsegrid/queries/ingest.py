"""Queries on ingest, fingerprints and presentation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import attributes, clusters
from ..settings import use_all_cores
from ..sources import catalog
from ..sources.catalog import table_fingerprint
from ..sources.dump import dump_rows
from . import binding as b
from .engagement import CODES_SQL
from .registry import query


def _quoted(column):
    text = F.regexp_replace(column, r"\\", r"\\\\")
    text = F.regexp_replace(text, "'", r"\\'")
    text = F.regexp_replace(text, "\n", r"\\n")
    text = F.regexp_replace(text, "\r", r"\\r")
    return F.concat(F.lit("'"), text, F.lit("'"))


def _dump_lines(spark, sf_dir):
    """The document table written as a dump: one INSERT line per document, quotes escaped."""
    documents = use_all_cores(b.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    row = F.concat(
        F.lit("("), F.col("doc_id").cast("string"), F.lit(","), _quoted(F.col("text")), F.lit(",NULL,"),
        _quoted(F.col("lang")), F.lit(")"),
    )
    # a second row per line, for a value list of more than one row
    twin = F.concat(F.lit("(-"), F.col("doc_id").cast("string"), F.lit(",'',NULL,'x, (y)')"))
    line = F.concat(F.lit("INSERT INTO `documents` VALUES "), row, F.lit(","), twin, F.lit(";"))
    return documents.select(line.alias("value")).unionByName(
        documents.select(F.concat(F.lit("-- "), F.col("lang")).alias("value"))
    )


@query(
    "dump_rows",
    """SELECT doc_id::VARCHAR AS id, text AS text, NULL::VARCHAR AS note, lang AS lang FROM documents
    UNION ALL SELECT '-' || doc_id::VARCHAR, '', NULL, 'x, (y)' FROM documents""",
)
def _(spark, sf_dir):
    return dump_rows(_dump_lines(spark, sf_dir), "documents", ["id", "text", "note", "lang"], strip=False)


@query(
    "dump_rows_stripped",
    """SELECT doc_id::VARCHAR AS id, replace(replace(replace(text, chr(10), ''), chr(13), ''), '"', '') AS text,
    NULL::VARCHAR AS note, lang AS lang FROM documents
    UNION ALL SELECT '-' || doc_id::VARCHAR, '', NULL, 'x, (y)' FROM documents""",
)
def _(spark, sf_dir):
    return dump_rows(_dump_lines(spark, sf_dir), "documents", ["id", "text", "note", "lang"])


@query("dump_rows_html", "SELECT page_id::VARCHAR AS id, html, url FROM pages")
def _(spark, sf_dir):
    pages = b.table(spark, sf_dir, "pages")
    row = F.concat(
        F.lit("INSERT INTO `pages` VALUES ("), F.col("page_id").cast("string"), F.lit(","),
        _quoted(F.col("html")), F.lit(","), _quoted(F.col("url")), F.lit(");"),
    )
    return dump_rows(pages.select(row.alias("value")), "pages", ["id", "html", "url"], strip=False)


_FINGERPRINT_SQL = """SELECT count(*) AS rows, sum(('0x' || substr(digest, 1, 16))::UBIGINT)::VARCHAR || '-'
|| sum(('0x' || substr(digest, 17, 16))::UBIGINT)::VARCHAR AS checksum
FROM (SELECT md5(concat({fields})) AS digest FROM {table})"""


def _field_sql(text: str) -> str:
    return f"coalesce(length({text})::VARCHAR || ':' || {text}, 'null')"


_ORDERS_PRINT_SQL = _FINGERPRINT_SQL.format(
    table="orders",
    fields=", ".join(
        _field_sql(c)
        for c in (
            "o_orderkey::VARCHAR",
            "o_custkey::VARCHAR",
            "o_orderstatus",
            "o_totalprice::VARCHAR",
            "epoch_us(o_orderdate)::VARCHAR",
            "o_orderpriority",
        )
    ),
)


@query("table_fingerprint", _ORDERS_PRINT_SQL)
def _(spark, sf_dir):
    return table_fingerprint(b.table(spark, sf_dir, "orders"))


@query("stored_fingerprint", _ORDERS_PRINT_SQL)
def _(spark, sf_dir):
    """The same of a stored table that grew: the files of the first part are noted, those of the second read."""
    name, orders = f"orders_{uuid.uuid4().hex}", b.table(spark, sf_dir, "orders")
    first = F.coalesce(F.col("o_orderstatus") == "F", F.lit(False))
    try:
        catalog.write_table(orders.where(first), name)
        catalog.stored_fingerprint(spark, name).collect()
        orders.where(~first).write.mode("append").format("parquet").saveAsTable(name)
        found = catalog.stored_fingerprint(spark, name)
        return spark.createDataFrame(found.collect(), found.schema)
    finally:
        for made in (name, catalog.parts_table(name)):
            spark.sql(f"DROP TABLE IF EXISTS {made}")


@query(
    "display_title",
    "SELECT doc_id, CASE WHEN length(text) > 50 THEN substr(text, 1, 47) || '...' ELSE text END AS shown FROM documents",
)
def _(spark, sf_dir):
    documents = b.table(spark, sf_dir, "documents")
    return documents.select("doc_id", attributes.display_text(F.col("text")).alias("shown"))


_PALETTE_SQL = "[" + ", ".join(f"'{n}'" for n, _ in attributes.PALETTE) + "]"
_HEX_SQL = "[" + ", ".join(f"'{h}'" for _, h in attributes.PALETTE) + "]"


@query(
    "legend",
    f"""WITH {CODES_SQL} SELECT label + 1 AS cluster_no, ({_PALETTE_SQL})[least(label, 14) + 1] AS colour_name,
    cluster_id FROM codes""",
)
def _(spark, sf_dir):
    ids = clusters.cluster_ids(b.region_labels(spark, sf_dir), b.ordinals(spark, sf_dir))
    return attributes.legend(ids)


# Customers labelled by the size class of their orders: labels beyond the palette occur.
@query(
    "map_table",
    f"""WITH labelled AS (SELECT o_custkey AS entity, (count(*))::INTEGER AS label FROM orders GROUP BY 1)
    SELECT entity, label, ({_PALETTE_SQL})[least(label, 14) + 1] AS colour_name,
    ({_HEX_SQL})[least(label, 14) + 1] AS colour_hex FROM labelled JOIN customer ON entity = c_custkey""",
)
def _(spark, sf_dir):
    labels = (
        b.table(spark, sf_dir, "orders")
        .groupBy(F.col("o_custkey").alias("entity"))
        .agg(F.count("*").cast("int").alias("label"))
    )
    return attributes.map_table(labels, b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity")))


@query(
    "group_colour",
    """SELECT c_custkey AS entity, party, CASE party WHEN 'R' THEN 'red' WHEN 'D' THEN 'blue' ELSE 'black' END AS colour
    FROM customer LEFT JOIN (SELECT n_nationkey, CASE WHEN n_regionkey < 4 THEN substring('RDIA', n_regionkey + 1, 1)
      END AS party FROM nation) ON c_nationkey = n_nationkey""",
)
def _(spark, sf_dir):
    party = F.when(F.col("n_regionkey") < 4, F.expr("substring('RDIA', n_regionkey + 1, 1)"))
    groups = b.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("entity"), party.alias("party"))
    customers = b.table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("entity"))
    coloured = attributes.attach_group_colour(customers, groups)
    return coloured.select(F.col("c_custkey").alias("entity"), "party", "colour")
