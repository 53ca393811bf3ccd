r"""Rows out of an SQL dump: lines ``INSERT INTO `table` VALUES (..),(..);`` as a Spark job.

Every step is an expression on the line, so a dump of any size is split over the executors by the
text source. Patterns use possessive quantifiers, which Java matches in a loop, so a value may be
megabytes long.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The syntax of an extended INSERT. A quoted string holds anything but a bare quote or
# backslash, or a backslash with the character it escapes.
STRING = r"'(?:[^'\\]++|\\.)*+'"
ROW = rf"(?s)\(((?:{STRING}|[^'()])*+)\)"
FIELD = rf"(?s){STRING}|[^,']++"
MARKER = " VALUES "


def unescape(text: Column, strip: bool = True) -> Column:
    r"""Backslash escapes resolved. With ``strip``, line breaks (\r, \n) and double quotes go."""
    breaks = [(r"\\[rn]", "")] if strip else [(r"\\n", "\n"), (r"\\r", "\r")]
    rest = [(r"\\t", "\t"), (r"\\0", "\0"), (r"\\Z", "\x1a"), (r"(?s)\\(.)", "$1")]

    def resolve(part: Column) -> Column:
        for pattern, put in breaks + rest:
            part = F.regexp_replace(part, pattern, put)
        return F.translate(part, '"', "") if strip else part

    # an escaped backslash is a boundary: what follows it is not escaped by it
    parts = F.split(text, r"\\\\", -1)
    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(parts, resolve), "\\")).otherwise(
        F.translate(text, '"', "") if strip else text
    )


def dump_rows(lines: DataFrame, table: str, columns: Sequence[str], strip: bool = True) -> DataFrame:
    """``lines(value)`` to the rows inserted into ``table``, all strings; NULL is null, '' is empty."""
    head = f"INSERT INTO `{table}`"
    values = F.regexp_extract(F.col("value"), rf"(?s)^.*?{MARKER}\s*+(.*)$", 1)
    checked = F.when(F.startswith(values, F.lit("(")), values).otherwise(
        F.raise_error(F.concat(F.lit(f"no rows in an INSERT INTO {table}: "), F.substring("value", 1, 200)))
    )
    # What is left without the rows must be what stands between and behind them.
    left = F.regexp_replace(checked, ROW, "")
    cut_off = F.concat(F.lit(f"text outside the rows of an INSERT INTO {table}: "), F.substring(left, 1, 200))
    checked = F.when(left.rlike(r"^[\s,]*+;?\s*+$"), checked).otherwise(F.raise_error(cut_off))
    rows = (
        lines.filter(F.startswith("value", F.lit(head)))
        .select(F.explode(F.regexp_extract_all(checked, F.lit(ROW), F.lit(1))).alias("row"))
        .select("row", F.regexp_extract_all("row", F.lit(FIELD), F.lit(0)).alias("field"))
    )
    count = F.size("field")
    complaint = F.concat(F.lit(f"a row of {table} has another number of fields: "), count.cast("string"))
    fields = F.when(count == len(columns), F.col("field")).otherwise(F.raise_error(complaint))

    def value(i: int) -> Column:
        raw = F.trim(F.col("field")[i])
        quoted = F.startswith(raw, F.lit("'"))
        inner = F.substr(raw, F.lit(2), F.char_length(raw) - 2)
        return F.when(quoted, unescape(inner, strip)).when(F.upper(raw) != "NULL", raw)

    return rows.select(fields.alias("field")).select(*[value(i).alias(c) for i, c in enumerate(columns)])


def read_dump(
    spark: SparkSession, path: str, table: str, columns: Sequence[str], strip: bool = True
) -> DataFrame:
    return dump_rows(spark.read.text(path), table, columns, strip)
