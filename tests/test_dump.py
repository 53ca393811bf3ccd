import pytest

from pulsegrid.sources.dump import dump_rows, read_dump

COLUMNS = ["id", "title", "body", "note"]


def rows(spark, *lines, columns=COLUMNS, **options):
    df = spark.createDataFrame([(line,) for line in lines], "value string")
    return [tuple(r) for r in dump_rows(df, "items", columns, **options).collect()]


def test_golden_line(spark):
    line = r"INSERT INTO `items` VALUES (1,'a','x, (y)','it\'s'),(2,'b',NULL,'');"
    assert rows(spark, line) == [("1", "a", "x, (y)", "it's"), ("2", "b", None, "")]


def test_quoted_null_is_text(spark):
    line = "INSERT INTO `items` VALUES (1,'NULL',null,' (')"
    assert rows(spark, line) == [("1", "NULL", None, " (")]


def test_value_edges_that_look_like_rows(spark):
    line = "INSERT INTO `items` VALUES (1,'a)','(b','),('),(2,'c','d','e');"
    assert rows(spark, line) == [("1", "a)", "(b", "),("), ("2", "c", "d", "e")]


def test_marker_inside_a_value(spark):
    line = "INSERT INTO `items` VALUES (1,'see VALUES (2)','b','c');"
    assert rows(spark, line) == [("1", "see VALUES (2)", "b", "c")]


def test_other_lines_are_skipped(spark):
    assert rows(spark, "-- INSERT INTO `items` VALUES (1,2,3,4);", "INSERT INTO `other` VALUES (1,2,3,4);", "") == []


def test_stripping(spark):
    line = r"""INSERT INTO `items` VALUES (1,'a\r\nb"c','say \"hi\"','back\\nslash');"""
    assert rows(spark, line) == [("1", "abc", "say hi", r"back\nslash")]
    assert rows(spark, line, strip=False) == [("1", 'a\r\nb"c', 'say "hi"', r"back\nslash")]


def test_trailing_escaped_backslash(spark):
    assert rows(spark, r"INSERT INTO `items` VALUES (1,'a\\','\\\\','\'');") == [("1", "a\\", "\\\\", "'")]


def test_long_values(spark):
    long = r"it\'s (a), " * 200_000
    got = rows(spark, f"INSERT INTO `items` VALUES (1,'{long}','b','c'),(2,'d','e','f');")
    assert got[0][1] == long.replace("\\", "") and got[1] == ("2", "d", "e", "f")


def test_empty_insert_and_wrong_width_raise(spark):
    with pytest.raises(Exception, match="no rows"):
        rows(spark, "INSERT INTO `items` VALUES ;")
    with pytest.raises(Exception, match="another number of fields"):
        rows(spark, "INSERT INTO `items` VALUES (1,2);")


def test_file(spark, tmp_path):
    path = tmp_path / "dump.sql"
    path.write_text("-- head\nINSERT INTO `items` VALUES (1,'a');\nINSERT INTO `items` VALUES (2,'b'),(3,'c');\n")
    got = read_dump(spark, str(path), "items", ["id", "title"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("1", "a"), ("2", "b"), ("3", "c")]
