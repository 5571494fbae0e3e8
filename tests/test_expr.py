"""Expressions: the edges that the catalogue doesn't reach."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import expr as E
from quillspark.functions.expr import col, json_path


@pytest.fixture(scope="module")
def df(spark):
    rows = [(1, "Alpha", 7, [1, 2], '{"a": {"b": [1, {"c": "x"}], "t": true, "n": null}}'), (2, "beta%", None, [], None), (3, None, -7, [3], "[1, 2]")]
    return spark.createDataFrame(rows, "id int, s string, n int, arr array<int>, j string")


def ids(df, condition):
    return [r.id for r in df.filter(E.column(condition)).orderBy("id").collect()]


def one(df, e):
    return [r[0] for r in df.orderBy("id").select(E.column(e)).collect()]


def test_null_and_list_operands(df):
    assert ids(df, col("n").eq(None)) == [2] and ids(df, col("n").neq(None)) == [1, 3]
    assert ids(df, col("n").eq([7, 8])) == [1] and ids(df, col("n").neq([7])) == [3]
    assert ids(df, col("id").in_([])) == [] and ids(df, col("id").not_in([])) == [1, 2, 3]


def test_literal_matching(df):
    assert ids(df, col("s").contains("%")) == [2] and ids(df, col("s").ends_with("%")) == [2]
    assert ids(df, col("s").matches(re.compile("^ALPHA$", re.I))) == [1]
    assert ids(df, col("s").match_against("ALPHA gamma", any_word=True)) == [1] and ids(df, col("s").match_against("")) == []


def test_division_and_substring(df):
    assert one(df, col("n", "int").div(2)) == [3, None, -3] and one(df, col("n").div(2)) == [3.5, None, -3.5]
    assert one(df, col("n").mod(4)) == [3, None, -3]
    assert one(df, col("s").substring(1, 3)) == ["lp", "et", None] and one(df, col("s").substring(2)) == ["pha", "ta%", None]
    with pytest.raises(ValueError):
        col("s").substring(-1)
    assert one(df, col("s").concat(None, "!")) == ["Alpha!", "beta%!", "!"] and one(df, col("s").index_of("z")) == [-1, -1, None]


def test_arity_errors():
    for f in (lambda: E.coalesce(1), lambda: E.greatest(1), lambda: E.least(1), lambda: E.ntile(0), lambda: E.nth_value("x", 0), lambda: E.percentile_cont(2, "x"), lambda: E.tuple_("a", "b").in_([(1,)]), lambda: E.case().end(), lambda: E.case().then(1), lambda: E.Agg("median", F.lit(1)), lambda: E.date_diff("eon", "a", "b"), lambda: E.window().rows_between("SOME", "ROW")):
        with pytest.raises(ValueError):
            f()


def test_tuples(df):
    t = E.tuple_("id", "n")
    assert ids(df, t.in_([(1, 7), (3, 7)])) == [1] and ids(df, t.in_([])) == [] and ids(df, t.not_in([])) == [1, 2, 3] and ids(df, t.eq((3, -7))) == [3]


def test_json(df):
    j = json_path("j")
    assert E.parse_json_path("a.b[0][\"k k\"].c") == ["a", "b", 0, "k k", "c"]
    with pytest.raises(ValueError):
        E.parse_json_path("a[")
    assert one(df, j.a.b[1].c) == ["x", None, None] and one(df, j.path("a.b").array_length()) == [2, None, None]
    assert one(df, j.a.has_key("n")) == [True, False, False] and one(df, j.a.t.eq(True)) == [True, None, None]
    assert one(df, j.contains({"a": {"b": [{"c": "x"}]}})) == [True, False, False] and one(df, j.contains([2])) == [False, False, True]
    assert one(df, j.contains(2)) == [False, False, True] and one(df, j.a.contains({"n": None})) == [True, False, False]
    assert one(df, j.type_of()) == ["object", None, "array"] and one(df, j.a.b[0].type_of()) == ["number", None, None] and one(df, j.a.t.type_of()) == ["boolean", None, None]


def test_arrays(df):
    assert one(df, col("arr").array_contains([1])) == [True, False, False] and one(df, col("arr").array_contains([])) == [True, True, True]
    assert one(df, col("arr").array_contained_by([1, 2])) == [True, True, False] and one(df, col("arr").array_overlaps([2, 3])) == [True, False, True]


def test_order_of_nulls(df):
    order = lambda o: [r.id for r in df.orderBy(o.column).collect()]
    assert order(col("n").asc()) == [3, 1, 2] and order(col("n").desc()) == [2, 1, 3] and order(col("n").asc().nulls_first()) == [2, 3, 1] and order(E.order_of(("n", "DESC")).nulls_last()) == [1, 3, 2]


def test_dates(spark):
    d = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-31 10:00:00' AS a, TIMESTAMP_NTZ '2024-03-01 09:00:00' AS b")
    assert d.select(col("a").add_months(1).column).head()[0] == datetime.datetime(2024, 2, 29, 10)
    assert d.select(E.date_diff("hour", "b", "a").column, E.date_diff("day", "b", "a").column).head() == (719, 29)
    assert d.select(col("a").day_of_week().column, col("a").week().column, E.date_trunc("week", "a").column).head() == (3, 5, datetime.datetime(2024, 1, 29))


def test_aggregate_filters_narrow(df):
    a = col("id").sum().filter(col("id").gt(1)).filter(col("id").lt(3))
    assert df.agg(a.column).head()[0] == 2 and df.agg(E.count().filter(col("n").gt(0)).column).head()[0] == 1
    assert df.agg(E.mode("n").column, E.percentile_cont(0.5, "id").desc().column).head() == (-7, 2.0)
