import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark import Dimension, Filters, SemanticModel, volume
from tallyspark.functions import DATE_PRESETS, composite_key, dimension_label, preset_bounds, truncate_date
from tallyspark.operators import filters as ops

D = dt.date


@pytest.fixture(scope="module")
def null_dims(spark):
    rows = [
        (D(2024, 1, 1), None, 1),
        (D(2024, 1, 2), "", 2),
        (D(2024, 1, 3), "US", 3),
        (D(2024, 1, 4), "O'Brien", 4),
        (D(2024, 1, 5), "a - b", 5),
    ]
    return spark.createDataFrame(rows, "date date, country string, queries long")


def queries_of(df):
    return sorted(r.queries for r in df.select("queries").collect())


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        (["US"], [3]),
        (["__NULL__"], [1]),
        (["__EMPTY__"], [2]),
        (["O'Brien", "US"], [3, 4]),
        (["__NULL__", "__EMPTY__", "US"], [1, 2, 3]),
        ([], [1, 2, 3, 4, 5]),
        ([""], [2]),
    ],
)
def test_filter_values(null_dims, values, expected):
    assert queries_of(ops.filter_dimensions(null_dims, {"country": values})) == expected


def test_numeric_values_are_typed(null_dims):
    assert queries_of(ops.filter_dimensions(null_dims, {"queries": ["2", "4"]})) == [2, 4]
    assert queries_of(ops.filter_dimensions(null_dims, {"queries": ["__EMPTY__"]})) == []


def test_dimensions_are_anded(null_dims):
    both = {"country": ["US", "O'Brien"], "queries": ["4", "5"]}
    assert queries_of(ops.filter_dimensions(null_dims, both)) == [4]


def test_dates_inclusive_and_open(null_dims):
    assert queries_of(ops.filter_dates(null_dims, "2024-01-02", "2024-01-04")) == [2, 3, 4]
    assert queries_of(ops.filter_dates(null_dims, None, "2024-01-02")) == [1, 2]


def test_clamp_applies_to_an_open_side(null_dims):
    model = SemanticModel((volume("n", "count", "1"),), min_date="2024-01-02", max_date="2024-01-04")
    assert queries_of(ops.apply_filters(null_dims, model, Filters(start="2023-01-01"))) == [2, 3, 4]
    assert queries_of(ops.apply_filters(null_dims, model, None)) == [2, 3, 4]


def test_search_is_literal(spark):
    df = spark.createDataFrame([("50% off", 1), ("500 off", 2), (None, 3), ("A_B", 4), ("AxB", 5)], "t string, queries long")
    assert queries_of(ops.search_values(df, "t", "50%")) == [1]
    assert queries_of(ops.search_values(df, "t", "a_b")) == [4]
    assert queries_of(ops.search_values(df, "t", "  ")) == [1, 2, 3, 4, 5]
    assert queries_of(ops.search_values(df, "queries", "4")) == [4]


def test_tuples(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 7, 2), (None, 7, 3), ("b", 7, 4)], "x string, y int, queries long")
    dims = ["x", "y"]
    assert queries_of(ops.filter_dimension_tuples(df, dims, [("a", None), (None, "7")])) == [1, 3]
    assert queries_of(ops.filter_dimension_tuples(df, dims, [("a", "7"), ("a", "7")])) == [2]
    assert queries_of(ops.filter_dimension_tuples(df, dims, ["a - __NULL__", "b - 7"])) == [1, 4]
    assert queries_of(ops.filter_dimension_tuples(df, ["x"], ["a", "__NULL__"])) == [1, 2, 3]
    keys = df.filter("queries < 3").select("x", "y")
    assert queries_of(ops.filter_dimension_tuples(df, dims, keys)) == [1, 2]


def test_labels_that_look_alike(spark):
    df = spark.createDataFrame([("a - b", "c", 1), ("a", "b - c", 2)], "x string, y string, queries long")
    dims = ["x", "y"]
    # Tuples tell the two apart, a joined label cannot.
    assert queries_of(ops.filter_dimension_tuples(df, dims, [("a", "b - c")])) == [2]
    assert queries_of(ops.filter_dimension_tuples(df, dims, ["a - b - c"])) == [1, 2]


def test_label_and_key(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "")], "x string, y string")
    got = df.select(dimension_label(["x", "y"]).alias("l"), composite_key(["x", "y"]).alias("k")).collect()
    assert [r.l for r in got] == ["ab - c", "a - bc", "__NULL__ - "]
    assert [r.k for r in got] == ["ab|c", "a|bc", "|"]
    assert df.select(dimension_label([]).alias("l")).first().l == "All"


def test_calculated_dimension_filters(null_dims):
    dims = [Dimension("big", "{queries} > 2")]
    got = ops.filter_calculated(null_dims, {"big": ["true"], "country": ["US", "__EMPTY__"]}, dims)
    assert queries_of(got) == [3]


def _resolve(preset, day):
    """Presets spelled out with the calendar, independent of Spark."""
    monday = day - dt.timedelta(day.weekday())
    month = day.replace(day=1)
    quarter = D(day.year, 3 * ((day.month - 1) // 3) + 1, 1)
    year = D(day.year, 1, 1)
    one = dt.timedelta(1)
    before_month = (month - one).replace(day=1)
    last_q_end = quarter - one
    last_q = D(last_q_end.year, last_q_end.month - 2, 1)
    return {
        "today": (day, day),
        "yesterday": (day - one, day - one),
        "last_7_days": (day - 6 * one, day),
        "last_14_days": (day - 13 * one, day),
        "last_30_days": (day - 29 * one, day),
        "last_90_days": (day - 89 * one, day),
        "this_week": (monday, day),
        "last_week": (monday - 7 * one, monday - one),
        "this_month": (month, day),
        "last_month": (before_month, month - one),
        "this_quarter": (quarter, day),
        "last_quarter": (last_q, last_q_end),
        "this_year": (year, day),
        "last_year": (D(day.year - 1, 1, 1), D(day.year - 1, 12, 31)),
        "year_to_date": (year, day),
        "month_to_date": (month, day),
        "quarter_to_date": (quarter, day),
        "week_to_date": (monday, day),
    }[preset]


def test_presets(spark):
    days = [D(2024, 1, 1), D(2024, 2, 29), D(2024, 3, 31), D(2023, 10, 1), D(2024, 12, 31)]
    row = spark.range(1).select(
        *[c.alias(f"{p}|{d}|{i}") for p in DATE_PRESETS for d in days for i, c in enumerate(preset_bounds(p, d))]
    ).first()
    for p in DATE_PRESETS:
        for d in days:
            assert (row[f"{p}|{d}|0"], row[f"{p}|{d}|1"]) == _resolve(p, d), (p, d)
    with pytest.raises(ValueError, match="unknown date preset"):
        preset_bounds("next_week", "2024-01-01")


def test_weeks(spark):
    # 2024-01-07 is a Sunday.
    row = spark.range(1).select(
        truncate_date(F.lit("2024-01-07").cast("date"), "weekly").alias("sunday"),
        truncate_date(F.lit("2024-01-07").cast("date"), "weekly", "monday").alias("monday"),
        truncate_date(F.lit("2024-01-07").cast("date"), "no such").alias("day"),
    ).first()
    assert (row.sunday, row.monday, row.day) == (D(2024, 1, 7), D(2024, 1, 1), D(2024, 1, 7))


def test_date_filter_reaches_the_scan(spark):
    from tallyspark.catalog.models import SHOP, shop

    df = ops.apply_filters(shop(spark, "/root/testdata/sf0.001"), SHOP, Filters(preset="last_7_days", as_of="2024-01-30"))
    plan = df.select("user_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-24T00:00)" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan


def test_required_columns_needs_placeholders(spark):
    df = spark.createDataFrame([(D(2024, 1, 1), 1, 2)], "date date, a int, b int")
    assert ops.required_columns(df, SemanticModel((volume("s", "sum", "{a}"),))).columns == ["date", "a"]
    with pytest.raises(ValueError, match="write columns as"):
        ops.required_columns(df, SemanticModel((volume("s", "sum", "a"),)))
