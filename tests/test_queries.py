"""Every registered query against DuckDB on the same files, and the shape of its plan."""

import re

import pytest

import __spark_entry__ as entry_points
from tallyspark.catalog import REGISTRY
from tests.oracle import connect, difference, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
# The queries over the training data have tests of their own.
QUERIES = {n: q for n, q in entry_points.queries().items() if n in REGISTRY}
SQL = {n: s for n, s in entry_points.oracle_sql().items() if n in REGISTRY}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = spark_rows(df)
    if name in SQL:
        problem = difference(got, duck_rows(duck, SQL[name]))
        assert problem is None, problem
    else:
        assert got[1]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "search_term"


def test_sql_only_for_registered_queries():
    assert set(SQL) == set(QUERIES) == set(REGISTRY)


@pytest.mark.parametrize("name", ["filter_options", "column_profile"])
def test_values_are_cut_before_the_shuffle(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit .* Partial", plan)


def test_no_unpartitioned_window_over_rows(spark):
    # Those left order one row per slice of a sorted frame, or one row per column of the schema.
    allowed = {"cumulative_share", "cumulative_count", "order_columns", "cardinality_ranking"}
    cheap = ["pivot", "pct_of_total", "filter_options", "reaggregate_metric", "compare_columns", *allowed]
    for name in cheap:
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        windows = re.findall(r"Window \[.*", plan)
        unpartitioned = [w for w in windows if re.search(r"\], \[[^\]]*(ASC|DESC)[^\]]*\]$", w) and w.count("], [") == 1]
        assert not unpartitioned or name in allowed, (name, unpartitioned)
