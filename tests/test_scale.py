"""What has to hold whatever the size: no prefixes or cuts, pruned scans, plans that do not grow with the columns."""

import datetime as dt
import math
import re
import time

import pytest
from pyspark.sql import functions as F

from tallyspark import Filters, Lookup, Segment, SemanticModel, ratio, volume
from tallyspark.functions.normal import norm_cdf, normal_tail
from tallyspark.operators import aggregates, filters, joins, shape
from tallyspark.plans import rollups
from tallyspark.sources import column_profile, store_lookup, write_daily_table
from tallyspark.sources.tables import _laid_out

MODEL = SemanticModel(
    (
        volume("queries", "sum", "{queries}"),
        volume("users", "count_distinct", "{u}"),
        volume("mean", "avg", "{queries}"),
        ratio("rate", "users", "queries"),
    )
)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    return len(re.findall(r"FileScan parquet", plan_of(df).split("== Initial Plan ==")[0]))


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    rows = spark.range(4000).select(
        F.timestamp_seconds(1704067200 + F.col("id") * 3600 % (20 * 86400)).alias("ts"),
        F.concat(F.lit("t"), F.col("id") % 50).alias("term"),
        F.concat(F.lit("c"), F.col("id") % 7).alias("country"),
        (F.col("id") % 211).alias("u"),
        F.col("id").alias("queries"),
    )
    path = str(tmp_path_factory.mktemp("facts") / "f.parquet")
    rows.withColumn("ts", F.when(F.col("queries") % 97 > 0, F.col("ts"))).write.parquet(path)
    return spark.read.parquet(path).withColumn("date", F.to_date("ts"))


def test_tails_of_the_normal_distribution(spark):
    points = [0.0, 0.3, 1.96, 5.0, 7.07, 7.08, 9.5, 20.0, 37.0]
    got = spark.createDataFrame([(z,) for z in points], "z double").select("z", normal_tail(F.col("z")), norm_cdf(-F.col("z"))).collect()
    for z, tail, below in got:
        want = math.erfc(z / math.sqrt(2)) / 2
        assert tail == pytest.approx(want, rel=1e-10)
        assert below == pytest.approx(want, rel=1e-10)


def test_profile_samples_come_from_all_rows(spark):
    late = spark.range(0, 5000, 1, 1).select("id", F.when(F.col("id") >= 2000, F.col("id") % 9).alias("late"))
    got = {r["column"]: r for r in column_profile(late).collect()}
    assert got["late"]["sample_values"] == ["0", "1", "2", "3", "4"] and got["late"]["null_count"] == 2000
    assert got["id"]["sample_values"] == ["0", "1", "10", "100", "1000"]


def test_chart_without_a_cut(facts):
    assert shape.chart_series(facts, MODEL, "term", [], ["queries"]).count() == 20
    assert shape.chart_series(facts, MODEL, "term", [], ["queries"], limit=None).count() == 50


def test_all_cluster_columns_sort(facts, tmp_path):
    plan = plan_of(_laid_out(facts, "date", ["term", "country", "u", "queries", "ts"]))
    assert re.search(r"Sort \[date.*term.*country.*u#.*queries.*ts#", plan)
    write_daily_table(facts, str(tmp_path / "t"), ["term", "country", "u", "queries", "ts"])


def test_filter_options_agree_with_dimension_values(spark):
    df = spark.createDataFrame(
        [(10, dt.date(2024, 1, 2), "b", 1), (9, dt.date(2023, 12, 31), None, 1), (None, None, "", 1), (100, dt.date(2024, 1, 1), "a", 1), (9, None, "b", 1)],
        "n int, d date, s string, queries long",
    )
    got = {}
    for r in aggregates.filter_options(df, MODEL, ["n", "d", "s"], limit=3).collect():
        got.setdefault(r["dimension"], {})[r["position"]] = r["value"]
    for d in ("n", "d", "s"):
        want = [r["value"] for r in aggregates.dimension_values(df, MODEL, d, limit=3).collect()]
        assert [got[d][i + 1] for i in range(3)] == want
    assert list(got["n"].values()) == ["__NULL__", "9", "10"]


def test_a_page_scans_the_facts_once(facts):
    page = aggregates.pivot(facts, MODEL, ["term"], metrics=["queries", "users"], limit=10, scope="page")
    assert scans(page) == 1
    rows = page.collect()
    assert sum(r["queries"] for r in rows) and sum(r["percentage_of_total"] for r in rows) == pytest.approx(100)


def test_labels_reach_the_scan(facts):
    labels = ["t1 - c1", "t2 - c2", "t9 - x - c4", "alone"]
    got = filters.filter_dimension_tuples(facts, ["term", "country"], labels)
    assert re.search(r"PushedFilters: \[.*In\(country.*In\(term|PushedFilters: \[.*In\(term.*In\(country", plan_of(got))
    want = facts.filter(F.concat_ws(" - ", "term", "country").isin(labels))
    assert got.count() == want.count() > 0
    odd = facts.withColumn("term", F.when(F.col("term") == "t1", "a - b").when(F.col("term") != "t2", F.col("term")))
    assert filters.filter_dimension_tuples(odd, ["term", "country"], ["a - b - c1", "__NULL__ - c2"]).count() > 0


def test_every_batch_is_pruned_and_undated_rows_stay(spark, facts, tmp_path):
    day = [dt.date(2024, 1, 3), dt.date(2024, 1, 4)]
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(ts", plan_of(rollups.on_dates(facts, day)))
    whole, batched = str(tmp_path / "whole"), str(tmp_path / "batched")
    model = SemanticModel((volume("queries", "sum", "{queries}"),))
    rollups.build_rollup(facts, model, ["date", "country"], whole)
    assert rollups.build_rollup_batched(facts, model, ["date", "country"], batched, batch_dates=6, timestamp="ts") == 4
    rows = [sorted(map(str, spark.read.parquet(p).select("date", "country", "queries").collect())) for p in (whole, batched)]
    assert rows[0] == rows[1] and any("None" in r for r in rows[0])


def test_recommendations_count_queries_without_dimensions(spark):
    log = spark.createDataFrame([(None,), ([],), (["b", "a"],)], "dimensions array<string>")
    from tallyspark.plans.rollups import Rollup

    got = {r["dimensions"]: r["query_count"] for r in rollups.rollup_recommendations(log, [Rollup("r", ("z",), ())]).collect()}
    assert got == {"": 2, "a,b": 1}


def test_many_compared_columns_are_planned_quickly(facts):
    segments = [Segment(f"s{i}", {"term": [f"t{i % 50}"], "country": [f"c{i % 7}"]}) for i in range(100)]
    start = time.perf_counter()
    wide = joins.compare_columns(facts, MODEL, ["date"], segments, ["queries", "users", "rate"])
    plan_of(wide)
    assert time.perf_counter() - start < 15
    long = joins.compare_rows(facts, MODEL, ["date"], segments, ["queries", "users", "mean", "rate"])
    assert "Expand" not in plan_of(long)
    first = {(r["date"], r["segment"]): r for r in long.collect()}
    for r in wide.limit(3).collect():
        for s in ("s1", "s8", "s57"):
            cell = first.get((r["date"], s))
            assert r[f"{s}__queries"] == (cell["queries"] if cell else None)


def test_segments_restrict_the_scan(facts):
    segments = [Segment("a", {"term": ["t1"]}), Segment("b", {"term": ["t2", "t3"]})]
    wide = aggregates.segment_totals(facts, MODEL, segments, ["queries"], Filters(dimensions={"country": ["c1"]}))
    assert re.search(r"PushedFilters: \[.*In\(term, \[t1,t2,t3\]\)", plan_of(wide))


def test_a_small_stored_lookup_leaves_the_facts_where_they_are(spark, facts, tmp_path):
    lookup = Lookup(
        spark.createDataFrame([("t1", "x"), ("t1", "a"), ("t2", "b"), (None, "n")], "k string, v string"), "k", "term", {"value": "v"}
    )
    stored = store_lookup(lookup, str(tmp_path / "lookup"))
    joined = joins.join_dimensions_dedup(facts, [stored])
    plan = plan_of(joined)
    assert "BroadcastHashJoin" in plan and not re.search(r"(?<!Broadcast)Exchange ", plan)
    assert {r["value"] for r in joined.filter("term = 't1'").select("value").distinct().collect()} == {"a"}
    assert joined.count() == facts.count()
    # A large one is sort-merged, where adaptive execution can split a hot key.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan_of(joins.join_dimensions_dedup(facts, [stored]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_refresh_can_start_at_a_date(spark, facts):
    target = facts.filter("date < DATE '2024-01-10'").select("date")
    late = joins.missing_dates(facts, target, since=dt.date(2024, 1, 15))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts", plan_of(late))
    assert {r[0].day for r in late.collect()} == set(range(15, 21))
    assert {r[0].day for r in joins.missing_dates(facts, target).collect()} == set(range(10, 21))
