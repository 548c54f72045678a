import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyspark import Dimension, Filters, Lookup, Rollup, SemanticModel, ratio, volume
from tallyspark.operators import aggregates
from tallyspark.plans import rollups as jobs
from tallyspark.plans import usage
from tallyspark.sources import (
    append_dates,
    column_profile,
    column_role,
    conform_join_key,
    export_csv,
    fact_scan,
    load_lookup,
    path_exists,
    table_info,
    write_daily_table,
)

D = dt.date
MODEL = SemanticModel(
    (volume("queries", "sum", "{queries}"), volume("visitors", "count_distinct", "{visitor}")),
    (Dimension("term"), Dimension("first", "substr({term}, 1, 1)")),
)
SCHEMA = "date date, term string, visitor int, queries long"
ROWS = [(D(2024, 1, 1 + i % 20), f"t{i % 7}", i % 11, i) for i in range(400)]


@pytest.fixture(scope="module")
def fact(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def rows_of(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=str)


def test_batched_equals_one_write(spark, fact, tmp_path):
    one, many = f"{tmp_path}/one", f"{tmp_path}/many"
    jobs.build_rollup(fact, MODEL, ["date", "term"], one)
    assert jobs.build_rollup_batched(fact, MODEL, ["date", "term"], many) == 3
    assert rows_of(spark.read.parquet(one)) == rows_of(spark.read.parquet(many))
    # Rows without a date are kept by both.
    undated = fact.union(spark.createDataFrame([(None, "t1", 1, 5)], SCHEMA))
    jobs.build_rollup(undated, MODEL, ["date", "term"], one)
    jobs.build_rollup_batched(undated, MODEL, ["date", "term"], many)
    assert rows_of(spark.read.parquet(one)) == rows_of(spark.read.parquet(many))
    assert spark.read.parquet(one).filter("date is null").count() == 1
    # Building again replaces the table.
    jobs.build_rollup_batched(fact.filter("date < DATE '2024-01-05'"), MODEL, ["date", "term"], many)
    assert spark.read.parquet(many).select("date").distinct().count() == 4


def test_refresh_adds_missing_dates_only(spark, fact, tmp_path):
    path = f"{tmp_path}/rollup"
    dims = ["date", "term"]
    assert jobs.refresh_rollup(fact.filter("date <= DATE '2024-01-10'"), MODEL, dims, path) == 10
    late = spark.createDataFrame([(D(2024, 1, 3), "late", 1, 1000)], SCHEMA)
    grown = fact.union(late)
    assert jobs.refresh_rollup(grown, MODEL, dims, path) == 10
    once = rows_of(spark.read.parquet(path))
    assert jobs.refresh_rollup(grown, MODEL, dims, path) == 0
    assert rows_of(spark.read.parquet(path)) == once
    # Late rows on a date already there are left out until that date is named.
    assert "late" not in {r.term for r in spark.read.parquet(path).collect()}
    assert jobs.refresh_rollup(grown, MODEL, dims, path, recompute=[D(2024, 1, 3)]) == 1
    assert rows_of(spark.read.parquet(path)) == rows_of(jobs.rollup_frame(grown, MODEL, dims))
    assert jobs.refresh_rollup(grown, MODEL, dims, path, incremental=False) == 20


def test_rollup_adds_up(spark, fact, tmp_path):
    path = f"{tmp_path}/rollup"
    jobs.build_rollup(fact, MODEL, ["date", "first"], path)
    stored = spark.read.parquet(path)
    got = aggregates.pivot_from_rollup(stored, MODEL, ["first"], ["queries"]).collect()
    assert [(r.first, r.queries) for r in got] == [("t", sum(r[3] for r in ROWS))]
    detail = aggregates.pivot_from_rollup(stored, MODEL, ["date"], ["queries"], reaggregate=False, limit=3)
    assert detail.count() == 3
    assert aggregates.rollup_totals(stored, MODEL, ["queries"], Filters(start="2030-01-01")).first().queries == 0
    with pytest.raises(ValueError, match="nothing to select"):
        aggregates.pivot_from_rollup(stored, MODEL, [], [])


def test_rollup_without_metrics_counts_rows(fact):
    none = SemanticModel((), MODEL.dimensions)
    assert sum(r.row_count for r in jobs.rollup_frame(fact, none, ["date"]).collect()) == 400


def test_refresh_all_reports_failures(spark, fact, tmp_path):
    report = jobs.refresh_all(
        fact, MODEL, {"good": (["date"], f"{tmp_path}/good"), "bad": (["date", "nope"], f"{tmp_path}/bad")}
    )
    got = {r.rollup: r for r in report.collect()}
    assert (got["good"].success, got["good"].dates_added, got["good"].row_count) == (True, 20, 20)
    assert (got["bad"].success, got["bad"].status) == (False, "error")
    assert "nope" in got["bad"].message


def test_staleness(fact):
    old = fact.filter("date <= DATE '2024-01-15'")
    stale = jobs.staleness(fact, old).first()
    assert (stale.is_stale, stale.missing_dates, stale.target_max) == (True, 5, D(2024, 1, 15))
    fresh = jobs.staleness(fact, fact).first()
    assert (fresh.is_stale, fresh.missing_dates, fresh.missing_keys) == (False, 0, "")
    keyed = jobs.staleness(fact, fact, keys=[["term", "visitor"]]).first()
    assert (keyed.is_stale, keyed.missing_keys) == (True, "_key_term_visitor")
    absent = jobs.staleness(fact, None).first()
    assert (absent.is_stale, absent.target_exists, absent.source_max) == (True, False, D(2024, 1, 20))


def test_enriched_source_full_and_incremental_agree(spark, fact, tmp_path):
    lookup = Lookup(
        spark.createDataFrame([("t1", "b"), ("t1", "a"), ("t2", "c")], "key string, attr string"), "key", "term", {"group": "attr"}
    )
    how = {"keys": [["term", "visitor"]], "lookups": [lookup], "cluster_by": ["term"]}
    full, grown = f"{tmp_path}/full", f"{tmp_path}/grown"
    jobs.build_enriched_source(fact, MODEL, full, **how)
    jobs.build_enriched_source(fact.filter("date <= DATE '2024-01-12'"), MODEL, grown, exchange=False, **how)
    assert jobs.refresh_enriched_source(fact, MODEL, grown, **how) == 8
    assert rows_of(spark.read.parquet(full)) == rows_of(spark.read.parquet(grown))
    # Duplicated lookup keys never multiply rows.
    assert spark.read.parquet(full).count() == 400
    assert {r.group for r in spark.read.parquet(full).filter("term = 't1'").collect()} == {"a"}


def test_append_replaces_whole_dates(spark, fact, tmp_path):
    path = f"{tmp_path}/daily"
    write_daily_table(fact, path, ["term"])
    day = fact.filter("date = DATE '2024-01-02'").withColumn("queries", F.lit(0).cast("bigint"))
    for _ in range(2):
        append_dates(day, path, ["term"])
    stored = spark.read.parquet(path)
    assert stored.count() == 400
    assert stored.filter("date = DATE '2024-01-02'").agg(F.sum("queries")).first()[0] == 0
    plan = stored.filter("date = DATE '2024-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    # A full write drops the dates it does not have, also in a session that overwrites dynamically.
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        write_daily_table(day, path)
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert spark.read.parquet(path).select("date").distinct().count() == 1
    assert path_exists(spark, path)
    assert not path_exists(spark, f"{path}/nothing")


def test_a_hot_day_is_written_by_several_tasks(spark, tmp_path):
    df = spark.range(0, 400_000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit("2024-01-01")).otherwise(F.lit("2024-01-02")).cast("date").alias("date"),
        F.xxhash64("id").alias("a"),
        F.xxhash64(F.col("id") + 1).alias("b"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "400k")
    try:
        write_daily_table(df, f"{tmp_path}/hot", ["a"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = list((tmp_path / "hot").glob("date=2024-01-02/*.parquet"))
    assert len(files) > 1
    assert spark.read.parquet(f"{tmp_path}/hot").count() == 400_000


def test_table_info(fact):
    info = table_info(fact).first()
    assert (info.min_date, info.max_date, info.total_rows, info.schema_fields) == (D(2024, 1, 1), D(2024, 1, 20), 400, 4)
    bare = table_info(fact.drop("date")).first()
    assert (bare.min_date, bare.has_date_column, bare.total_rows) == (None, False, 400)


def test_fact_scan_by_name(spark, fact):
    fact.createOrReplaceTempView("a_fact")
    assert fact_scan(spark, "a_fact").count() == 400


def test_lookup_files(spark, tmp_path):
    path = f"{tmp_path}/lookup.csv"
    export_csv(spark.createDataFrame([("1", "a", 1.5), ("x", "b", 2.5), ("3", "c", 3.5)], "k string, name string, w double"), path)
    got = load_lookup(spark, path, "k", ["name"], "bigint", save_to=f"{tmp_path}/t").orderBy("name")
    assert [tuple(r) for r in got.collect()] == [(1, "a"), (None, "b"), (3, "c")]
    assert dict(got.dtypes) == {"k": "bigint", "name": "string"}
    with pytest.raises(ValueError, match="join key"):
        load_lookup(spark, path, "nope", ["name"])
    with pytest.raises(ValueError, match="not found"):
        load_lookup(spark, path, "k", ["name", "zip"])
    keys = conform_join_key(spark.createDataFrame([("1.5",), ("z",), ("true",)], "k string"), "k", "double")
    assert [r.k for r in keys.collect()] == [1.5, None, None]


def test_profile(spark):
    df = spark.createDataFrame(
        [(1, "b", True, None), (2, "a", None, 1.5), (2, None, False, 2.5)],
        "total_amount int, search_term string, is_new boolean, n_words double",
    )
    for exact in (True, False):
        got = {r.column: r for r in column_profile(df, samples=2, exact=exact).collect()}
        assert {c: (r.inferred_type, r.role, r.is_filterable, r.null_count, r.unique_count) for c, r in got.items()} == {
            "total_amount": ("INTEGER", "metric", False, 0, 2),
            "search_term": ("STRING", "dimension", False, 1, 2),
            "is_new": ("BOOLEAN", "boolean", True, 1, 2),
            "n_words": ("FLOAT", "dimension", True, 1, 2),
        }
        assert got["search_term"].sample_values == ["a", "b"]
    types = {f.name: f.dataType for f in spark.sql("SELECT 1 AS order_id, DATE '2024-01-01' AS d, 'x' AS attr_red").schema}
    assert [column_role(n, t)[0] for n, t in types.items()] == ["dimension", "date", "boolean"]


def test_coverage(spark):
    log = spark.createDataFrame(
        [
            (1, ["a"], [], ["m"], False),
            (2, ["a"], ["b"], ["m"], False),
            (3, ["a"], None, ["m", "x"], True),
            (4, [], ["b"], ["m"], True),
            (5, ["date", "a"], [], ["m"], False),
            (6, ["c"], [], ["m"], False),
            (7, [], [], None, False),
        ],
        "query_id int, dimensions array<string>, filter_dimensions array<string>, metrics array<string>, distinct_metrics boolean",
    )
    catalogue = [
        Rollup("daily_a", ["date", "a"], ["m", "x"]),
        Rollup("a", ["a"], ["m"]),
        Rollup("a_again", ["a"], ["m"]),
        Rollup("ba", ["b", "a"], ["m"]),
        Rollup("daily_b", ["b", "date"], ["m"]),
        Rollup("c", ["c"], ["m"], ready=False),
        Rollup("abc", ["a", "b", "c"], ["m"]),
        Rollup("dates", ["date"]),
    ]
    got = {r.query_id: (r.rollup_id, r.score, r.needs_reaggregation) for r in jobs.rollup_coverage(log, catalogue).collect()}
    assert got == {
        1: ("a", 150, False),
        2: ("ba", 150, False),
        3: ("daily_a", 80, True),
        4: ("daily_b", 80, True),
        5: ("daily_a", 150, False),
        6: (None, -1, False),
        7: ("dates", 100, True),
    }
    # With a model the distinct metrics are known, and only volumes have to be stored.
    model = SemanticModel((volume("m", "count_distinct", "{u}"), ratio("x", "m", "m")))
    modelled = {r.query_id: (r.rollup_id, r.score) for r in jobs.rollup_coverage(log.drop("distinct_metrics"), catalogue, model).collect()}
    assert modelled[3] == ("a", 150)
    assert modelled[4] == ("daily_b", 80)
    assert modelled[7] == ("dates", 100)
    plan = jobs.rollup_coverage(log, catalogue)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    wanted = {r.dimensions: (r.suggested_id, r.query_count) for r in jobs.rollup_recommendations(log, catalogue[:2]).collect()}
    assert wanted == {"": ("rollup_", 2), "c": ("rollup_c", 1)}
    assert {r.score for r in jobs.rollup_coverage(log, []).collect()} == {-1}


def test_usage(spark):
    log = spark.createDataFrame(
        [
            ("kpi", dt.datetime(2024, 1, 1, 10, 5), 10, 100, 200, True, True),
            ("kpi", dt.datetime(2024, 1, 1, 10, 50), 30, None, None, False, False),
            ("pivot", dt.datetime(2024, 1, 7, 23, 59), 20, 50, 60, True, False),
        ],
        "query_type string, created_at timestamp_ntz, execution_time_ms long, bytes_processed long, bytes_billed long, is_success boolean, cache_hit boolean",
    )
    stats = usage.usage_stats(log).first()
    assert (stats.total_queries, stats.total_bytes_processed, stats.avg_execution_time_ms, stats.error_count) == (3, 150, 20.0, 1)
    assert stats.cache_hit_rate == pytest.approx(1 / 3)
    empty = usage.usage_today(log, "2030-01-01").first()
    assert tuple(empty) == (0, 0, 0, 0.0, 0.0, 0)
    assert [r.query_count for r in usage.usage_timeseries(log, "hourly").collect()] == [2, 1]
    weeks = usage.usage_timeseries(log, "weekly").collect()
    assert [(r.period.date(), r.query_count) for r in weeks] == [(D(2024, 1, 1), 3)]
