"""Mergeable distinct counts, segments by index, combinations by digits, rollups from rollups, dates from partitions."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from tallyspark.model import Filters, Lookup, Segment, SemanticModel, ratio, volume
from tallyspark.operators import aggregates, joins, significance
from tallyspark.operators.filters import all_of, dimension_conditions
from tallyspark.plans import rollups as jobs
from tallyspark.sources import stored_dates

D = dt.date
MODEL = SemanticModel(
    metrics=(
        volume("lines", "count", "1"),
        volume("amount", "sum", "{value}"),
        volume("largest", "max", "{value}"),
        volume("users", "count_distinct", "{user}"),
        volume("wins", "count", "CASE WHEN {value} > 5 THEN 1 END"),
        ratio("win_rate", "wins", "lines"),
    ),
)
ADDITIVE = ["lines", "amount", "largest"]


@pytest.fixture(scope="module")
def fact(spark):
    rng = random.Random(11)
    rows = [
        (D(2024, 1, 1 + rng.randrange(20)), rng.choice(["a", "b", "", None]), rng.choice([1, 2, 3, None]), rng.randrange(400), rng.randrange(10))
        for _ in range(4000)
    ]
    rows += [(None, "a", 1, 7, 3)] * 3
    return spark.createDataFrame(rows, "date date, color string, size int, user long, value long").cache()


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- sketches -------------------------------------------------------------------------------------------------


def test_sketches_merge_over_days_and_values(spark, fact, tmp_path):
    path = f"{tmp_path}/r"
    jobs.build_rollup(fact, MODEL, ["date", "color"], path, ["lines", "users"], sketches=True)
    stored = spark.read.parquet(path)
    exact = {r.color: r.users for r in aggregates.grouped(fact, MODEL, ["color"], None, ["users"]).collect()}
    for got in (
        aggregates.pivot_from_rollup(stored, MODEL, ["color"], ["lines", "users"]),
        aggregates.grouped(stored, MODEL, ["color"], None, ["users"], stored=True),
        aggregates.dimension_values_by_metric(stored, MODEL, "color", "users").withColumnRenamed("value", "color"),
    ):
        for r in got.collect():
            want = exact[None if r.color == "__NULL__" else r.color]
            assert abs(r.users - want) <= 0.02 * want + 1
    total = aggregates.rollup_totals(stored, MODEL, ["users"]).first().users
    whole = fact.select("user").distinct().count()
    assert abs(total - whole) <= 0.02 * whole
    added = aggregates.rollup_totals(stored.drop("users__sketch"), MODEL, ["users"]).first().users
    assert added > 3 * whole
    # A single stored row is the exact count, and no row at all is none.
    one = aggregates.pivot_from_rollup(stored, MODEL, ["date", "color"], ["users"], limit=10**6)
    assert rows_of(one.select("date", "color", "users")) == rows_of(stored.select("date", "color", "users"))
    assert aggregates.rollup_totals(stored, MODEL, ["users"], Filters(start="2030-01-01")).first().users == 0
    with pytest.raises(ValueError, match="distinct"):
        MODEL.metric("lines").sketch()


# --- segments by index ------------------------------------------------------------------------------------------


def test_members_are_those_whose_conditions_hold(fact):
    conditions = [
        {"color": ["a", "__NULL__"]},
        {"color": ["__EMPTY__"], "size": ["1", "01", "__NULL__"]},
        {"size": ["2", "3"]},
        {},
        {"size": ["__EMPTY__"]},
        {"color": ["b", "nowhere"], "size": ["3"]},
    ]
    got = aggregates.segment_members(fact, conditions)
    assert got.columns == [*fact.columns, "_segment"]
    for i, c in enumerate(conditions):
        want = fact.filter(all_of(dimension_conditions(fact, c)))
        assert rows_of(got.filter(F.col("_segment") == i).drop("_segment")) == rows_of(want)


def test_a_thousand_segments_make_a_small_plan(spark):
    segments = [Segment(f"s{i}", {"term": [f"t{i}", f"t{i + 1}"]}) for i in range(1000)]
    facts = spark.range(3000).select(
        F.lit("2024-01-01").cast("date").alias("date"), F.concat(F.lit("t"), (F.col("id") % 1500).cast("string")).alias("term"),
        F.col("id").alias("user"), (F.col("id") % 10).alias("value"),
    )

    def planned(df):
        start = time.perf_counter()
        size = len(df._jdf.queryExecution().optimizedPlan().toString())
        return size, time.perf_counter() - start

    start = time.perf_counter()
    few = planned(aggregates.segment_rows(facts, MODEL, segments[:500], ["lines"]))[0]
    long = aggregates.segment_rows(facts, MODEL, segments, ["lines"])
    # What grows is the one value list for the scan.
    size, _ = planned(long.filter("lines > 0"))
    assert size < few + 20_000
    assert {r["_segment"]: r["lines"] for r in long.collect()} == {i: 4 for i in range(1000)}
    tested = significance.segment_significance(facts, MODEL, segments[0], segments[1:], ["win_rate"])
    assert tested.count() == 999
    daily = significance.daily_statistics(facts, MODEL, segments[0], segments[1:], ["lines", "amount"])
    planned(daily)
    assert daily.count() == 2 * 999
    assert time.perf_counter() - start < 60
    start = time.perf_counter()
    planned(significance.segment_significance(facts, MODEL, segments[0], segments[1:], ["win_rate"], rows=["date"]))
    planned(significance.daily_statistics(facts, MODEL, segments[0], segments[1:], ["lines", "amount"]))
    assert time.perf_counter() - start < 10


def test_cells_that_a_row_lacks_are_tested_as_zeros(spark):
    facts = spark.createDataFrame(
        [("x", "A", 9), ("x", "A", 1), ("y", "B", 9), ("z", "A", 9), ("z", "B", 1)], "row string, seg string, value long"
    ).withColumn("user", F.lit(1))
    a, b, c = (Segment(s, {"seg": [s]}) for s in "ABC")
    got = significance.row_significance(facts, MODEL, a, [b, c], ["win_rate"], ["row"]).collect()
    cells = {(r.row, r.segment): (r.control_successes, r.control_trials, r.treatment_successes, r.treatment_trials) for r in got}
    assert cells == {
        ("x", "B"): (1, 2, 0, 0), ("x", "C"): (1, 2, 0, 0), ("y", "B"): (0, 0, 1, 1),
        ("z", "B"): (1, 1, 0, 1), ("z", "C"): (1, 1, 0, 0),
    }
    shares = significance.share_significance(facts, MODEL, a, [b, c], ["lines_pct"], ["row"]).collect()
    cells = {(r.row, r.segment): (r.control_successes, r.control_trials, r.treatment_successes, r.treatment_trials) for r in shares}
    assert cells["y", "B"] == (0, 3, 1, 2) and cells["x", "C"] == (2, 3, 0, 0) and len(cells) == 6
    nothing = facts.filter("value > 100").withColumn("date", F.lit("2024-01-01").cast("date"))
    assert [(r.segment, r.control_n, r.treatment_n) for r in significance.daily_statistics(nothing, MODEL, a, [b], ["lines"]).collect()] == [("B", 0, 0)]


# --- combinations -----------------------------------------------------------------------------------------------


def test_combinations_are_bounded_and_complete(spark, fact):
    got = joins.column_combinations(fact, MODEL, ["color", "size", "value"])
    values = [[str(v) if v is not None else "__NULL__" for v in {r[0] for r in fact.select(c).distinct().collect()}] for c in ("color", "size", "value")]
    want = [(a, b, c, f"{a} - {b} - {c}") for a in values[0] for b in values[1] for c in values[2]]
    assert rows_of(got) == sorted(want, key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "collect_set" not in plan and "Subquery" not in plan and "CartesianProduct" not in plan
    with pytest.raises(ValueError, match=r"160 combinations of columns \(color 4, size 4, value 10\) are more than 100"):
        joins.column_combinations(fact, MODEL, ["color", "size", "value"], most=100)
    assert joins.column_combinations(fact, MODEL, ["color", "size"], Filters(start="2030-01-01")).count() == 0


def test_combinations_read_the_rows_once(spark, fact):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    joins.column_combinations(fact.mapInArrow(seen, fact.schema), MODEL, ["color", "size", "value"]).count()
    assert read.value == 4003


# --- rollups from rollups ---------------------------------------------------------------------------------------


def watched(spark, df):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    return df.mapInArrow(seen, df.schema), read


NESTED = {"all": ["date", "color", "size"], "color": ["date", "color"], "size": ["date", "size"], "day": ["date"], "ever": ["color"]}


@pytest.mark.parametrize("sketches", [False, True])
def test_nested_rollups_read_the_fact_once(spark, fact, tmp_path, sketches):
    metrics = [*ADDITIVE, "users"] if sketches else ADDITIVE
    rollups = {n: (d, f"{tmp_path}/{n}") for n, d in NESTED.items()}
    source, read = watched(spark, fact)
    report = jobs.refresh_all(source, MODEL, rollups, metrics=metrics, sketches=sketches)
    assert all(r.success for r in report.collect()) and read.value == 4003
    for name, (dims, path) in rollups.items():
        stored = spark.read.parquet(path)
        want = jobs.rollup_frame(fact, MODEL, dims, metrics)
        assert rows_of(stored.select(*dims, *ADDITIVE)) == rows_of(want.select(*dims, *ADDITIVE))
        if sketches:
            exact = {tuple(r[d] for d in dims): r.users for r in want.collect()}
            assert all(abs(r.users - exact[tuple(r[d] for d in dims)]) <= 0.02 * r.users + 1 for r in stored.collect())


def test_distinct_counts_without_sketches_come_from_the_fact(spark, fact, tmp_path):
    rollups = {n: (d, f"{tmp_path}/{n}") for n, d in NESTED.items() if n in ("all", "day")}
    jobs.refresh_all(fact, MODEL, rollups)
    got = spark.read.parquet(rollups["day"][1]).select("date", "users")
    assert rows_of(got) == rows_of(jobs.rollup_frame(fact, MODEL, ["date"], ["users"]).select("date", "users"))


def test_incremental_lattice_and_failing_parent(spark, fact, tmp_path):
    early = fact.filter("date <= DATE '2024-01-10'")
    rollups = {n: (d, f"{tmp_path}/{n}") for n, d in NESTED.items() if "date" in d}
    jobs.refresh_all(early, MODEL, {n: rollups[n] for n in ("all", "color")}, metrics=ADDITIVE)
    # A parent that cannot be written, wider than all others.
    report = jobs.refresh_all(fact, MODEL, {"bad": (["date", "color", "size", "nope"], f"{tmp_path}/bad"), **rollups}, metrics=ADDITIVE)
    got = {r.rollup: r for r in report.collect()}
    assert not got["bad"].success and "nope" in got["bad"].message
    assert (got["all"].dates_added, got["color"].dates_added, got["size"].success, got["day"].success) == (10, 10, True, True)
    for name in rollups:
        dims, path = rollups[name]
        dated = fact if name in ("size", "day") else fact.filter("date IS NOT NULL")
        want = jobs.rollup_frame(dated, MODEL, dims, ADDITIVE)
        assert rows_of(spark.read.parquet(path).select(*dims, *ADDITIVE)) == rows_of(want.select(*dims, *ADDITIVE))
    # Nothing new: the fact's dates are looked at once, its rows not at all.
    source, read = watched(spark, fact)
    report = jobs.refresh_all(source, MODEL, rollups, metrics=ADDITIVE, source_dates=[D(2024, 1, d) for d in range(1, 21)])
    assert {r.dates_added for r in report.collect()} == {0} and read.value == 0


# --- dates ------------------------------------------------------------------------------------------------------


def test_dates_come_from_partitions(spark, fact, tmp_path):
    path = f"{tmp_path}/daily"
    assert stored_dates(spark, path) is None
    jobs.build_rollup(fact.filter("date IS NULL OR date <= DATE '2024-01-12'"), MODEL, ["date", "color"], path, ADDITIVE)
    assert stored_dates(spark, path) == [D(2024, 1, d) for d in range(1, 13)]
    fact.write.parquet(f"{tmp_path}/plain")
    assert stored_dates(spark, f"{tmp_path}/plain") is None
    missing = joins.missing_dates(fact, stored_dates(spark, path))
    assert sorted(r[0].day for r in missing.collect()) == list(range(13, 21))
    assert path not in missing._jdf.queryExecution().executedPlan().toString()
    # With the source's dates given too, a refresh reads the rows of the new dates only.
    by_day = f"{tmp_path}/fact"
    fact.filter("date IS NOT NULL").write.partitionBy("date").parquet(by_day)
    dated = spark.read.parquet(by_day)
    source, read = watched(spark, dated.filter("date > DATE '2024-01-12'"))
    assert jobs.refresh_rollup(source, MODEL, ["date", "color"], path, ADDITIVE, source_dates=stored_dates(spark, by_day)) == 8
    assert read.value == dated.filter("date > DATE '2024-01-12'").count()
    assert rows_of(spark.read.parquet(path).filter("date IS NOT NULL").select("date", "color", *ADDITIVE)) == rows_of(
        jobs.rollup_frame(fact.filter("date IS NOT NULL"), MODEL, ["date", "color"], ADDITIVE).select("date", "color", *ADDITIVE)
    )


def test_refresh_of_an_enriched_copy_reads_no_stored_rows(spark, fact, tmp_path):
    path = f"{tmp_path}/copy"
    lookup = Lookup(spark.createDataFrame([("a", "red")], "k string, name string"), "k", "color", {"name": "name"}, unique=True)
    days = [D(2024, 1, d) for d in range(1, 21)]
    jobs.refresh_enriched_source(fact.filter("date <= DATE '2024-01-05'"), MODEL, path, lookups=[lookup])
    assert jobs.refresh_enriched_source(fact, MODEL, path, lookups=[lookup], source_dates=days) == 15
    assert jobs.refresh_enriched_source(fact, MODEL, path, lookups=[lookup], source_dates=days) == 0
    assert stored_dates(spark, path) == days


# --- first values of every dimension ------------------------------------------------------------------------------


def test_filter_options_keep_a_bounded_set(spark, fact):
    nan = float("nan")
    wide = fact.withColumn("ratio", F.when(F.col("value") == 0, -0.0).when(F.col("value") == 1, 0.0).when(F.col("value") == 2, nan).otherwise(F.col("value") / 7))
    wide = wide.withColumn("code", F.concat(F.lit("u"), F.col("user").cast("string"))).repartition(5)
    names = ["color", "size", "ratio", "code", "date"]
    got = aggregates.filter_options(wide, MODEL, names, limit=7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan
    for d in names:
        want = [r["value"] for r in aggregates.dimension_values(wide, MODEL, d, limit=7).collect()]
        have = [r["value"] for r in got.filter(F.col("dimension") == d).orderBy("position").collect()]
        assert have == want, d
    assert aggregates.filter_options(wide.filter("user < 0"), MODEL, names).count() == 0
