import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tallyspark import (
    Bucket,
    Condition,
    Filters,
    LabelRule,
    Period,
    Segment,
    SemanticModel,
    derived,
    ratio,
    sql_volume,
    volume,
)
from tallyspark.functions import safe_divide, strict_greatest, strict_least
from tallyspark.operators import aggregates, buckets, shape
from tallyspark.operators import derived as der
from tallyspark.operators.running import running_totals

D = dt.date
MODEL = SemanticModel(
    (
        volume("queries", "sum", "{queries}"),
        volume("purchases", "sum", "{purchases}"),
        ratio("rate", "purchases", "queries"),
    )
)


@pytest.fixture(scope="module")
def zero(spark):
    return spark.createDataFrame([("a", 0, 0), ("b", 0, 1), ("c", 4, 1)], "term string, queries long, purchases long")


def test_ratio_of_zero(zero):
    got = {r.term: r.rate for r in der.derived_metrics(zero, [MODEL.metric("rate")]).collect()}
    assert got == {"a": None, "b": None, "c": 0.25}
    got = {r.term: r.rate for r in der.derived_metrics(zero, [MODEL.metric("rate")], default=0.0).collect()}
    assert got == {"a": 0.0, "b": 0.0, "c": 0.25}
    row = zero.select(safe_divide(F.col("purchases"), F.col("queries"), 0.0).alias("v")).collect()
    assert [r.v for r in row] == [0.0, 0.0, 0.25]


def test_dependencies(zero):
    chain = [derived("c", "{b} + 1"), derived("b", "{a} * 2"), derived("a", "{queries} + {purchases}")]
    assert [r.c for r in der.derived_metrics(zero, chain).orderBy("term").collect()] == [1, 3, 11]
    with pytest.raises(ValueError, match="itself"):
        der.derived_metrics(zero, [derived("x", "{y}"), derived("y", "{x}")])
    skipped = der.derived_metrics(zero, [derived("x", "{nothing}"), derived("z", "{x} + 1")])
    assert skipped.columns == zero.columns
    circular = SemanticModel((volume("v", "count", "1"), derived("x", "{y}"), derived("y", "{x}")))
    with pytest.raises(ValueError, match="circle"):
        circular.required_volumes(["x"])


def test_shares(zero):
    got = {r.term: (r.queries_pct, r.purchases_pct, r.percentage_of_total) for r in der.pct_of_total(zero, ["queries", "purchases"]).collect()}
    assert got == {"a": (0.0, 0.0, 0.0), "b": (0.0, 50.0, 0.0), "c": (100.0, 50.0, 100.0)}
    # No positive total at all.
    none = der.pct_of_total(zero.filter("term = 'a'"), ["queries", "purchases"]).first()
    assert (none.queries_pct, none.percentage_of_total) == (0.0, 0.0)


def test_pivot_scopes(zero):
    page = aggregates.pivot(zero, MODEL, ["term"], limit=1, order_by="purchases", scope="page").first()
    assert (page.term, page.purchases_pct) == ("b", 100.0)
    whole = aggregates.pivot(zero, MODEL, ["term"], limit=1, order_by="purchases").first()
    assert (whole.term, whole.purchases_pct) == ("b", 50.0)
    everything = aggregates.pivot(zero, MODEL, []).collect()
    assert [(r.label, r.queries, r.rate) for r in everything] == [("All", 4, 0.5)]


def test_pivot_reads_the_fact_once(spark):
    from tallyspark.catalog import REGISTRY

    for name in ("pivot", "pct_of_total", "share_significance"):
        df = REGISTRY[name].build(spark, "/root/testdata/sf0.001")
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert len(re.findall(r"FileScan parquet [^\n]*events.parquet", final)) <= 1, name
        assert "ReusedExchange" in final


def test_ties_are_ordered(spark):
    df = spark.createDataFrame([(t, 5, 0) for t in "edcba"], "search_term string, queries long, purchases long")
    got = [r.search_term for r in aggregates.top_terms(df, MODEL, limit=3).collect()]
    assert got == ["a", "b", "c"]
    got = [r.search_term for r in aggregates.pivot(df, MODEL, ["search_term"], limit=2, offset=2).collect()]
    assert got == ["c", "d"]


def test_sorting_by_a_metric_that_is_not_shown(zero):
    got = aggregates.pivot(zero, MODEL, ["term"], metrics=["purchases"], order_by="rate")
    assert got.columns == ["term", "label", "purchases", "purchases_pct", "percentage_of_total"]
    assert got.first().term == "c"
    terms = aggregates.top_terms(zero, MODEL, None, ["purchases"], sort_by="queries", term="term", limit=1)
    assert [tuple(r) for r in terms.collect()] == [("c", 1)]


def test_dates_cannot_be_filtered_without_a_date(zero):
    with pytest.raises(ValueError, match="no column 'date'"):
        aggregates.pivot(zero, MODEL, ["term"], Filters(start="2024-01-01"))


def test_nulls_in_groups(spark):
    df = spark.createDataFrame([(None, 1, 0), (None, 2, 0), ("", 4, 0), ("x", 8, 0)], "country string, queries long, purchases long")
    got = {r.dimension_value: r.queries for r in aggregates.breakdown(df, MODEL, "country").collect()}
    assert got == {"__NULL__": 3, "": 4, "x": 8}
    assert [r.value for r in aggregates.dimension_values(df, MODEL, "country").collect()] == ["__NULL__", "", "x"]
    assert aggregates.group_count(df, MODEL, ["country"]).first().total_count == 3
    assert {(r.value, r.position) for r in aggregates.filter_options(df, MODEL, ["country"]).collect()} == {
        ("__NULL__", 1),
        ("", 2),
        ("x", 3),
    }


def test_empty_input(spark, zero):
    none = zero.filter("false")
    assert aggregates.kpi_totals(none, MODEL).first().asDict() == {"queries": 0, "purchases": 0, "rate": 0.0}
    assert aggregates.pivot(none, MODEL, ["term"]).collect() == []
    dated = none.withColumn("date", F.lit("2024-01-01").cast("date"))
    assert aggregates.observed_days(dated, MODEL).first().num_days == 1


def test_day_counts(spark, zero):
    week = Filters(preset="last_7_days", as_of="2024-01-30")
    assert zero.select(aggregates.requested_days(week).alias("n")).first().n == 7
    assert zero.select(aggregates.requested_days(Filters("2024-01-05", "2024-01-01")).alias("n")).first().n == 1
    assert zero.select(aggregates.requested_days(None).alias("n")).first().n == 1


def test_reaggregate_against_brute_force(spark):
    rows = [("a", None, 1), ("a", "x", 2), (None, "x", 4), (None, None, 8), ("b", "y", 16)]
    df = spark.createDataFrame(rows, "p string, q string, v long")
    got = aggregates.reaggregate_metrics(
        df,
        ["p", "q"],
        [
            aggregates.Reaggregation("by_p", "v", ["q"]),
            aggregates.Reaggregation("by_q", "v", ["p"], "max"),
            aggregates.Reaggregation("all", "v", ["p", "q"], "count"),
            aggregates.Reaggregation("same", "v", []),
        ],
    )
    want = {
        (p, q, v, sum(x[2] for x in rows if x[0] == p), max(x[2] for x in rows if x[1] == q), 5, v)
        for p, q, v in rows
    }
    assert {tuple(r) for r in got.collect()} == want
    with pytest.raises(ValueError, match="unknown aggregation"):
        aggregates.reaggregate_metric(df, "v", ["p", "q"], ["q"], "median")


def test_running_totals_against_brute_force(spark):
    # A third of the rows tie on the sort value.
    rows = [(i, 7 if i % 3 == 0 else (i * 37) % 101) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(7)
    got = running_totals(df, [F.col("v").desc(), F.col("id")], {"total": F.col("v"), "position": F.lit(1)})
    want, total = {}, 0
    for n, (i, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), start=1):
        total += v
        want[i] = (total, n)
    assert {r.id: (r.total, r.position) for r in got.collect()} == want


def test_running_totals_of_nothing(spark):
    df = spark.createDataFrame([], "id long, v long")
    assert running_totals(df, [F.col("id")], {"total": F.col("v")}).collect() == []


@pytest.fixture(scope="module")
def overlap(spark):
    return spark.createDataFrame([(5,), (50,), (150,), (1500,), (None,)], "queries long")


def labels(df, name="bucket"):
    return [r[name] for r in df.orderBy(F.col("queries").asc_nulls_last()).collect()]


def test_lowest_minimum_wins(overlap):
    choice = [Bucket("high", min=100), Bucket("middle", min=10, max=200), Bucket("tiny", max=5), Bucket("exact", equals=50)]
    got = labels(buckets.bucket_by_metric(overlap, "queries", choice))
    assert got == ["tiny", "exact", "middle", "high", "Other"]
    assert labels(buckets.bucket_by_metric(overlap, "queries", [])) == ["Other"] * 5


def test_first_rule_wins(overlap):
    rules = [
        LabelRule("big", [Condition(">", 100), Condition("<>", 150)]),
        LabelRule("some", [Condition("between", 50, 2000)]),
        LabelRule("half", [Condition("between", 5)]),
        LabelRule("missing", [Condition("is_null")]),
    ]
    got = labels(overlap.withColumn("bucket", buckets.rule_column(F.col("queries"), rules)))
    assert got == ["Other", "some", "some", "big", "missing"]


def test_rules_on_a_derived_metric(zero):
    rules = [LabelRule("never", [Condition("is_null")]), LabelRule("seldom", [Condition("<=", 0.5)])]
    got = buckets.bucket_by_condition(zero, MODEL, ["term"], "rate", rules)
    assert {r.bucket: (r.queries, r.purchases, r.rate) for r in got.collect()} == {
        "never": (0, 1, None),
        "seldom": (4, 1, 0.25),
    }


def test_last_period_wins(spark):
    days = spark.createDataFrame([(D(2024, 1, d), d) for d in (1, 10, 20, 31)], "date date, queries long")
    periods = [
        Period("first", "2024-01-01", "2024-01-10"),
        Period("second", "2024-01-10", "2024-01-20"),
        Period("unbounded", "2024-01-01"),
        Period("day", preset="today"),
    ]
    got = labels(buckets.bucket_by_period(days, periods, as_of="2024-01-31"), "period")
    assert got == ["first", "second", "second", "day"]


def test_merge_small_rows(zero):
    got = {r.term: r.purchases for r in shape.merge_small_rows(zero, "term", "queries", 1, ["queries", "purchases"]).collect()}
    assert got == {"Other": 1, "c": 1}
    assert shape.merge_small_rows(zero, "term", "queries", 0, ["queries"]).count() == 3


def test_inflation(spark):
    now = spark.createDataFrame([(10, 10), (10, 11)], "a long, b long")
    base = spark.createDataFrame([(20, 20)], "a long, b long").withColumn("c", F.lit(0))
    got = {r.metric: (r.ratio, r.is_inflated) for r in der.baseline_inflation(now.withColumn("c", F.lit(1)), base, ["a", "b", "c"]).collect()}
    assert got == {"a": (1.0, False), "b": (1.05, True)}


def test_segments_override_the_base_filter(spark):
    df = spark.createDataFrame([("x", "p", 1, 0), ("x", "q", 2, 0), ("y", "p", 4, 0), ("y", "q", 8, 0)], "s string, t string, queries long, purchases long")
    base = Filters(dimensions={"s": ["x"], "t": ["p", "q"]})
    segments = [Segment("base", {}), Segment("y", {"s": ["y"]}), Segment("yp", {"s": ["y"], "t": ["p"]})]
    got = aggregates.segment_totals(df, MODEL, segments, ["queries"], base).first()
    assert (got["base__queries"], got["y__queries"], got["yp__queries"]) == (3, 12, 4)
    # A row's own value replaces what a segment says about that dimension.
    rows = aggregates.segment_totals(df, MODEL, [segments[2]], ["queries"], base, by=["s"]).collect()
    assert {r.s: r["yp__queries"] for r in rows} == {"x": 1, "y": 4}


def test_free_sql_metrics(zero):
    model = SemanticModel((sql_volume("net", "sum({queries}) - sum({purchases})"),))
    assert aggregates.kpi_totals(zero, model).first().net == 2
    split = aggregates.segment_totals(zero, model, [Segment("c", {"term": ["c"]}), Segment("d", {"term": ["d"]})], ["net"])
    assert (split.first()["c__net"], split.first()["d__net"]) == (3, None)
    with pytest.raises(ValueError, match="cannot be combined"):
        volume("mean", "avg", "{queries}").merge()
    with pytest.raises(ValueError, match="unknown aggregate"):
        volume("m", "median", "{queries}")


def test_strict_extremes(spark):
    row = spark.range(1).select(
        strict_greatest(F.lit(1), F.lit(None).cast("int")).alias("g"),
        strict_least(F.lit(1), F.lit(2)).alias("l"),
    ).first()
    assert (row.g, row.l) == (None, 1)


def test_approximate_count(spark):
    df = spark.range(20000).select((F.col("id") % 5000).alias("a"), F.lit("k").alias("b"))
    got = aggregates.group_count_approx(df, MODEL, ["a", "b"]).first().total_count
    assert abs(got - 5000) < 5000 * 0.08
    some = df.select(F.when(F.col("a") > 0, F.col("a")).alias("a"), "b")
    with_null = aggregates.group_count_approx(some, MODEL, ["a", "b"]).first().total_count
    assert abs(with_null - 5000) < 5000 * 0.08
    assert aggregates.group_count_approx(df.filter("false"), MODEL, ["a", "b"]).first().total_count == 0
    ranked = aggregates.cardinality_ranking(df, ["b", "a"], top=1).collect()
    assert [(r.column_name, r.position) for r in ranked] == [("a", 1)]


def test_distinct_counts_per_segment(spark):
    rows = [(f"t{i % 5}", f"s{i % 3}", None if i % 11 == 0 else i % 17, i) for i in range(400)]
    df = spark.createDataFrame(rows, "t string, s string, u int, v long")
    model = SemanticModel(
        (
            volume("users", "count_distinct", "{u}"),
            volume("total", "sum", "{v}"),
            volume("n", "count", "{u}"),
            volume("low", "min", "{v}"),
        )
    )
    # The third overlaps the others, the last is empty.
    picks = {"a": ["s0"], "b": ["s1"], "ab": ["s0", "s1"], "none": ["s9"]}
    segments = [Segment(k, {"s": v}) for k, v in picks.items()]
    ids = ["users", "total", "n", "low"]

    def want(select, values):
        chosen = [r for r in rows if select(r) and r[1] in values]
        users = {r[2] for r in chosen if r[2] is not None}
        numbers = [r[3] for r in chosen]
        counted = sum(r[2] is not None for r in chosen)
        return len(chosen), len(users), sum(numbers) if numbers else None, counted, min(numbers, default=None)

    got = aggregates.segment_totals(df, model, segments, ids, by=["t"])
    for r in got.collect():
        for k, values in picks.items():
            cell = tuple(r[f"{k}__{m}"] for m in ("rows", *ids))
            assert cell == want(lambda x, t=r.t: x[0] == t, values), (r.t, k)
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
    whole = aggregates.segment_totals(df, model, segments, ids).first()
    assert tuple(whole[f"ab__{m}"] for m in ("rows", *ids)) == want(lambda x: True, picks["ab"])
    nothing = aggregates.segment_totals(df.filter("false"), model, segments, ids).first()
    assert (nothing["a__rows"], nothing["a__users"], nothing["a__total"], nothing["a__n"]) == (0, 0, None, 0)


@pytest.mark.parametrize("kind", ["long", "double", "decimal(12,2)"])
def test_running_totals_over_gaps_and_batches(spark, kind):
    values = [None, None, 3, None, -1, 4, None, 2] * 40
    rows = [(i, None if v is None or i < 5 else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, v double").select("id", F.col("v").cast(kind).alias("v")).repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [(r.id, r.total) for r in running_totals(df, [F.col("id")], {"total": F.col("v")}).orderBy("id").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, total = [], None
    for i, v in rows:
        total = total if v is None else v if total is None else total + v
        want.append((i, total))
    assert [(i, None if t is None else float(t)) for i, t in got] == want
