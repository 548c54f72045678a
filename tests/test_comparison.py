import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark import Filters, Lookup, Segment, SemanticModel, ratio, volume
from tallyspark.functions import norm_cdf
from tallyspark.operators import joins, shape
from tallyspark.operators import significance as tests

MODEL = SemanticModel(
    (
        volume("queries", "sum", "{queries}"),
        volume("purchases", "sum", "{purchases}"),
        volume("visitors", "count_distinct", "{visitor}"),
        ratio("rate", "purchases", "queries"),
        ratio("error_rate", "purchases", "queries"),
        ratio("price", "purchases", "queries", format="currency"),
    )
)


@pytest.fixture(scope="module")
def lookup(spark):
    rows = [("k1", "b", 2), ("k1", "a", 3), ("k2", "c", 1), (None, "z", 9)]
    return spark.createDataFrame(rows, "key string, attr string, n int")


@pytest.fixture(scope="module")
def fact(spark):
    return spark.createDataFrame([(1, "k1"), (2, "k2"), (3, "k3"), (4, None)], "id int, k string")


def test_duplicated_lookup_keys(fact, lookup):
    source = Lookup(lookup, "key", "k", {"attribute": "attr", "n": "n"})
    for salts in (1, 3):
        got = {r.id: (r.attribute, r.n) for r in joins.join_dimensions_dedup(fact, [source], salts).collect()}
        assert got == {1: ("a", 2), 2: ("c", 1), 3: (None, None), 4: (None, None)}
    multiplied = joins.join_dimensions(fact, [source], allow_duplicates=True)
    assert sorted((r.id, r.attribute) for r in multiplied.filter("attribute is not null").collect()) == [
        (1, "a"),
        (1, "b"),
        (2, "c"),
    ]
    with pytest.raises(Exception, match="not unique"):
        joins.join_dimensions(fact, [source]).collect()
    # Not even reading only the fact's columns lets a duplicate through.
    with pytest.raises(Exception, match="not unique"):
        joins.join_dimensions(fact, [source]).select("id").collect()
    with pytest.raises(ValueError, match="not found"):
        joins.join_dimensions_dedup(fact, [Lookup(lookup, "key", "k", {"x": "nope"})])


def test_salted_join_of_a_hot_key(spark):
    rows = [(i, "hot" if i % 3 else f"k{i}") for i in range(3000)]
    fact = spark.createDataFrame(rows, "id int, k string")
    side = spark.createDataFrame([(f"k{i}", i) for i in range(0, 3000, 2)] + [("hot", -1)], "key string, v int")
    got = joins.join_dimensions_dedup(fact, [Lookup(side, "key", "k", {"v": "v"})], salts=8)
    want = {i: -1 if k == "hot" else (int(k[1:]) if int(k[1:]) % 2 == 0 else None) for i, k in rows}
    assert {r.id: r.v for r in got.collect()} == want


@pytest.fixture(scope="module")
def cells(spark):
    rows = [
        # term, segment, visitor, queries, purchases
        ("t1", "A", 1, 100, 10),
        ("t1", "B", 1, 50, 10),
        ("t2", "A", 2, 200, 0),
        ("t3", "B", 3, 10, 5),
        (None, "A", 4, 0, 0),
        (None, "B", 4, 7, 1),
    ]
    return spark.createDataFrame(rows, "term string, segment string, visitor int, queries long, purchases long")


A, B, C = (Segment(s, {"segment": [s]}) for s in "ABC")


def test_compare_keeps_absent_cells_null(cells):
    got = {r.term: r for r in joins.compare_columns(cells, MODEL, ["term"], [A, B], ["queries", "rate"]).collect()}
    t1, t2, t3, none = got["t1"], got["t2"], got["t3"], got[None]
    assert (t1["A__queries"], t1["B__queries"], t1["B__queries_diff"], t1["B__queries_pct_diff"]) == (100, 50, -50, -50.0)
    assert (t1["A__rate"], t1["B__rate"]) == (0.1, 0.2)
    assert t1["B__rate_pct_diff"] == pytest.approx(100.0)
    # Absent in the compared column: the cell is NULL, the difference counts it as 0.
    assert (t2["B__queries"], t2["B__queries_diff"], t2["B__queries_pct_diff"]) == (None, -200, -100.0)
    # Absent or zero in the control: no percentage.
    assert (t3["A__queries"], t3["B__queries_diff"], t3["B__queries_pct_diff"]) == (None, 10, None)
    assert (none["A__queries"], none["B__queries_diff"], none["B__queries_pct_diff"]) == (0, 7, None)


def test_compare_top_rows_of_the_control(cells):
    got = joins.compare_columns(cells, MODEL, ["term"], [A, B], ["queries"], top_rows=2).collect()
    assert [r.term for r in got] == ["t2", "t1"]


def test_match_primary_rows_with_null_keys(cells):
    primary = cells.filter("segment = 'B'")
    got = joins.match_primary_rows(cells, primary, ["term"], "queries", limit=3).collect()
    assert sorted((str(r.term), r.segment) for r in got) == [
        ("None", "A"),
        ("None", "B"),
        ("t1", "A"),
        ("t1", "B"),
        ("t3", "B"),
    ]


def test_combinations(cells):
    got = joins.column_combinations(cells, MODEL, ["segment", "term"]).collect()
    assert sorted(r.label for r in got) == sorted(f"{s} - {t}" for s in "AB" for t in ("t1", "t2", "t3", "__NULL__"))
    seen = joins.observed_combinations(cells, MODEL, ["segment", "term"]).collect()
    assert {r.label for r in seen} < {r.label for r in got} and len(seen) == len({r.label for r in seen})
    assert joins.column_values(cells, "segment", limit=2) == ["A", "B"]
    with pytest.raises(ValueError, match="more than 1"):
        joins.column_values(cells, "segment", limit=1)
    assert [s.label for s in joins.segments_of({"x": ["1", "2"], "y": ["a"]})] == ["1 - a", "2 - a"]


def test_long_form(cells):
    wide = joins.compare_columns(cells, MODEL, ["term"], [A, B], ["queries", "purchases"])
    long = joins.comparison_long(wide, ["term"], [A, B], ["queries", "purchases"])
    got = {(r.term, r.metric): (r["A"], r["B"], r["B diff"], r["B pct_diff"]) for r in long.collect()}
    assert len(got) == 8
    assert got["t1", "purchases"] == (10.0, 10.0, 0.0, 0.0)


def test_sorting_puts_nulls_last(cells):
    wide = joins.compare_columns(cells, MODEL, ["term"], [A, B], ["queries"])
    for ascending, want in ((False, ["t1", "t3", None, "t2"]), (True, [None, "t3", "t1", "t2"])):
        got = shape.sort_rows(wide, "queries", ["term"], ascending, column="B")
        assert [r.term for r in got.collect()] == want
    got = shape.sort_rows(wide, "queries", ["term"], column="B", control="A", by="pct_diff")
    assert [r.term for r in got.collect()] == ["t1", "t2", None, "t3"]
    with pytest.raises(ValueError, match="need the compared"):
        shape.sort_rows(wide, "queries", ["term"], by="diff")


def test_charts_and_order(cells):
    got = {r.term: r for r in shape.chart_series(cells, MODEL, "term", [A, B], ["queries", "rate"]).collect()}
    assert (got["t2"]["A_queries"], got["t2"]["B_queries"], got["t2"]["B_rate"]) == (200, 0, 0.0)
    order = shape.order_columns(cells, MODEL, ["segment"], "purchases").collect()
    assert {(r.label, r.position) for r in order} == {("B", 1), ("A", 2)}
    order = shape.order_columns(cells, MODEL, ["segment"], "purchases", ascending=True).collect()
    assert {(r.label, r.position) for r in order} == {("A", 1), ("B", 2)}


# ---- statistics -------------------------------------------------------------------------------


def phi(z):
    return 0.5 * math.erfc(-z / math.sqrt(2))


def test_normal_integral(spark):
    points = [i / 50 for i in range(-500, 501)]
    df = spark.createDataFrame([(z,) for z in points], "z double")
    for r in df.select("z", norm_cdf(F.col("z")).alias("p")).collect():
        assert abs(r.p - phi(r.z)) < 1e-12


def z_test(x1, n1, x2, n2, high=True):
    """The two-proportion test in plain Python."""
    if n1 <= 0 or n2 <= 0:
        return dict(p=0.5, low=0.0, up=0.0, diff=0.0, rel=0.0, sig=False, direction="neutral", x1=x1, x2=x2)
    x1, x2 = min(x1, n1), min(x2, n2)
    p1, p2, pool = x1 / n1, x2 / n2, (x1 + x2) / (n1 + n2)
    se = 0.0 if pool in (0, 1) else math.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2))
    diff = p2 - p1
    z = diff / se if se > 0 else 0.0
    sig = 2 * (1 - phi(abs(z))) < 0.05
    rel = diff / p1 if p1 > 0 else (0.0 if diff == 0 else math.inf)
    direction = "neutral" if not sig else "better" if (diff > 0) == high else "worse"
    return dict(
        p=phi(z) if high else phi(-z), low=diff - 1.959963984540054 * se, up=diff + 1.959963984540054 * se,
        diff=diff, rel=rel, sig=sig, direction=direction, x1=x1, x2=x2,
    )


def test_proportions_against_plain_python(spark):
    rng = random.Random(5)
    cases = [(100, 1000, 130, 1000), (3, 20, 4, 20), (0, 10, 0, 0), (0, 50, 0, 50), (50, 50, 50, 50), (0, 50, 9, 50), (70, 50, 1, 50)]
    cases += [(rng.randint(0, 400), rng.randint(1, 400), rng.randint(0, 400), rng.randint(1, 400)) for _ in range(300)]
    rows = [(i, *c, i % 2 == 0) for i, c in enumerate(cases)]
    schema = "id int, control_successes long, control_trials long, treatment_successes long, treatment_trials long, high boolean"
    got = tests.proportion_test(spark.createDataFrame(rows, schema), better_high=F.col("high"))
    for r in got.collect():
        want = z_test(*cases[r.id], high=r.high)
        assert r.prob_beat_control == pytest.approx(want["p"], abs=1e-12)
        assert r.credible_interval_lower == pytest.approx(want["low"], abs=1e-12)
        assert r.credible_interval_upper == pytest.approx(want["up"], abs=1e-12)
        assert r.relative_difference == pytest.approx(want["rel"], abs=1e-12)
        assert (r.is_significant, r.direction) == (want["sig"], want["direction"]), cases[r.id]
        assert (r.control_successes, r.treatment_successes) == (want["x1"], want["x2"])


def test_warnings(spark):
    rows = [(0, 10, 0, 0), (3, 20, 4, 25), (3, 100, 40, 100), (30, 100, 40, 100)]
    df = spark.createDataFrame(rows, "control_successes long, control_trials long, treatment_successes long, treatment_trials long")
    assert [r.warning for r in tests.proportion_test(df).collect()] == [
        "Insufficient data (zero trials in one or both groups)",
        "Small sample size (20 events). Normal approximation may be unreliable.",
        "Very few successes in one group. Consider using exact test.",
        None,
    ]


def test_segment_significance(cells):
    got = tests.segment_significance(cells, MODEL, A, [B, C], ["rate", "error_rate", "price", "queries"]).collect()
    # Currency ratios and volumes are not tested.
    assert {(r.metric_id, r.segment) for r in got} == {(m, s) for m in ("rate", "error_rate") for s in "BC"}
    by = {(r.metric_id, r.segment): r for r in got}
    up = by["rate", "B"]
    assert (up.control_successes, up.control_trials, up.treatment_successes, up.treatment_trials) == (10, 300, 16, 67)
    assert up.direction == "better"
    assert by["error_rate", "B"].direction == "worse"
    # A segment without rows has no trials: neutral.
    assert by["rate", "C"].warning.startswith("Insufficient")
    with pytest.raises(ValueError, match="no metric"):
        tests.segment_significance(cells, MODEL, A, [B], ["price"])


def test_row_significance_skips_rows_without_trials(cells):
    got = tests.row_significance(cells.filter("term is not null"), MODEL, A, [B], ["rate"], ["term"]).collect()
    assert {r.term: (r.control_trials, r.treatment_trials) for r in got} == {"t1": (100, 50), "t2": (200, 0), "t3": (0, 10)}
    empty = cells.filter("queries = 0")
    assert tests.row_significance(empty, MODEL, A, [B], ["rate"], ["term"]).collect() == []


def test_share_significance(cells):
    got = {r.term: r for r in tests.share_significance(cells, MODEL, A, [B], ["queries_pct"], ["term"]).collect()}
    assert (got["t1"].control_successes, got["t1"].control_trials) == (100, 300)
    assert (got["t1"].treatment_successes, got["t1"].treatment_trials) == (50, 67)
    # Distinct counts do not add up: the column total is counted by itself.
    distinct = tests.share_significance(cells, MODEL, A, [B], ["visitors_pct"], ["term"]).filter("term = 't1'").first()
    assert (distinct.control_successes, distinct.control_trials) == (1, 3)
    # A filter on the row dimension limits the column total but not the row.
    only = Filters(dimensions={"term": ["t1"]})
    limited = {r.term: r for r in tests.share_significance(cells, MODEL, A, [B], ["queries_pct"], ["term"], only).collect()}
    assert (limited["t1"].control_successes, limited["t1"].control_trials) == (100, 100)
    # The row's 200 are more than the column's 100 and are cut to it.
    assert (limited["t2"].control_successes, limited["t2"].control_trials) == (100, 100)


def test_directions(spark):
    df = spark.createDataFrame([("Bounce_Rate",), ("conversion_rate",), ("http_errors",), ("cost_per_click",)], "metric string")
    assert [r.higher_is_better for r in tests.metric_direction(df).collect()] == [False, True, False, False]


def bayes(control, treatment, high=True):
    """The daily test in plain numpy."""
    n1, n2 = len(control), len(treatment)
    rng = np.random.RandomState(42)

    def draw(values):
        n, mean = len(values), np.mean(values)
        sem = max(np.std(values, ddof=1), 1e-10) / np.sqrt(n)
        return mean + sem * rng.standard_t(n - 1, 10000) if n < 30 else rng.normal(mean, sem, 10000)

    a, b = draw(control), draw(treatment)
    return float(np.mean(b > a if high else b < a)), np.percentile(b - a, [2.5, 97.5]), min(n1, n2)


@pytest.mark.parametrize("days", [1, 5, 20, 40])
def test_daily_test_against_numpy(spark, days):
    rng = random.Random(days)
    control = [rng.randint(80, 120) for _ in range(days)]
    treatment = [rng.randint(90, 130) for _ in range(days)]
    rows = [(i, s, 1, v, 0) for s, vs in (("A", control), ("B", treatment)) for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "i int, segment string, visitor int, queries long, purchases long")
    df = df.withColumn("date", F.expr("date_add(DATE '2024-01-01', i)"))
    r = tests.daily_bayes_test(df, MODEL, A, [B], ["queries"]).first()
    assert r.n_days == days
    if days < 2:
        assert (r.prob_beat_control, r.direction, r.control_mean) == (0.5, "neutral", float(control[0]))
        return
    prob, (low, high), _ = bayes(control, treatment)
    assert r.prob_beat_control == pytest.approx(prob, abs=1e-3)
    assert r.credible_interval_lower == pytest.approx(low, rel=1e-6)
    assert r.credible_interval_upper == pytest.approx(high, rel=1e-6)
    assert r.direction == ("better" if prob >= 0.95 else "worse" if prob <= 0.05 else "neutral")
    assert (r.warning or "").split(" (")[0] == {5: "Very small sample size", 20: "Small sample size", 40: ""}[days]
