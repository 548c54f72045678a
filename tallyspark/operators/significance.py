"""Significance of differences between compared columns.

The z-test is column arithmetic over rows that already hold both groups' counts, so a comparison
of any number of rows and columns is one aggregation and nothing leaves the JVM. Only the Monte
Carlo test of daily values draws random numbers, in Arrow batches of sufficient statistics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normal import Z_975, normal_tail
from ..model import Filters, Metric, Segment, SemanticModel
from .aggregates import CELL, SEGMENT, segment_rows, treatment_cells
from .aggregates import CONTROL as AGAINST
from .derived import TOTALS

# A metric whose id contains one of these is better when lower.
LOWER_IS_BETTER_KEYWORDS = (
    "bounce",
    "abandon",
    "churn",
    "error",
    "fail",
    "cancel",
    "refund",
    "return",
    "complaint",
    "wait",
    "latency",
    "cost",
    "exit",
    "drop",
    "loss",
)

# Limits and warning texts of the proportion test.
ALPHA = 0.05
MIN_TRIALS = 30
MIN_SUCCESSES = 5
NO_TRIALS_WARNING = "Insufficient data (zero trials in one or both groups)"
FEW_TRIALS_WARNING = "Small sample size (%d events). Normal approximation may be unreliable."
FEW_SUCCESSES_WARNING = "Very few successes in one group. Consider using exact test."

# Limits and warning texts of the daily test.
DRAWS = 10_000
# Tests whose draws are held at a time.
TESTS_AT_ONCE = 200
SEED = 42
THRESHOLD = 0.95
DAYS_FOR_NORMAL = 30
DAYS_WARNING = 7
MIN_STD = 1e-10
TOO_FEW_DAYS = "Insufficient data (need at least 2 days per group)"
VERY_SMALL_DAYS = "Very small sample size ({} days). Results may be unreliable."
SMALL_DAYS = "Small sample size ({} days). Using t-distribution for more conservative estimates."


def higher_is_better(metric: Column) -> Column:
    """False where the metric id names something to keep low."""
    return ~F.lower(metric).rlike("|".join(LOWER_IS_BETTER_KEYWORDS))


def metric_direction(df: DataFrame, metric: str = "metric") -> DataFrame:
    """Flag per metric id: is a higher value better?"""
    return df.withColumn("higher_is_better", higher_is_better(F.col(metric)))


def proportion_test(
    df: DataFrame,
    control_successes: str = "control_successes",
    control_trials: str = "control_trials",
    treatment_successes: str = "treatment_successes",
    treatment_trials: str = "treatment_trials",
    better_high: Column | None = None,
) -> DataFrame:
    """Two-proportion z-test per row over the given count columns.

    Successes are cut to the trials for the test but reported as cut only where there are trials
    in both groups. Without trials in a group the row is neutral.
    """
    high = F.lit(True) if better_high is None else better_high
    n1, n2 = F.col(control_trials).cast("bigint"), F.col(treatment_trials).cast("bigint")
    raw1, raw2 = F.col(control_successes).cast("bigint"), F.col(treatment_successes).cast("bigint")
    stage = df.withColumns(
        {
            "_usable": (n1 > 0) & (n2 > 0),
            "_n1": n1,
            "_n2": n2,
            "_high": high,
        }
    )
    usable = F.col("_usable")
    stage = stage.withColumns(
        {
            "_x1": F.when(usable, F.least(raw1, F.col("_n1"))).otherwise(raw1),
            "_x2": F.when(usable, F.least(raw2, F.col("_n2"))).otherwise(raw2),
        }
    )
    x1, x2, n1, n2 = (F.col(c) for c in ("_x1", "_x2", "_n1", "_n2"))
    stage = stage.withColumns(
        {
            "_p1": F.when(usable, F.try_divide(x1, n1)).otherwise(0.0),
            "_p2": F.when(usable, F.try_divide(x2, n2)).otherwise(0.0),
            "_pool": F.when(usable, F.try_divide(x1 + x2, n1 + n2)).otherwise(0.0),
        }
    )
    pool = F.col("_pool")
    variance = pool * (1 - pool) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))
    stage = stage.withColumns(
        {
            "_diff": F.col("_p2") - F.col("_p1"),
            "_se": F.when(usable & (pool > 0) & (pool < 1), F.sqrt(variance)).otherwise(0.0),
        }
    )
    diff, se, p1 = F.col("_diff"), F.col("_se"), F.col("_p1")
    stage = stage.withColumn("_z", F.when(se > 0, F.try_divide(diff, se)).otherwise(0.0))
    z = F.col("_z")
    # One tail serves both the two-sided p and P(beat): short code that the JVM still compiles.
    stage = stage.withColumn("_tail", normal_tail(z))
    tail = F.col("_tail")
    significant = usable & (2 * tail < ALPHA)
    better = F.col("_high") == (diff > 0)
    relative = (
        F.when(p1 > 0, F.try_divide(diff, p1)).when(diff == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
    )
    fewest = F.least(n1, n2)
    warning = (
        F.when(~usable, F.lit(NO_TRIALS_WARNING))
        .when(fewest < MIN_TRIALS, F.format_string(FEW_TRIALS_WARNING, fewest))
        .when(F.least(x1, x2) < MIN_SUCCESSES, F.lit(FEW_SUCCESSES_WARNING))
    )
    results = {
        "prob_beat_control": F.when(
            usable, F.when(F.col("_high") == (z > 0), 1 - tail).otherwise(tail)
        ).otherwise(0.5),
        "credible_interval_lower": diff - Z_975 * se,
        "credible_interval_upper": diff + Z_975 * se,
        "mean_difference": diff,
        "relative_difference": relative,
        "is_significant": significant,
        "direction": F.when(~significant, "neutral").when(better, "better").otherwise("worse"),
        "control_mean": p1,
        "treatment_mean": F.col("_p2"),
        "n_control_events": n1,
        "n_treatment_events": n2,
        "warning": warning,
    }
    replaced = {control_successes: x1, treatment_successes: x2}
    kept = [replaced[c].alias(c) if c in replaced else F.col(c) for c in df.columns if c not in results]
    return stage.select(*kept, *[c.alias(n) for n, c in results.items()])


def eligible_metrics(model: SemanticModel, wanted: Sequence[str] | None = None) -> list[Metric]:
    """Percent metrics that are a plain ratio of two metrics of the model."""
    return [
        m
        for m in model.metrics
        if (wanted is None or m.id in wanted)
        and m.numerator
        and m.format == "percent"
        and model.has_metric(m.numerator)
        and model.has_metric(m.denominator)
    ]


def share_metrics(model: SemanticModel, wanted: Sequence[str]) -> dict[str, str]:
    """``<metric>_pct`` ids and the metric each is a share of."""
    return {
        id: id.removesuffix("_pct")
        for id in wanted
        if id.endswith("_pct") and model.has_metric(id.removesuffix("_pct"))
    }


def _labelled(segments: Sequence[Segment]) -> Column:
    """The label of a row's segment, from one array for all of them."""
    return F.get(F.array(*[F.lit(s.label) for s in segments]), F.col(SEGMENT))


def _count(value: Column) -> Column:
    return F.coalesce(value, F.lit(0)).cast("bigint")


def _test(metric: str, high: Column, x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    return F.struct(
        F.lit(metric).alias("metric_id"),
        high.alias("_better_high"),
        _count(x1).alias("control_successes"),
        _count(n1).alias("control_trials"),
        _count(x2).alias("treatment_successes"),
        _count(n2).alias("treatment_trials"),
    )


def _test_rows(cells: DataFrame, rows: Sequence[str], segments: Sequence[Segment], tests: list[Column]) -> DataFrame:
    long = cells.select(
        *rows, _labelled(segments).alias("segment"), F.col(SEGMENT).alias("column_index"), F.inline(F.array(*tests))
    )
    order = ["metric_id", "segment", "column_index", "_better_high"]
    long = long.select(*rows, *order, *[c for c in long.columns if c not in {*rows, *order}])
    long = long.filter((F.col("control_trials") != 0) | (F.col("treatment_trials") != 0))
    return proportion_test(long, better_high=F.col("_better_high")).drop("_better_high")


def segment_significance(
    df: DataFrame,
    model: SemanticModel,
    control: Segment,
    treatments: Sequence[Segment],
    metrics: Sequence[str],
    filters: Filters | None = None,
    rows: Sequence[str] = (),
    stored: bool = False,
) -> DataFrame:
    """Each treatment column against the control for every eligible ratio, per row if ``rows`` is given.

    The counts of all columns come from one aggregation by row and column and stay long: each cell meets its row's control
    where the row is, and is tested there. The plan has the same size for any number of columns.
    """
    eligible = eligible_metrics(model, metrics)
    if not eligible:
        raise ValueError("no metric is a percent ratio of two metrics")
    needed = list(dict.fromkeys(n for m in eligible for n in (m.numerator, m.denominator)))
    segments = [control, *treatments]
    volumes = [m.id for m in model.required_volumes(needed)]
    long = segment_rows(df, model, segments, volumes, filters, rows, stored)
    cells = treatment_cells(long, volumes, rows, len(segments))
    old, new = F.col(AGAINST), F.col(CELL)
    tests = [
        _test(m.id, higher_is_better(F.lit(m.id)), old[m.numerator], old[m.denominator], new[m.numerator], new[m.denominator])
        for m in eligible
    ]
    return _test_rows(cells, rows, segments, tests)


def row_significance(
    df: DataFrame,
    model: SemanticModel,
    control: Segment,
    treatments: Sequence[Segment],
    metrics: Sequence[str],
    rows: Sequence[str],
    filters: Filters | None = None,
    stored: bool = False,
) -> DataFrame:
    """The same per pivot row."""
    return segment_significance(df, model, control, treatments, metrics, filters, rows, stored)


def share_significance(
    df: DataFrame,
    model: SemanticModel,
    control: Segment,
    treatments: Sequence[Segment],
    metrics: Sequence[str],
    rows: Sequence[str],
    filters: Filters | None = None,
    stored: bool = False,
) -> DataFrame:
    """Row shares of a column's total: successes are the cell, trials the column over all rows.

    The totals, one entry per column, are a list in the place of the column that every cell looks its own up in.
    """
    shares = share_metrics(model, metrics)
    if not shares:
        raise ValueError("no metric is a share (<metric>_pct) of a metric of the model")
    segments = [control, *treatments]
    base = list(dict.fromkeys(shares.values()))
    long = segment_rows(df, model, segments, base, filters, rows, stored)
    filtered = {d for s in segments for d in s.dimensions} | set((filters or Filters()).dimensions)
    additive = all(model.metric(m).agg in ("sum", "count") for m in base)
    if additive and not filtered & set(rows):
        # The rows add up to the columns, from the same shuffle.
        by_segment = long.groupBy(SEGMENT).agg(*[F.sum(m).alias(m) for m in base])
    else:
        # A column keeps its own filter on a row dimension, and distinct counts do not add up.
        by_segment = segment_rows(df, model, segments, base, filters, (), stored)
    entry = F.struct(F.col(SEGMENT), *[F.col(m) for m in base])
    totals = by_segment.agg(F.collect_list(entry).alias("totals")).select(
        # A place for every column, those without rows empty.
        F.sort_array(
            F.concat(
                "totals",
                F.transform(
                    F.array_except(F.sequence(F.lit(0), F.lit(len(segments) - 1)), F.transform("totals", lambda t: t[SEGMENT])),
                    lambda i: F.struct(i.alias(SEGMENT), *[F.lit(None).cast(by_segment.schema[m].dataType).alias(m) for m in base]),
                ),
            )
        ).alias("totals")
    )
    cells = treatment_cells(long, base, rows, len(segments)).withColumn(TOTALS, totals.scalar())
    old, new = F.col(AGAINST), F.col(CELL)
    whole, own = F.get(F.col(TOTALS), F.lit(0)), F.get(F.col(TOTALS), F.col(SEGMENT))
    tests = [_test(id, F.lit(True), old[m], whole[m], new[m], own[m]) for id, m in shares.items()]
    return _test_rows(cells, rows, segments, tests)


_DAILY_SCHEMA = """
    metric_id string, segment string, prob_beat_control double, credible_interval_lower double,
    credible_interval_upper double, mean_difference double, relative_difference double,
    is_significant boolean, direction string, control_mean double, treatment_mean double,
    n_days bigint, warning string
"""


def _daily_sampler():
    """The batch function of the daily test.

    Everything it needs is defined or bound here, so it travels to the executors by value and they
    need numpy and pandas only, not this package.
    """
    draws, seed, threshold, min_std, chunk = DRAWS, SEED, THRESHOLD, MIN_STD, TESTS_AT_ONCE
    for_normal, for_warning = DAYS_FOR_NORMAL, DAYS_WARNING
    too_few, very_small, small = TOO_FEW_DAYS, VERY_SMALL_DAYS, SMALL_DAYS
    names = [c.split()[0] for c in _DAILY_SCHEMA.split(",")]

    def simulate(tests, np):
        """(probability of being better, interval) of tests whose groups call for the same distributions."""
        rng = np.random.RandomState(seed)
        sides = []
        for side in ("control", "treatment"):
            n = tests[f"{side}_n"].to_numpy()
            unit = rng.standard_t(n[0] - 1, draws) if n[0] < for_normal else rng.normal(0.0, 1.0, draws)
            sem = np.maximum(tests[f"{side}_std"].to_numpy(float), min_std) / np.sqrt(n)
            sides.append(tests[f"{side}_avg"].to_numpy(float)[:, None] + sem[:, None] * unit)
        difference = sides[1] - sides[0]
        higher = tests["better_high"].to_numpy()[:, None]
        low, high = np.percentile(difference, [2.5, 97.5], axis=1)
        return np.where(higher, difference > 0, difference < 0).mean(axis=1), low, high

    def run(batches):
        import numpy as np

        for batch in batches:
            batch = batch.reset_index(drop=True)
            days = np.minimum(batch["control_n"], batch["treatment_n"]).to_numpy()
            batch["control_avg"] = batch["control_avg"].where(batch["control_n"] > 0, 0.0)
            batch["treatment_avg"] = batch["treatment_avg"].where(batch["treatment_n"] > 0, 0.0)
            prob, low, high = np.full(len(batch), 0.5), np.zeros(len(batch)), np.zeros(len(batch))
            usable = batch[days >= 2]
            # One set of draws serves all tests with as many days, up to where the normal takes over.
            keys = [np.minimum(usable[f"{s}_n"], for_normal) for s in ("control", "treatment")]
            for _, group in usable.groupby(keys):
                for at in range(0, len(group), chunk):
                    part = group.iloc[at : at + chunk]
                    prob[part.index], low[part.index], high[part.index] = simulate(part, np)
            mean1, mean2 = batch["control_avg"].to_numpy(float), batch["treatment_avg"].to_numpy(float)
            enough = days >= 2
            diff = np.where(enough, mean2 - mean1, 0.0)
            large = enough & (np.abs(mean1) > min_std)
            # `prob` already means "better", also for metrics to keep low.
            direction = np.select([enough & (prob >= threshold), enough & (prob <= 1 - threshold)], ["better", "worse"], "neutral")
            warning = [
                too_few if d < 2 else very_small.format(d) if d < for_warning else small.format(d) if d < for_normal else None
                for d in days.tolist()
            ]
            out = batch[["metric_id", "segment"]].assign(
                prob_beat_control=prob,
                credible_interval_lower=low,
                credible_interval_upper=high,
                mean_difference=diff,
                relative_difference=np.divide(diff, np.abs(mean1), out=np.zeros(len(batch)), where=large),
                is_significant=direction != "neutral",
                direction=direction,
                control_mean=mean1,
                treatment_mean=mean2,
                n_days=days,
                warning=warning,
            )
            yield out[names]

    return run


def daily_statistics(
    df: DataFrame,
    model: SemanticModel,
    control: Segment,
    treatments: Sequence[Segment],
    metrics: Sequence[str],
    filters: Filters | None = None,
    stored: bool = False,
) -> DataFrame:
    """Number, mean and deviation of the daily values per (metric, treatment), control alongside.

    A day counts for a column when the column has rows on it.
    """
    segments = [control, *treatments]
    # The date is a row dimension here; filters on the range still apply.
    daily = segment_rows(df, model, segments, metrics, filters, [model.date], stored)
    values = F.array(*[F.struct(F.lit(m).alias("metric_id"), F.col(m).cast("double").alias("value")) for m in metrics])
    value = F.col("value")
    moments = [F.count(value).alias("n"), F.avg(value).alias("avg"), F.stddev_samp(value).alias("std")]
    stats = daily.select(SEGMENT, F.inline(values)).groupBy(SEGMENT, "metric_id").agg(*moments)
    # Every metric is there, also where no column has a day.
    names = df.sparkSession.createDataFrame([(m,) for m in metrics], "metric_id string").coalesce(1)
    stats = stats.unionByName(names, allowMissingColumns=True)
    # One row per (column, metric): each treatment's meets the control's, and one without data has zero days.
    cells = treatment_cells(stats, ["n", "avg", "std"], ["metric_id"], len(segments))
    sides = [
        (F.coalesce(F.col(f"{which}.{stat}"), F.lit(0)) if stat == "n" else F.col(f"{which}.{stat}")).alias(f"{side}_{stat}")
        for side, which in (("control", AGAINST), ("treatment", CELL))
        for stat in ("n", "avg", "std")
    ]
    return cells.select("metric_id", _labelled(segments).alias("segment"), higher_is_better(F.col("metric_id")).alias("better_high"), *sides)


def daily_bayes_test(
    df: DataFrame,
    model: SemanticModel,
    control: Segment,
    treatments: Sequence[Segment],
    metrics: Sequence[str],
    filters: Filters | None = None,
    stored: bool = False,
) -> DataFrame:
    """Monte Carlo comparison of mean daily values, from each column's daily count, mean and deviation."""
    return daily_bayes_draws(daily_statistics(df, model, control, treatments, metrics, filters, stored))


def daily_bayes_draws(stats: DataFrame) -> DataFrame:
    """The test of ``daily_statistics``. Tests are dealt over tasks and drawn as arrays, a bounded number at a time."""
    return stats.repartition("metric_id", "segment").mapInPandas(_daily_sampler(), _DAILY_SCHEMA)


__all__ = [
    "LOWER_IS_BETTER_KEYWORDS",
    "daily_bayes_draws",
    "daily_bayes_test",
    "daily_statistics",
    "eligible_metrics",
    "higher_is_better",
    "metric_direction",
    "proportion_test",
    "row_significance",
    "segment_significance",
    "share_metrics",
    "share_significance",
]
