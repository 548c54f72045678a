"""Custom dimensions: buckets on metrics, rules on metrics, named periods."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_date, preset_bounds
from ..model import OTHER, Bucket, Condition, Filters, LabelRule, Metric, Period, SemanticModel
from .aggregates import derivations, grouped
from .derived import derived_metrics
from .filters import all_of

_COMPARE = {
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<>": lambda c, v: c != v,
}


def first_match(choices: Sequence[tuple[Column, str]], otherwise: str = OTHER) -> Column:
    """The label of the first condition that holds."""
    if not choices:
        return F.lit(otherwise)
    (condition, label), *rest = choices
    chain = F.when(condition, F.lit(label))
    for condition, label in rest:
        chain = chain.when(condition, F.lit(label))
    return chain.otherwise(F.lit(otherwise))


def bucket_column(metric: Column, buckets: Sequence[Bucket]) -> Column:
    """Bucket label of a metric; where buckets overlap the one with the lowest minimum wins.

    Among equal minimums the bucket listed last wins.
    """
    choices = []
    lowest_first = sorted(reversed(buckets), key=lambda b: float("-inf") if b.min is None else b.min)
    for bucket in lowest_first:
        tests = []
        if bucket.min is not None:
            tests.append(metric >= bucket.min)
        if bucket.max is not None:
            tests.append(metric <= bucket.max)
        if bucket.equals is not None:
            tests.append(metric == bucket.equals)
        if tests:
            choices.append((all_of(tests), bucket.label))
    return first_match(choices)


def bucket_by_metric(
    df: DataFrame, metric: str, buckets: Sequence[Bucket], name: str = "bucket"
) -> DataFrame:
    """Label aggregated rows by a metric."""
    return df.withColumn(name, bucket_column(F.col(metric), buckets))


def condition_column(metric: Column, condition: Condition) -> Column | None:
    """One test on a metric, or None when its value is missing or the operator unknown."""
    if condition.operator == "is_null":
        return metric.isNull()
    if condition.operator == "is_not_null":
        return metric.isNotNull()
    if condition.value is None:
        return None
    if condition.operator == "between":
        return None if condition.value_max is None else metric.between(condition.value, condition.value_max)
    compare = _COMPARE.get(condition.operator)
    return compare(metric, condition.value) if compare else None


def rule_column(metric: Column, rules: Sequence[LabelRule]) -> Column:
    """Label of the first rule whose usable conditions all hold."""
    choices = []
    for rule in rules:
        tests = [t for t in (condition_column(metric, c) for c in rule.conditions) if t is not None]
        if tests:
            choices.append((all_of(tests), rule.label))
    return first_match(choices)


def bucket_by_condition(
    df: DataFrame,
    model: SemanticModel,
    dimensions: Sequence[str],
    metric: str,
    rules: Sequence[LabelRule],
    filters: Filters | None = None,
    metrics: Sequence[str] | None = None,
    name: str = "bucket",
) -> DataFrame:
    """Aggregate by the base dimensions, label each group by a metric, then sum volumes per label.

    The label may look at a derived metric; derived metrics of the result come from the sums.
    """
    wanted = None if metrics is None else list(dict.fromkeys([*metrics, metric]))
    base = grouped(df, model, dimensions, filters, wanted)
    labelled = base.withColumn(name, rule_column(F.col(metric), rules))
    volumes = [m.id for m in model.required_volumes(metrics)]
    return derived_metrics(reaggregate_by_bucket(labelled, name, volumes), derivations(model, metrics))


def period_column(day: Column, periods: Sequence[Period], as_of: str | date | None = None) -> Column:
    """Label of the period a day falls in; where periods overlap the one listed last wins."""
    choices = []
    for period in reversed(periods):
        if period.preset:
            start, end = preset_bounds(period.preset, as_of or date.today())
        elif period.start and period.end:
            start, end = as_date(period.start), as_date(period.end)
        else:
            continue
        choices.append((day.between(start, end), period.label))
    return first_match(choices)


def bucket_by_period(
    df: DataFrame,
    periods: Sequence[Period],
    date_column: str = "date",
    as_of: str | date | None = None,
    name: str = "period",
) -> DataFrame:
    """Label fact rows by named periods, before any aggregation."""
    return df.withColumn(name, period_column(F.col(date_column), periods, as_of))


def reaggregate_by_bucket(df: DataFrame, name: str, metrics: Sequence[str | Metric]) -> DataFrame:
    """Sum metrics per label."""
    ids = [m.id if isinstance(m, Metric) else m for m in metrics]
    return df.groupBy(name).agg(*[F.sum(i).alias(i) for i in ids])
