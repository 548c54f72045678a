"""Derived metrics and shares over aggregated rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Metric, ratio
from .running import running_totals


def derivation_levels(metrics: Sequence[Metric], available: Iterable[str]) -> list[list[Metric]]:
    """Metrics grouped so that each level needs only columns of the levels before it.

    A metric whose inputs exist nowhere is left out, with everything that needs it. Metrics that
    refer to each other in a circle are an error.
    """
    have = set(available)
    waiting = {m.id: m for m in metrics if not m.is_volume and m.id not in have}
    levels: list[list[Metric]] = []
    while waiting:
        ready = [m for m in waiting.values() if all(d in have for d in m.depends_on)]
        if not ready:
            break
        levels.append(ready)
        have |= {m.id for m in ready}
        for m in ready:
            del waiting[m.id]
    for start in waiting.values():
        seen, todo = set(), [d for d in start.depends_on if d in waiting]
        while todo:
            id = todo.pop()
            if id == start.id:
                raise ValueError(f"metric {start.id!r} refers to itself through its formula")
            if id not in seen:
                seen.add(id)
                todo += [d for d in waiting[id].depends_on if d in waiting]
    return levels


def derived_metrics(df: DataFrame, metrics: Sequence[Metric], default: float | None = None) -> DataFrame:
    """Add derived metrics in dependency order; ``default`` replaces NULL results if given."""
    for level in derivation_levels(metrics, df.columns):
        columns = {m.id: m.derive() for m in level}
        if default is not None:
            columns = {id: F.coalesce(c, F.lit(default)) for id, c in columns.items()}
        df = df.withColumns(columns)
    return df


# The preset ratios of the shop, subscription and marketing templates.
ECOMMERCE_RATES = (
    ratio("ctr", "queries_pdp", "queries"),
    ratio("a2c_rate", "queries_a2c", "queries"),
    ratio("conversion_rate", "purchases", "queries"),
    ratio("pdp_conversion", "purchases", "queries_pdp"),
    ratio("revenue_per_query", "gross_purchase", "queries", "revenue", "currency"),
    ratio("aov", "gross_purchase", "purchases", "revenue", "currency"),
)
SAAS_RATES = (ratio("churn_rate", "churned", "users"),)
MARKETING_RATES = (
    ratio("ctr", "clicks", "impressions"),
    ratio("cpc", "spend", "clicks", "cost", "currency"),
)


TOTALS = "_totals"


def totals_of(df: DataFrame, metrics: Sequence[str]) -> Column:
    """Sums over all rows as a struct, evaluated once as a scalar subquery (no join, no collect).

    The other columns are counted along: the subquery then reads exactly what the rows read, so
    both share one shuffle and the fact behind an aggregated frame is scanned once.
    """
    others = [c for c in df.columns if c not in set(metrics)]
    fields = [F.sum(F.col(f"`{m}`")).alias(m) for m in metrics]
    fields += [F.count(F.col(f"`{c}`")).alias(c) for c in others]
    return df.agg(F.struct(*fields).alias(TOTALS)).scalar()


def with_totals(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Every row with the totals in one struct column, so that the plan holds one subquery."""
    return df.withColumn(TOTALS, totals_of(df, metrics))


def share_of(value: Column, total: Column) -> Column:
    """Percentage of a total, 0 where the total is not positive."""
    return F.when(total > 0, F.coalesce(value, F.lit(0)) / total * 100).otherwise(0.0)


def page_totals(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``with_totals`` for the rows of a page, which a limit has put into one task already: a window, no second plan."""
    whole = Window.partitionBy()
    return df.withColumn(TOTALS, F.struct(*[F.sum(F.col(f"`{m}`")).over(whole).alias(m) for m in metrics]))


def pct_of_total(df: DataFrame, metrics: Sequence[str], digits: int = 2, is_page: bool = False) -> DataFrame:
    """Add ``<metric>_pct`` per metric, and ``percentage_of_total`` from the first positive total.

    ``is_page`` says that the rows are few, as after a limit.
    """
    totals = F.col(TOTALS)
    shares = {f"{m}_pct": F.round(share_of(F.col(m), totals[m]), digits) for m in metrics}
    first = F.coalesce(*[F.when(totals[m] > 0, share_of(F.col(m), totals[m])) for m in metrics], F.lit(0.0))
    rows = page_totals(df, metrics) if is_page else with_totals(df, metrics)
    return rows.withColumns({**shares, "percentage_of_total": first}).drop(TOTALS)


def cumulative_share(
    df: DataFrame, order_by: Sequence[Column], share: str = "percentage_of_total"
) -> DataFrame:
    """Running sum of the shares in display order."""
    return running_totals(df, order_by, {"cumulative_percentage": F.col(share)})


def cumulative_count(df: DataFrame, order_by: Sequence[Column], count: str | None = None) -> DataFrame:
    """Running number of terms in display order; a row counts once unless ``count`` names a column."""
    return running_totals(df, order_by, {"cumulative_terms": F.col(count) if count else F.lit(1)})


def baseline_inflation(
    current: DataFrame, baseline: DataFrame, metrics: Sequence[str], threshold: float = 0.01
) -> DataFrame:
    """Per metric: its sum over ``current`` rows against the baseline rollup, flagged when inflated.

    Metrics without a positive baseline are left out.
    """
    now = current.agg(*[F.sum(m).cast("double").alias(m) for m in metrics])
    now = now.withColumn(TOTALS, totals_of(baseline.select(*metrics), metrics))
    # One row in, one row per metric out.
    entries = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(TOTALS)[m].cast("double").alias("baseline"),
                F.col(m).alias("current"),
            )
            for m in metrics
        ]
    )
    long = now.select(F.inline(entries)).filter(F.col("baseline") > 0)
    ratio_column = F.coalesce("current", F.lit(0.0)) / F.col("baseline")
    return long.select(
        "metric",
        "baseline",
        F.coalesce("current", F.lit(0.0)).alias("current"),
        ratio_column.alias("ratio"),
        (ratio_column > 1 + threshold).alias("is_inflated"),
    )
