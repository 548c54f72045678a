"""Sorting, column order, chart layout, small-row merging and stacking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dimension_label
from ..model import OTHER, Filters, Segment, SemanticModel
from .aggregates import grouped, segment_metrics
from .joins import difference_columns


def sort_rows(
    df: DataFrame,
    metric: str,
    ties: Sequence[str],
    ascending: bool = False,
    column: str | None = None,
    control: str | None = None,
    by: str = "value",
) -> DataFrame:
    """Sort by a metric, or in a comparison by the value, diff or pct_diff of one column.

    NULLs come last in both directions; ``ties`` complete the order.
    """
    key = F.col(f"`{column}__{metric}`") if column else F.col(metric)
    if by != "value":
        if not (column and control):
            raise ValueError("diff and pct_diff need the compared and the control column")
        diff, pct = difference_columns(key, F.col(f"`{control}__{metric}`"))
        key = {"diff": diff, "pct_diff": pct}[by]
    first = key.asc_nulls_last() if ascending else key.desc_nulls_last()
    return df.orderBy(first, *[F.col(t).asc_nulls_first() for t in ties])


def sort_by_label(df: DataFrame, dimensions: Sequence[str], ascending: bool = True) -> DataFrame:
    """Alphabetical order of the row labels."""
    label = dimension_label(dimensions)
    return df.withColumn("label", label).orderBy(F.col("label").asc() if ascending else F.col("label").desc())


def order_columns(
    df: DataFrame,
    model: SemanticModel,
    dimensions: Sequence[str],
    metric: str,
    filters: Filters | None = None,
    ascending: bool = False,
) -> DataFrame:
    """Compared columns with their total of a metric and their position, largest first by default.

    Columns to be laid out are few, so their positions are a window over one small result.
    """
    totals = grouped(df, model, dimensions, filters, [metric])
    totals = totals.withColumn("total", F.coalesce(F.col(metric), F.lit(0)))
    first = F.col("total").asc() if ascending else F.col("total").desc()
    order = [first, *[F.col(d).asc_nulls_first() for d in dimensions]]
    keys = totals.select(*dimensions, dimension_label(dimensions).alias("label"), "total")
    return keys.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def chart_series(
    df: DataFrame,
    model: SemanticModel,
    dimension: str,
    segments: Sequence[Segment],
    metrics: Sequence[str],
    filters: Filters | None = None,
    stored: bool = False,
    limit: int | None = 20,
) -> DataFrame:
    """One row per dimension value, one column per (compared column, metric), gaps filled with 0.

    Without segments it is one column per metric, of the first ``limit`` values by the first metric or,
    with None, of all values.
    """
    if not segments:
        rows = grouped(df, model, [dimension], filters, metrics, stored)
        top = rows if limit is None else rows.orderBy(F.col(metrics[0]).desc_nulls_last(), dimension).limit(limit)
        return top.select(dimension, *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in metrics])
    wide = segment_metrics(df, model, segments, metrics, filters, [dimension], stored)
    series = [
        F.coalesce(F.col(f"`{s.label}__{m}`"), F.lit(0)).alias(f"{s.label}_{m}")
        for s in segments
        for m in metrics
    ]
    return wide.select(dimension, *series)


def merge_small_rows(
    df: DataFrame, dimension: str, metric: str, threshold: float, metrics: Sequence[str]
) -> DataFrame:
    """Sum the rows whose metric is below the threshold into one row named Other; 0 disables."""
    if threshold <= 0:
        return df.select(F.col(dimension).cast("string").alias(dimension), *metrics)
    label = F.when(F.col(metric) < threshold, F.lit(OTHER)).otherwise(F.col(dimension).cast("string"))
    return df.groupBy(label.alias(dimension)).agg(*[F.sum(m).alias(m) for m in metrics])


def stack_columns(
    df: DataFrame,
    model: SemanticModel,
    rows: Sequence[str],
    columns: Sequence[str],
    filters: Filters | None = None,
    metrics: Sequence[str] | None = None,
) -> DataFrame:
    """The rows of all compared columns below each other, tagged with their column's label.

    One aggregation by row and column dimensions stands for one query per column plus a union.
    """
    stacked = grouped(df, model, [*rows, *columns], filters, metrics)
    return stacked.withColumns(
        {"combination": dimension_label(columns), "label": dimension_label([*rows, *columns])}
    )


__all__ = ["chart_series", "merge_small_rows", "order_columns", "sort_by_label", "sort_rows", "stack_columns"]
