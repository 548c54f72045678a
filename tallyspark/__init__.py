"""Pivot, rollup and significance analytics over large fact tables, on Spark DataFrames."""

from .model import (
    Bucket,
    Condition,
    Dimension,
    Filters,
    LabelRule,
    Lookup,
    Metric,
    Period,
    Rollup,
    Segment,
    SemanticModel,
    derived,
    ratio,
    sql_volume,
    volume,
)

__all__ = [
    "Bucket",
    "Condition",
    "Dimension",
    "Filters",
    "LabelRule",
    "Lookup",
    "Metric",
    "Period",
    "Rollup",
    "Segment",
    "SemanticModel",
    "derived",
    "ratio",
    "sql_volume",
    "volume",
]
