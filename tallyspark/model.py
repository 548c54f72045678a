"""The semantic model: metrics, dimensions, lookups, buckets and filters as plain records.

Nothing here runs a job. A record turns into Spark columns when an operator asks for them, so a
query stays one lazy plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_MARKER = "__NULL__"
EMPTY_MARKER = "__EMPTY__"
LABEL_SEPARATOR = " - "
OTHER = "Other"

_PLACEHOLDER = re.compile(r"\{(\w+)\}")

_AGGREGATES = {
    "sum": F.sum,
    "count": F.count,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "count_distinct": F.count_distinct,
    "approx_count_distinct": F.approx_count_distinct,
}

# Size of a stored distinct sketch: 2 ** 14 registers, about 0.8 % off (one standard error), at most 16 KiB a row, far less while few values are in it.
SKETCH_PRECISION = 14
SKETCH_SUFFIX = "__sketch"

# Metrics whose daily values can be added up, or combined by taking the extreme again.
_MERGE = {
    "sum": F.sum,
    "count": F.sum,
    "min": F.min,
    "max": F.max,
    # Summed daily distinct counts overstate the whole (`baseline_inflation` measures by how much), unless the rollup holds sketches.
    "count_distinct": F.sum,
    "approx_count_distinct": F.sum,
}


def placeholders(text: str) -> list[str]:
    """Names written as ``{name}`` in an expression, each once, in order."""
    return list(dict.fromkeys(_PLACEHOLDER.findall(text)))


def fill_placeholders(text: str) -> str:
    """Turn ``{name}`` into a quoted column reference."""
    return _PLACEHOLDER.sub(lambda m: f"`{m.group(1)}`", text)


@dataclass(frozen=True)
class Metric:
    """A volume (an aggregate over fact rows) or a derived value (a formula over other metrics)."""

    id: str
    agg: str | None = None
    expr: str | None = None
    formula: str | None = None
    numerator: str | None = None
    denominator: str | None = None
    category: str = "volume"
    format: str = "number"

    @property
    def is_volume(self) -> bool:
        return self.category == "volume"

    @property
    def is_distinct(self) -> bool:
        return self.agg in ("count_distinct", "approx_count_distinct")

    @property
    def depends_on(self) -> list[str]:
        if self.numerator:
            return [self.numerator, self.denominator]
        return placeholders(self.formula) if self.formula else []

    def aggregate(self, condition: Column | None = None) -> Column:
        """The aggregate over fact rows, or over just the rows that meet ``condition``."""
        if self.agg == "sql":
            if condition is not None:
                raise ValueError(f"metric {self.id!r} is free SQL and cannot be split by a condition")
            return F.expr(fill_placeholders(self.expr)).alias(self.id)
        argument = F.expr(fill_placeholders(self.expr))
        if condition is not None:
            argument = F.when(condition, argument)
        return _AGGREGATES[self.agg](argument).alias(self.id)

    @property
    def sketch_name(self) -> str:
        """The column in which a rollup holds this metric's sketch."""
        return f"{self.id}{SKETCH_SUFFIX}"

    def sketch(self) -> Column:
        """A mergeable sketch of the distinct values that this metric counts, over fact rows; NULL values are left out."""
        if not self.is_distinct:
            raise ValueError(f"metric {self.id!r} counts no distinct values")
        value = F.expr(fill_placeholders(self.expr))
        return F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(value)), SKETCH_PRECISION).alias(self.sketch_name)

    def merged_sketch(self) -> Column:
        """The union of stored sketches, again as a column of the same kind."""
        return F.hll_union_agg(self.sketch_name).alias(self.sketch_name)

    def merge(self, condition: Column | None = None, stored: Iterable[str] = ()) -> Column:
        """Combine stored values of this metric, e.g. over the days of a rollup.

        ``stored`` are the rollup's columns. If its sketch is among them, a distinct count over several stored rows is estimated from the
        union of their sketches; that of a single row is the exact count stored with it.
        """
        if self.is_distinct and self.sketch_name in set(stored) and condition is None:
            one = F.count(F.col(self.id)) == 1
            union = F.hll_sketch_estimate(F.hll_union_agg(self.sketch_name))
            return F.when(one, F.max(F.col(self.id))).otherwise(F.coalesce(union, F.lit(0).cast("bigint"))).alias(self.id)
        if self.agg not in _MERGE:
            raise ValueError(
                f"metric {self.id!r} ({self.agg}) cannot be combined from stored values; "
                "store the sum and the count instead"
            )
        stored = F.col(self.id)
        if condition is not None:
            stored = F.when(condition, stored)
        return _MERGE[self.agg](stored).alias(self.id)

    def derive(self) -> Column:
        """A derived metric over columns that hold the metrics it depends on."""
        if self.numerator:
            return F.try_divide(F.col(self.numerator), F.col(self.denominator))
        return F.expr(fill_placeholders(self.formula))


def volume(id: str, agg: str, expr: str) -> Metric:
    """``agg`` is one of sum, count, avg, min, max, count_distinct, approx_count_distinct."""
    if agg not in _AGGREGATES:
        raise ValueError(f"unknown aggregate {agg!r} for metric {id!r}")
    return Metric(id, agg=agg, expr=expr)


def sql_volume(id: str, expr: str) -> Metric:
    """A volume given as a complete aggregate expression, e.g. ``sum({a}) - sum({b})``."""
    return Metric(id, agg="sql", expr=expr)


def derived(id: str, formula: str, category: str = "conversion", format: str = "number") -> Metric:
    return Metric(id, formula=formula, category=category, format=format)


def ratio(
    id: str, numerator: str, denominator: str, category: str = "conversion", format: str = "percent"
) -> Metric:
    """numerator / denominator, NULL where the denominator is 0."""
    return Metric(id, numerator=numerator, denominator=denominator, category=category, format=format)


@dataclass(frozen=True)
class Dimension:
    """A column, or a calculated dimension when ``expr`` is set (``{col}`` placeholders allowed)."""

    id: str
    expr: str | None = None
    filterable: bool = True
    groupable: bool = True

    def column(self) -> Column:
        return F.expr(fill_placeholders(self.expr)) if self.expr else F.col(self.id)


@dataclass(frozen=True)
class Lookup:
    """Attributes joined onto the fact: ``fact.target = df.key`` brings in ``columns``.

    ``columns`` maps the new dimension name to the lookup's column. ``unique`` says that no key occurs twice, as of a
    primary key or after ``store_lookup``: joins then need not look for duplicates, and a stored lookup of known small size is
    broadcast without moving the fact.
    """

    df: DataFrame
    key: str
    target: str
    columns: Mapping[str, str]
    unique: bool = False


@dataclass(frozen=True)
class Bucket:
    label: str
    min: float | None = None
    max: float | None = None
    equals: float | None = None


@dataclass(frozen=True)
class Condition:
    operator: str
    value: float | None = None
    value_max: float | None = None


@dataclass(frozen=True)
class LabelRule:
    """A label and the conditions that must all hold for it."""

    label: str
    conditions: Sequence[Condition]


@dataclass(frozen=True)
class Period:
    """A named inclusive date range, given by dates or by a relative preset."""

    label: str
    start: str | None = None
    end: str | None = None
    preset: str | None = None


@dataclass(frozen=True)
class Filters:
    """Date range (absolute, or a preset as of a day) and allowed values per dimension."""

    start: str | None = None
    end: str | None = None
    preset: str | None = None
    as_of: str | None = None
    dimensions: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def without(self, names: Iterable[str]) -> Filters:
        drop = set(names)
        return replace(self, dimensions={k: v for k, v in self.dimensions.items() if k not in drop})


@dataclass(frozen=True)
class Segment:
    """One compared column: a label and the dimension values that select its rows."""

    label: str
    dimensions: Mapping[str, Sequence[str]]


@dataclass(frozen=True)
class Rollup:
    """A materialised aggregate: its dimensions (with the date, if daily), metrics and whether it can be read."""

    id: str
    dimensions: Sequence[str]
    metrics: Sequence[str] = ()
    ready: bool = True


@dataclass(frozen=True)
class SemanticModel:
    metrics: Sequence[Metric]
    dimensions: Sequence[Dimension] = ()
    date: str = "date"
    min_date: str | None = None
    max_date: str | None = None
    primary_metric: str | None = None

    def metric(self, id: str) -> Metric:
        for m in self.metrics:
            if m.id == id:
                return m
        raise KeyError(f"unknown metric {id!r}")

    def has_metric(self, id: str) -> bool:
        return any(m.id == id for m in self.metrics)

    @property
    def volumes(self) -> list[Metric]:
        return [m for m in self.metrics if m.is_volume]

    @property
    def sort_metric(self) -> str:
        return self.primary_metric or self.volumes[0].id

    def required_volumes(self, ids: Sequence[str] | None = None) -> list[Metric]:
        """The volumes behind the wanted metrics, in model order."""
        if ids is None:
            return self.volumes
        wanted: set[str] = set()

        def visit(id: str, path: tuple[str, ...]) -> None:
            if id in path:
                raise ValueError("metrics refer to each other in a circle: " + " -> ".join((*path, id)))
            wanted.add(id)
            if self.has_metric(id):
                for dep in self.metric(id).depends_on:
                    visit(dep, (*path, id))

        for id in ids:
            self.metric(id)
            visit(id, ())
        return [m for m in self.volumes if m.id in wanted]

    def calculated_dimensions(self, ids: Iterable[str]) -> list[Dimension]:
        wanted = set(ids)
        return [d for d in self.dimensions if d.expr and d.id in wanted]
