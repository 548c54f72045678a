"""Row filters, calculated dimensions and column selection."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import as_date, preset_bounds
from ..functions.scalars import dimension_label
from ..model import (
    EMPTY_MARKER,
    LABEL_SEPARATOR,
    NULL_MARKER,
    Dimension,
    Filters,
    SemanticModel,
    placeholders,
)


def date_bounds(filters: Filters) -> tuple[Column | None, Column | None]:
    """First and last requested day; a preset is resolved before anything else looks at the range."""
    if filters.preset:
        return preset_bounds(filters.preset, filters.as_of or date.today())
    return (
        as_date(filters.start) if filters.start else None,
        as_date(filters.end) if filters.end else None,
    )


def filter_dates(
    df: DataFrame,
    start: str | date | Column | None = None,
    end: str | date | Column | None = None,
    date_column: str = "date",
) -> DataFrame:
    """Inclusive date range, each side optional.

    Compares against plain dates so the predicate reaches partition pruning, or the timestamp
    column behind ``date``.
    """
    if start is not None:
        df = df.filter(F.col(date_column) >= as_date(start))
    if end is not None:
        df = df.filter(F.col(date_column) <= as_date(end))
    return df


def clamp_dates(
    df: DataFrame, min_date: str | None, max_date: str | None, date_column: str = "date"
) -> DataFrame:
    """Keep rows inside the table's allowed dates, whatever range was requested."""
    return filter_dates(df, min_date, max_date, date_column)


def value_condition(column: Column, data_type: T.DataType, values: Sequence[str]) -> Column:
    """OR of the given values; the markers stand for NULL and the empty string.

    Values arrive as text and are cast to the column's type, never the other way round, so the
    comparison can be pushed to the scan.
    """
    plain = [v for v in values if v not in (NULL_MARKER, EMPTY_MARKER)]
    parts = []
    if plain:
        parts.append(column.isin([F.lit(v).cast(data_type) for v in plain]))
    if NULL_MARKER in values:
        parts.append(column.isNull())
    if EMPTY_MARKER in values:
        empty = column == "" if isinstance(data_type, T.StringType) else F.lit(False)
        parts.append(empty)
    return reduce(or_, parts)


def dimension_conditions(df: DataFrame, dimensions: Mapping[str, Sequence[str]]) -> list[Column]:
    """One condition per filtered dimension; dimensions without values are ignored."""
    return [
        value_condition(F.col(name), df.schema[name].dataType, values)
        for name, values in dimensions.items()
        if values
    ]


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def filter_dimensions(df: DataFrame, dimensions: Mapping[str, Sequence[str]]) -> DataFrame:
    """Values are OR-ed inside a dimension and AND-ed across dimensions."""
    for condition in dimension_conditions(df, dimensions):
        df = df.filter(condition)
    return df


def search_values(df: DataFrame, dimension: str, text: str | None) -> DataFrame:
    """Case-insensitive literal substring match on the value as text."""
    if not text or not text.strip():
        return df
    return df.filter(F.contains(F.lower(F.col(dimension).cast("string")), F.lower(F.lit(text))))


def null_safe(left: DataFrame, right: DataFrame, pairs: Iterable[tuple[str, str]]) -> Column:
    return reduce(and_, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def semi_join(df: DataFrame, keys: DataFrame, names: Sequence[str], distinct: bool = True) -> DataFrame:
    """Rows of ``df`` whose ``names`` occur in ``keys``, NULL matching NULL."""
    other = keys.select(*[F.col(n).alias(f"_key_{n}") for n in names])
    if distinct:
        other = other.distinct()
    return df.join(other, null_safe(df, other, [(n, f"_key_{n}") for n in names]), "left_semi")


# Types whose values are written in one way only, so a part of a label can be looked up in the column.
_LABELLED = (T.StringType, T.IntegralType, T.DateType, T.BooleanType)


def _label_parts(df: DataFrame, dimensions: Sequence[str], labels: Sequence[str]) -> dict[str, list[str]]:
    """Per dimension the values that any reading of the labels gives it: plain IN lists, which a scan can use.

    A value may hold the separator itself, so a dimension can be any run of parts that leaves one for each other.
    """
    parts: dict[str, set[str]] = {d: set() for d in dimensions if isinstance(df.schema[d].dataType, _LABELLED)}
    for label in labels:
        cut = label.split(LABEL_SEPARATOR)
        spare = len(cut) - len(dimensions)
        if spare < 0:
            continue  # no row has this label
        for i, d in enumerate(dimensions):
            if d in parts:
                runs = ((a, b) for a in range(i, i + spare + 1) for b in range(a + 1, i + spare + 2))
                parts[d].update(LABEL_SEPARATOR.join(cut[a:b]) for a, b in runs)
    return {d: sorted(v) for d, v in parts.items()}


def filter_dimension_tuples(
    df: DataFrame, dimensions: Sequence[str], values: Sequence[str] | Sequence[Sequence] | DataFrame
) -> DataFrame:
    """Keep rows whose dimension values are listed.

    ``values`` is a frame of the dimensions, a list of tuples (None or the marker for NULL), a list
    of plain values for one dimension, or a list of joined labels. Frames and tuples match on the
    columns; a label that can be read in two ways matches both readings.
    """
    if isinstance(values, DataFrame):
        return semi_join(df, values, dimensions)
    if len(dimensions) == 1:
        flat = [v[0] if isinstance(v, (tuple, list)) else v for v in values]
        return filter_dimensions(df, {dimensions[0]: [NULL_MARKER if v is None else str(v) for v in flat]})
    if all(isinstance(v, str) for v in values):
        df = filter_dimensions(df, _label_parts(df, dimensions, values))
        return df.filter(dimension_label(dimensions).isin(list(values)))
    schema = T.StructType([T.StructField(d, T.StringType()) for d in dimensions])
    rows = [tuple(None if p is None or p == NULL_MARKER else str(p) for p in v) for v in values]
    text = df.sparkSession.createDataFrame(rows, schema)
    typed = text.select(*[F.col(d).cast(df.schema[d].dataType).alias(d) for d in dimensions])
    # Each column alone is a plain IN list, which the scan can use; the tuples decide the rest.
    listed = {d: [NULL_MARKER if r[i] is None else r[i] for r in rows] for i, d in enumerate(dimensions)}
    df = filter_dimensions(df, {d: sorted(set(v)) for d, v in listed.items()})
    # A local list has a known size, so Catalyst itself broadcasts it while it is small.
    return semi_join(df, typed, dimensions)


def with_calculated_dimensions(df: DataFrame, dimensions: Sequence[Dimension]) -> DataFrame:
    """Add calculated dimensions; all see the base columns only."""
    return df.withColumns({d.id: d.column() for d in dimensions if d.expr})


def filter_calculated(
    df: DataFrame, filters: Mapping[str, Sequence[str]], dimensions: Sequence[Dimension]
) -> DataFrame:
    """Base-column filters below the projection, calculated ones above it."""
    calculated = {d.id for d in dimensions if d.expr}
    df = filter_dimensions(df, {k: v for k, v in filters.items() if k not in calculated})
    df = with_calculated_dimensions(df, dimensions)
    return filter_dimensions(df, {k: v for k, v in filters.items() if k in calculated})


def apply_filters(
    df: DataFrame, model: SemanticModel, filters: Filters | None, extra_dimensions: Iterable[str] = ()
) -> DataFrame:
    """Calculated dimensions, allowed dates, requested dates and dimension values of one query."""
    filters = filters or Filters()
    needed = model.calculated_dimensions([*filters.dimensions, *extra_dimensions])
    missing = [d for d in needed if d.id not in df.columns]
    start, end = date_bounds(filters)
    limited = model.min_date or model.max_date or start is not None or end is not None
    if limited and model.date not in df.columns:
        raise ValueError(f"dates are restricted but there is no column {model.date!r}")
    df = clamp_dates(df, model.min_date, model.max_date, model.date)
    df = filter_dates(df, start, end, model.date)
    return filter_calculated(df, filters.dimensions, missing)


def with_label(df: DataFrame, dimensions: Sequence[str], name: str = "label") -> DataFrame:
    return df.withColumn(name, dimension_label(dimensions))


def required_columns(
    df: DataFrame, model: SemanticModel, keep: Iterable[str] = (), metrics: Sequence[str] | None = None
) -> DataFrame:
    """Only the columns that dimensions, metrics, keys and joins read, in the fact's order."""
    known = {c.lower(): c for c in df.columns}
    texts = [d.expr for d in model.dimensions if d.expr]
    texts += [m.expr for m in model.required_volumes(metrics)]
    wanted = {model.date.lower(), *(k.lower() for k in keep)}
    wanted |= {d.id.lower() for d in model.dimensions if not d.expr}
    for text in texts:
        named = placeholders(text)
        if not named and not text.strip().isdigit():
            raise ValueError(f"write columns as {{name}} to make {text!r} selectable")
        wanted |= {n.lower() for n in named}
    return df.select(*[original for lower, original in known.items() if lower in wanted])


def filter_query_log(
    log: DataFrame,
    start: str | None = None,
    end: str | None = None,
    query_type: str | None = None,
    endpoint: str | None = None,
    limit: int = 100,
    offset: int = 0,
) -> DataFrame:
    """A page of the query log, newest first."""
    day = F.to_date("created_at")
    if start:
        log = log.filter(day >= as_date(start))
    if end:
        log = log.filter(day <= as_date(end))
    if query_type:
        log = log.filter(F.col("query_type") == query_type)
    log = search_values(log, "endpoint", endpoint)
    ties = [F.col(c) for c in ("log_id", "query_type", "endpoint") if c in log.columns]
    return log.orderBy(F.col("created_at").desc(), *ties).offset(offset).limit(limit)


__all__ = [
    "all_of",
    "apply_filters",
    "clamp_dates",
    "date_bounds",
    "dimension_conditions",
    "filter_calculated",
    "filter_dates",
    "filter_dimension_tuples",
    "filter_dimensions",
    "filter_query_log",
    "null_safe",
    "required_columns",
    "search_values",
    "semi_join",
    "value_condition",
    "with_calculated_dimensions",
    "with_label",
]
