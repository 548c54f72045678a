"""Grouped queries over a fact table or a rollup of it.

All of them are one scan and one shuffle with map-side partial aggregation, so a value that holds
a third of all rows arrives at the reducer as a handful of partial rows per map task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import truncate_date
from ..functions.scalars import approx_distinct, composite_key, composite_key_name, label_value
from ..model import EMPTY_MARKER, NULL_MARKER, Filters, Metric, Segment, SemanticModel
from ..session import durable
from .derived import TOTALS, derived_metrics, pct_of_total
from .filters import (
    all_of,
    apply_filters,
    date_bounds,
    dimension_conditions,
    search_values,
    with_label,
)

AGGREGATION_TYPES = {
    "sum": F.sum,
    "avg": F.avg,
    "max": F.max,
    "min": F.min,
    "count": F.count,
}


def _with(metrics: Sequence[str] | None, sort_by: str | None) -> Sequence[str] | None:
    """The wanted metrics and the one to sort by."""
    if metrics is None or sort_by is None:
        return metrics
    return list(dict.fromkeys([*metrics, sort_by]))


def volume_metrics(
    model: SemanticModel, metrics: Sequence[str] | None = None, stored: bool = False, columns: Sequence[str] = ()
) -> list[Column]:
    """Aggregate columns of the volumes behind the wanted metrics.

    ``stored`` reads a rollup with these ``columns``, which already hold the metrics and perhaps sketches of the distinct ones.
    """
    volumes = model.required_volumes(metrics)
    return [m.merge(stored=columns) if stored else m.aggregate() for m in volumes]


def wanted_metrics(model: SemanticModel, metrics: Sequence[str] | None) -> list[Metric]:
    return list(model.metrics) if metrics is None else [model.metric(id) for id in metrics]


def derivations(model: SemanticModel, metrics: Sequence[str] | None) -> list[Metric]:
    if metrics is None:
        return [m for m in model.metrics if not m.is_volume]
    wanted: dict[str, Metric] = {}

    def visit(id: str) -> None:
        if model.has_metric(id) and id not in wanted:
            wanted[id] = model.metric(id)
            for dep in wanted[id].depends_on:
                visit(dep)

    for id in metrics:
        visit(id)
    return [m for m in wanted.values() if not m.is_volume]


def grouped(
    df: DataFrame,
    model: SemanticModel,
    dimensions: Sequence[str],
    filters: Filters | None = None,
    metrics: Sequence[str] | None = None,
    stored: bool = False,
) -> DataFrame:
    """Filter, group by the dimensions, aggregate the volumes and derive the other metrics."""
    rows = apply_filters(df, model, filters, dimensions)
    columns = volume_metrics(model, metrics, stored, rows.columns)
    result = rows.groupBy(*dimensions).agg(*columns) if dimensions else rows.agg(*columns)
    return derived_metrics(result, derivations(model, metrics))


def ordering(
    df: DataFrame, metric: str, ties: Sequence[str], ascending: bool = False, nulls_last: bool = True
) -> list[Column]:
    """A total order: the metric, then the dimensions."""
    column = F.col(metric)
    if ascending:
        first = column.asc_nulls_last() if nulls_last else column.asc()
    else:
        first = column.desc_nulls_last() if nulls_last else column.desc()
    return [first, *[F.col(t).asc_nulls_first() for t in ties]]


def page(
    df: DataFrame,
    metric: str,
    ties: Sequence[str],
    limit: int = 50,
    offset: int = 0,
    ascending: bool = False,
) -> DataFrame:
    """ORDER BY metric, LIMIT, OFFSET; planned as a distributed top-k."""
    return df.orderBy(*ordering(df, metric, ties, ascending)).offset(offset).limit(limit)


def pivot(
    df: DataFrame,
    model: SemanticModel,
    dimensions: Sequence[str],
    filters: Filters | None = None,
    metrics: Sequence[str] | None = None,
    limit: int | None = 50,
    offset: int = 0,
    order_by: str | None = None,
    ascending: bool = False,
    scope: str = "all",
    stored: bool = False,
) -> DataFrame:
    """The main table: dimensions, label, metrics, ``<volume>_pct`` and ``percentage_of_total``.

    Shares refer to the whole filtered result, or with ``scope="page"`` to the returned rows.
    """
    rows = grouped(df, model, dimensions, filters, _with(metrics, order_by), stored)
    volumes = [m.id for m in model.required_volumes(metrics)]
    shown = [m.id for m in wanted_metrics(model, metrics) if m.id in rows.columns]
    wanted_volumes = [v for v in volumes if v in shown]
    sort = order_by or (shown[0] if shown else volumes[0])
    if scope == "all" and wanted_volumes:
        rows = pct_of_total(rows, wanted_volumes)
    if limit is not None and dimensions:
        rows = page(rows, sort, dimensions, limit, offset, ascending)
    if scope == "page" and wanted_volumes:
        rows = pct_of_total(rows, wanted_volumes, is_page=limit is not None and bool(dimensions))
    rows = with_label(rows, dimensions)
    shares = [f"{v}_pct" for v in wanted_volumes] + (["percentage_of_total"] if wanted_volumes else [])
    return rows.select(*dimensions, "label", *shown, *shares)


def kpi_totals(
    df: DataFrame,
    model: SemanticModel,
    filters: Filters | None = None,
    metrics: Sequence[str] | None = None,
    stored: bool = False,
) -> DataFrame:
    """Ungrouped metrics, NULL shown as 0."""
    shown = [m.id for m in wanted_metrics(model, metrics)]
    row = grouped(df, model, [], filters, metrics, stored)
    return row.select(*[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in shown if m in row.columns])


def trend(
    df: DataFrame,
    model: SemanticModel,
    granularity: str = "daily",
    filters: Filters | None = None,
    metrics: Sequence[str] | None = None,
    week_start: str = "sunday",
    stored: bool = False,
) -> DataFrame:
    """Metrics per day, week or month, ordered by date."""
    rows = apply_filters(df, model, filters)
    period = truncate_date(F.col(model.date), granularity, week_start).alias(model.date)
    result = rows.groupBy(period).agg(*volume_metrics(model, metrics, stored, rows.columns))
    return derived_metrics(result, derivations(model, metrics)).orderBy(model.date)


def breakdown(
    df: DataFrame,
    model: SemanticModel,
    dimension: str,
    filters: Filters | None = None,
    metrics: Sequence[str] | None = None,
    limit: int = 20,
    stored: bool = False,
) -> DataFrame:
    """Metrics by one dimension as text, first values in alphabetical order."""
    rows = apply_filters(df, model, filters, [dimension])
    result = rows.groupBy(label_value(dimension).alias("dimension_value")).agg(
        *volume_metrics(model, metrics, stored, rows.columns)
    )
    return derived_metrics(result, derivations(model, metrics)).orderBy("dimension_value").limit(limit)


def top_terms(
    df: DataFrame,
    model: SemanticModel,
    filters: Filters | None = None,
    metrics: Sequence[str] | None = None,
    sort_by: str = "queries",
    limit: int = 100,
    term: str = "search_term",
    stored: bool = False,
) -> DataFrame:
    """The top terms by a metric."""
    rows = grouped(df, model, [term], filters, _with(metrics, sort_by), stored)
    top = page(rows, sort_by, [term], limit)
    shown = [m.id for m in wanted_metrics(model, metrics) if m.id in top.columns]
    return top.select(term, *shown)


def dimension_values(
    df: DataFrame,
    model: SemanticModel,
    dimension: str,
    filters: Filters | None = None,
    search: str | None = None,
    limit: int = 1000,
) -> DataFrame:
    """Distinct values in natural order, NULL spelled out."""
    rows = search_values(apply_filters(df, model, filters, [dimension]), dimension, search)
    values = rows.select(dimension).distinct().orderBy(F.col(dimension).asc_nulls_first()).limit(limit)
    return values.select(label_value(dimension).alias("value"))


def dimension_values_by_metric(
    rollup: DataFrame,
    model: SemanticModel,
    dimension: str,
    sort_by: str | None = None,
    filters: Filters | None = None,
    search: str | None = None,
    limit: int = 1000,
) -> DataFrame:
    """Values of a rollup dimension, largest summed metric first."""
    metric = model.metric(sort_by or model.sort_metric)
    rows = search_values(apply_filters(rollup, model, filters, [dimension]), dimension, search)
    values = page(rows.groupBy(dimension).agg(metric.merge(stored=rows.columns)), metric.id, [dimension], limit)
    return values.select(label_value(dimension).alias("value"), metric.id)


def filter_options(
    df: DataFrame,
    model: SemanticModel,
    dimensions: Sequence[str],
    filters: Filters | None = None,
    limit: int = 100,
) -> DataFrame:
    """The first values of every dimension in their natural order, as ``dimension_values`` has them.

    One pass over the data, which keeps a bounded set for each dimension in every task: the ``limit`` smallest values so far, merged
    with each batch of rows. A task hands on no more than those, so a dimension with billions of values costs no
    more than one with few, and no row is multiplied by the dimensions. Values keep their types until they are ordered.
    """
    rows = apply_filters(df, model, filters, dimensions).select(*dimensions)
    fields = [T.StructField(f"_{i}", rows.schema[d].dataType) for i, d in enumerate(dimensions)]
    schema = T.StructType([T.StructField("dimension", T.StringType()), *fields])
    long = rows.mapInArrow(_smallest_values(list(dimensions), limit), schema)
    cells = [f"_{i}" for i in range(len(dimensions))]
    order = Window.partitionBy("dimension").orderBy(*[F.col(c).asc_nulls_first() for c in cells])
    first = long.distinct().withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)
    own = F.coalesce(*[F.when(F.col("dimension") == d, label_value(c)) for d, c in zip(dimensions, cells, strict=True)])
    return first.select("dimension", own.alias("value"), "position")


def _smallest_values(dimensions: list[str], limit: int):
    """The batch function of ``filter_options``; it needs pyarrow on the executors, not this package."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        held: list = [None] * len(dimensions)
        schema = None
        for batch in batches:
            schema = batch.schema
            for i in range(len(dimensions)):
                values = pc.unique(batch.column(i))
                if pa.types.is_floating(values.type):
                    values = pc.add(values, pa.scalar(0, values.type))  # one zero, whatever its sign
                if held[i] is not None:
                    values = pa.concat_arrays([held[i], values])
                values = pc.unique(values)
                if len(values) > limit:
                    last = values.slice(0, 0)
                    if pa.types.is_floating(values.type):  # not a number is the largest
                        odd = pc.fill_null(pc.is_nan(values), False)
                        last, values = values.filter(odd), values.filter(pc.invert(odd))
                    order = pc.array_sort_indices(values, order="ascending", null_placement="at_start")
                    values = pa.concat_arrays([values.take(order), last])[:limit]
                held[i] = values
        for i, values in enumerate(held):
            if values is not None and len(values):
                name = pa.array([dimensions[i]] * len(values), pa.string())
                cells = [values if k == i else pa.nulls(len(values), f.type) for k, f in enumerate(schema)]
                yield pa.RecordBatch.from_arrays([name, *cells], ["dimension", *[f"_{k}" for k in range(len(cells))]])

    return run


def group_count(
    df: DataFrame, model: SemanticModel, dimensions: Sequence[str], filters: Filters | None = None
) -> DataFrame:
    """Exact number of dimension combinations; NULL is a value."""
    rows = apply_filters(df, model, filters, dimensions)
    return rows.select(*dimensions).distinct().agg(F.count(F.lit(1)).alias("total_count"))


def group_count_approx(
    df: DataFrame,
    model: SemanticModel,
    dimensions: Sequence[str],
    filters: Filters | None = None,
) -> DataFrame:
    """Approximate number of dimension combinations: one small sketch per task instead of a shuffle."""
    rows = apply_filters(df, model, filters, dimensions)
    return rows.agg(approx_distinct(*map(F.col, dimensions), nulls=True).alias("total_count"))


def with_composite_keys(df: DataFrame, keys: Sequence[Sequence[str]]) -> DataFrame:
    """Stored text keys for distinct counts over several columns."""
    return df.withColumns({composite_key_name(k): composite_key(sorted(k, key=str.lower)) for k in keys})


def cardinality_ranking(df: DataFrame, dimensions: Sequence[str], top: int = 4) -> DataFrame:
    """The dimensions with the most distinct values, by sketches taken in one pass."""
    counts = df.agg(*[approx_distinct(F.col(d)).alias(d) for d in dimensions])
    long = counts.unpivot([], list(dimensions), "column_name", "cardinality")
    # One row per dimension of the schema.
    rank = F.row_number().over(Window.orderBy(F.col("cardinality").desc(), "column_name"))
    return long.withColumn("position", rank).filter(F.col("position") <= top)


def rollup_totals(
    rollup: DataFrame, model: SemanticModel, metrics: Sequence[str], filters: Filters | None = None
) -> DataFrame:
    """Merged rollup metrics under filters, NULL shown as 0."""
    rows = apply_filters(rollup, model, filters)
    sums = [model.metric(m).merge(stored=rows.columns) for m in metrics]
    return rows.agg(*sums).select(*[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in metrics])


def pivot_from_rollup(
    rollup: DataFrame,
    model: SemanticModel,
    dimensions: Sequence[str],
    metrics: Sequence[str],
    filters: Filters | None = None,
    reaggregate: bool = True,
    limit: int = 100,
    offset: int = 0,
    sort_by: str | None = None,
    ascending: bool = False,
) -> DataFrame:
    """Rows of a rollup, re-aggregated to a subset of its dimensions unless told otherwise.

    Distinct counts of a rollup with sketches are merged by them; without, they are added up and overstate.
    """
    if not dimensions and not metrics:
        raise ValueError("nothing to select: give dimensions or metrics")
    rows = apply_filters(rollup, model, filters)
    if reaggregate:
        sums = [model.metric(m).merge(stored=rows.columns) for m in metrics]
        rows = rows.groupBy(*dimensions).agg(*sums) if dimensions else rows.agg(*sums)
    else:
        rows = rows.select(*dimensions, *metrics)
    sort = sort_by or (metrics[0] if metrics else None)
    if sort is None:
        return rows.orderBy(*dimensions).offset(offset).limit(limit)
    ties = [*dimensions, *[m for m in metrics if m != sort]]
    return page(rows, sort, ties, limit, offset, ascending)


# Entries of an inverted index that are sent to all tasks, at some 40 bytes each; a larger one is joined by hash.
INDEX_BROADCAST = 500_000


def segment_plan(base: Mapping[str, Sequence[str]], segments: Sequence[Segment]) -> tuple[dict, list[dict]]:
    """The filter shared by all segments, and the values that each segment allows by dimension.

    A segment's values replace the base filter's values for the same dimension.
    """
    overridden = {d for s in segments for d in s.dimensions}
    shared = {d: v for d, v in base.items() if d not in overridden}
    local = {d: v for d, v in base.items() if d in overridden}
    return shared, [{d: v for d, v in {**local, **s.dimensions}.items() if v} for s in segments]


def _index(rows: DataFrame, dimension: str, allowed: Sequence[tuple[int, int, Sequence[str]]], shapes: Sequence[int], name: str) -> DataFrame:
    """Each value of a dimension once, with the segments that allow it, apart by shape: (``<name>``, ``<name>_<shape>``...).

    ``allowed`` has (shape, segment, values as text). Values are cast to the dimension's type, so texts for one value meet.
    """
    kind = rows.schema[dimension].dataType
    entries = []
    for shape, segment, values in allowed:
        for v in dict.fromkeys(values):
            if v == EMPTY_MARKER and not isinstance(kind, T.StringType):
                continue
            entries.append((None if v == NULL_MARKER else "" if v == EMPTY_MARKER else v, shape, segment))
    if isinstance(kind, T.StringType):  # texts are the values: what one allows is known here
        by_value: dict[str | None, dict[int, list[int]]] = {}
        for v, shape, segment in entries:
            by_value.setdefault(v, {}).setdefault(shape, []).append(segment)
        listed = [(v, *[sorted(own.get(s, [])) for s in shapes]) for v, own in by_value.items()]
        schema = ", ".join([f"{name} string", *[f"{name}_{s} array<int>" for s in shapes]])
        index = rows.sparkSession.createDataFrame(listed, schema).coalesce(1)
        return F.broadcast(index) if len(entries) <= INDEX_BROADCAST else index
    # One partition: the few rows need no exchange of their own.
    text = rows.sparkSession.createDataFrame(entries, "v string, shape int, segment int").coalesce(1)
    typed = text.select(F.col("v").cast(kind).alias(name), "shape", "segment")
    members = [F.array_sort(F.collect_set(F.when(F.col("shape") == s, F.col("segment")))).alias(f"{name}_{s}") for s in shapes]
    index = typed.groupBy(name).agg(*members)
    return F.broadcast(index) if len(entries) <= INDEX_BROADCAST else index


def segment_members(rows: DataFrame, conditions: Sequence[Mapping[str, Sequence[str]]]) -> DataFrame:
    """``rows`` with ``_segment``, once for each segment that a row is in, as its position in ``conditions``.

    An inverted index for each dimension leads from a value to the segments that allow it. Segments that restrict the same
    dimensions are one shape; a row is in those of a shape that all its dimensions allow, the intersection of what
    their indexes say. A row costs a look-up for each dimension, however many segments there are, and the plan has the
    same size for any number of them.
    """
    by_shape: dict[tuple[str, ...], list[int]] = {}
    for i, c in enumerate(conditions):
        by_shape.setdefault(tuple(sorted(c)), []).append(i)
    shapes = list(by_shape)
    columns = rows.columns
    dimensions = sorted({d for shape in shapes for d in shape})
    for k, d in enumerate(dimensions):
        own = [s for s, shape in enumerate(shapes) if d in shape]
        allowed = [(s, i, conditions[i][d]) for s in own for i in by_shape[shapes[s]]]
        index = _index(rows, d, allowed, own, f"_index_{k}")
        # Where every shape restricts the dimension, a value that no segment allows is in none.
        how = "inner" if len(own) == len(shapes) else "left"
        rows = rows.join(index, F.col(quoted(d)).eqNullSafe(F.col(f"_index_{k}")), how)
    none = F.array().cast("array<int>")
    found = []
    for s, shape in enumerate(shapes):
        if not shape:
            found.append(F.expr(f"array({', '.join(map(str, by_shape[shape]))})"))
            continue
        parts = [F.coalesce(F.col(f"_index_{dimensions.index(d)}_{s}"), none) for d in shape]
        found.append(reduce(F.array_intersect, parts))
    member = found[0] if len(found) == 1 else F.concat(*found)
    return rows.select(*[F.col(quoted(c)) for c in columns], F.explode(member).alias(SEGMENT))


SEGMENT = "_segment"
ROWS = "rows"


def segment_rows(
    df: DataFrame,
    model: SemanticModel,
    segments: Sequence[Segment],
    metrics: Sequence[str],
    filters: Filters | None = None,
    by: Sequence[str] = (),
    stored: bool = False,
) -> DataFrame:
    """One row per (``by``, segment) that has fact rows: ``_segment`` (its position), ``rows`` and all metrics.

    Each fact row is mapped to the segments it is in, mostly one, and takes part in plain aggregates by
    segment, whatever they are. Which segments those are is looked up by value (``segment_members``): the plan has the same
    size for any number of segments, and there is no limit to them. ``by`` adds row dimensions; a row's own value then
    replaces what a segment or the base filter says about that dimension.
    """
    filters = (filters or Filters()).without(by)
    segments = [type(s)(s.label, {d: v for d, v in s.dimensions.items() if d not in by}) for s in segments]
    names = [*by, *filters.dimensions, *[d for s in segments for d in s.dimensions]]
    rows = apply_filters(df, model, filters.without(filters.dimensions), names)
    shared, conditions = segment_plan(filters.dimensions, segments)
    rows = rows.filter(all_of(dimension_conditions(rows, shared))).filter(_anywhere(rows, filters, segments))
    volumes = volume_metrics(model, metrics, stored, rows.columns)
    rows = segment_members(rows, conditions)
    result = rows.groupBy(*by, SEGMENT).agg(F.count(F.lit(1)).alias(ROWS), *volumes)
    return derived_metrics(result, derivations(model, metrics))


def _anywhere(rows: DataFrame, filters: Filters, segments: Sequence[Segment]) -> Column:
    """What a row in any segment meets, one value list per dimension that all of them restrict, for the scan."""
    listed: dict[str, list[str]] = {}
    for d in {d for s in segments for d in s.dimensions}:
        values = [s.dimensions.get(d) or filters.dimensions.get(d) for s in segments]
        if all(values):
            listed[d] = list(dict.fromkeys(v for own in values for v in own))
    return all_of(dimension_conditions(rows, listed))


def quoted(name: str) -> str:
    """A column's name in SQL."""
    return "`" + name.replace("`", "``") + "`"


def in_columns(
    long: DataFrame, segments: Sequence[Segment], names: Sequence[str], by: Sequence[str], zeros: Sequence[str] = ()
) -> DataFrame:
    """Lay rows by segment out as ``<label>__<name>`` columns; absent cells are NULL, or 0 for ``zeros``."""
    cells = []  # as SQL: a wide layout has thousands of cells, and each call of a function takes its time
    for i, segment in enumerate(segments):
        for name in names:
            cell = f"max(CASE WHEN {SEGMENT} = {i} THEN {quoted(name)} END)"
            cell = f"coalesce({cell}, 0)" if name in zeros else cell
            cells.append(F.expr(f"{cell} AS {quoted(f'{segment.label}__{name}')}"))
    return long.groupBy(*by).agg(*cells) if by else long.agg(*cells)


CONTROL, CELL = "control", "cell"


def treatment_cells(long: DataFrame, names: Sequence[str], by: Sequence[str], segments: int) -> DataFrame:
    """Rows by segment as one row for each (``by``, treatment): ``_segment`` from 1, ``control`` and ``cell`` as structs of ``names``.

    Segment 0 is the control. A treatment that a row does not have gets a cell of NULLs, so every row that there is has all
    treatments. No column is laid out: a row gathers its cells as a list, at most one for each segment.
    """
    struct = F.struct(*[F.col(quoted(n)).alias(n) for n in names])
    kind = long.select(struct.alias("s")).schema[0].dataType
    # NULLs of the right types, as a struct that is there.
    empty = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields])
    control = F.coalesce(F.max(F.when(F.col(SEGMENT) == 0, struct)), empty).alias(CONTROL)
    cells = F.collect_list(F.when(F.col(SEGMENT) > 0, F.struct(F.col(SEGMENT).alias(SEGMENT), struct.alias(CELL)))).alias("_cells")
    gathered = long.groupBy(*by).agg(control, cells) if by else long.agg(control, cells)
    present = F.transform("_cells", lambda c: c[SEGMENT])
    absent = F.array_except(F.sequence(F.lit(1), F.lit(segments - 1)), present)
    rest = F.transform(absent, lambda i: F.struct(i.alias(SEGMENT), empty.alias(CELL)))
    return gathered.select(*by, CONTROL, F.inline(F.concat("_cells", rest)))


def segment_totals(
    df: DataFrame,
    model: SemanticModel,
    segments: Sequence[Segment],
    metrics: Sequence[str],
    filters: Filters | None = None,
    by: Sequence[str] = (),
    stored: bool = False,
    presence: bool = True,
) -> DataFrame:
    """Volumes of many, possibly overlapping segments in one pass: ``<label>__<metric>`` columns.

    With ``presence``, ``<label>__rows`` counts the fact rows behind a cell, so an absent cell can be told from a
    zero. ``by`` is as in ``segment_rows``.
    """
    volumes = model.required_volumes(metrics)
    long = segment_rows(df, model, segments, [m.id for m in volumes], filters, by, stored)
    counts = [m.id for m in volumes if not stored and (m.agg == "count" or m.is_distinct)]
    names = [*([ROWS] if presence else []), *[m.id for m in volumes]]
    return in_columns(long, segments, names, by, [ROWS, *counts])


def segment_metrics(
    df: DataFrame,
    model: SemanticModel,
    segments: Sequence[Segment],
    metrics: Sequence[str],
    filters: Filters | None = None,
    by: Sequence[str] = (),
    stored: bool = False,
) -> DataFrame:
    """Like ``segment_totals`` for the metrics themselves, derived ones too; a cell without rows is NULL throughout."""
    long = segment_rows(df, model, segments, metrics, filters, by, stored)
    names = [m for m in dict.fromkeys(metrics) if m in long.columns]
    return in_columns(long, segments, [ROWS, *names], by, [ROWS])


def observed_days(
    df: DataFrame, model: SemanticModel, filters: Filters | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """First and last date with data, and the inclusive number of days between them."""
    rows = apply_filters(df, model, filters, by)
    day = F.col(model.date)
    columns = [
        F.min(day).alias("min_date"),
        F.max(day).alias("max_date"),
        F.coalesce(F.datediff(F.max(day), F.min(day)) + 1, F.lit(1)).alias("num_days"),
    ]
    return rows.groupBy(*by).agg(*columns) if by else rows.agg(*columns)


def requested_days(filters: Filters | None) -> Column:
    """Inclusive days of the requested range, at least 1; presets count their real length."""
    start, end = date_bounds(filters or Filters())
    if start is None or end is None:
        return F.lit(1)
    return F.greatest(F.datediff(end, start) + 1, F.lit(1))


def avg_per_day(
    df: DataFrame, metric: str, filters: Filters | None = None, name: str | None = None
) -> DataFrame:
    """Add a metric divided by the requested days."""
    return df.withColumn(name or f"{metric}_per_day", F.try_divide(F.col(metric), requested_days(filters)))


@dataclass(frozen=True)
class Reaggregation:
    """A custom metric: ``metric`` re-aggregated over the dimensions that are not excluded."""

    name: str
    metric: str
    excluded: Sequence[str]
    aggregation: str = "sum"


def reaggregate_metrics(
    df: DataFrame, dimensions: Sequence[str], wanted: Sequence[Reaggregation]
) -> DataFrame:
    """Attach re-aggregated metrics to each row of an aggregated frame.

    Aggregates and joins back instead of using a window: a window would bring all rows of a hot
    group into one task, the aggregate meets it in partial form and the join can split it. The
    frame is stored first, so the fact behind it is read once however many metrics are asked for.
    """
    for w in wanted:
        if w.aggregation not in AGGREGATION_TYPES:
            raise ValueError(f"unknown aggregation {w.aggregation!r}")
    groups: dict[tuple[str, ...], list[Reaggregation]] = {}
    for w in wanted:
        groups.setdefault(tuple(d for d in dimensions if d not in set(w.excluded)), []).append(w)
    result = durable(df) if any(len(kept) < len(dimensions) for kept in groups) else df
    stored = result
    for kept, members in groups.items():
        values = [AGGREGATION_TYPES[w.aggregation](w.metric).alias(w.name) for w in members]
        if len(kept) == len(dimensions):
            result = result.withColumns({w.name: F.col(w.metric) for w in members})
        elif not kept:
            result = result.withColumn(TOTALS, stored.agg(F.struct(*values).alias(TOTALS)).scalar())
            result = result.withColumns({w.name: F.col(TOTALS)[w.name] for w in members}).drop(TOTALS)
        else:
            totals = stored.groupBy(*[F.col(k).alias(f"_group_{k}") for k in kept]).agg(*values)
            match = all_of(F.col(k).eqNullSafe(F.col(f"_group_{k}")) for k in kept)
            names = [w.name for w in members]
            result = result.join(totals, match, "left").select(*result.columns, *names)
    return result.select(*df.columns, *[w.name for w in wanted])


def reaggregate_metric(
    df: DataFrame,
    metric: str,
    dimensions: Sequence[str],
    excluded: Sequence[str],
    aggregation: str = "sum",
    name: str | None = None,
) -> DataFrame:
    """``reaggregate_metrics`` for a single custom metric."""
    wanted = Reaggregation(name or f"{metric}_{aggregation}", metric, excluded, aggregation)
    return reaggregate_metrics(df, dimensions, [wanted])


def total_row(
    df: DataFrame,
    model: SemanticModel,
    dimensions: Sequence[str],
    filters: Filters | None = None,
    metrics: Sequence[str] | None = None,
) -> DataFrame:
    """The footer: volumes summed over all rows, rates computed from those sums, the row count."""
    volumes = [m.id for m in model.required_volumes(metrics)]
    rows = grouped(df, model, dimensions, filters, volumes)
    sums = rows.agg(*[F.sum(v).alias(v) for v in volumes], F.count(F.lit(1)).alias("row_count"))
    footer = derived_metrics(sums, derivations(model, metrics))
    shown = [m.id for m in wanted_metrics(model, metrics) if m.id in footer.columns]
    return footer.select(
        F.lit("Total").alias("label"), *shown, "row_count", F.lit(100.0).alias("percentage_of_total")
    )


__all__ = [
    "AGGREGATION_TYPES",
    "avg_per_day",
    "breakdown",
    "cardinality_ranking",
    "derivations",
    "in_columns",
    "dimension_values",
    "dimension_values_by_metric",
    "filter_options",
    "group_count",
    "group_count_approx",
    "grouped",
    "kpi_totals",
    "observed_days",
    "ordering",
    "page",
    "pivot",
    "pivot_from_rollup",
    "Reaggregation",
    "reaggregate_metric",
    "reaggregate_metrics",
    "requested_days",
    "rollup_totals",
    "segment_members",
    "segment_metrics",
    "segment_rows",
    "segment_totals",
    "top_terms",
    "treatment_cells",
    "total_row",
    "trend",
    "volume_metrics",
    "with_composite_keys",
]
