"""Materialised daily aggregates and enriched copies of the fact table.

These are the only functions of the library that write. Data is exchanged by date partition: a
refresh computes whole dates and replaces those partitions, so a rerun after a lost executor or a
failed job leaves the same table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import composite_key_name
from ..model import Lookup, Metric, Rollup, SemanticModel
from ..operators.aggregates import with_composite_keys
from ..operators.filters import filter_dates, required_columns, with_calculated_dimensions
from ..operators.joins import join_dimensions_dedup, missing_dates
from ..sources.tables import append_dates, path_exists, stored_dates, write_daily_table

BATCH_DATES = 7


def on_dates(
    df: DataFrame, dates: Sequence[date], date_column: str = "date", undated: bool = False
) -> DataFrame:
    """Rows of the given dates, and with ``undated`` the rows without a date.

    The surrounding range is stated too: it is what a file reader can use when the date is computed
    from a timestamp.
    """
    day = F.col(date_column)
    chosen = F.lit(False)
    if dates:
        span = day.between(F.lit(min(dates)).cast("date"), F.lit(max(dates)).cast("date"))
        chosen = span & day.isin([F.lit(d).cast("date") for d in dates])
    return df.filter(chosen | day.isNull() if undated else chosen)


def collect_dates(dates: DataFrame, date_column: str = "date") -> list[date]:
    """A set of dates as a list: at most one row per calendar day, however large the table."""
    return [r[0] for r in dates.select(date_column).distinct().orderBy(date_column).collect()]


def rollup_frame(
    source: DataFrame,
    model: SemanticModel,
    dimensions: Sequence[str],
    metrics: Sequence[str] | None = None,
    lookups: Sequence[Lookup] = (),
    sketches: bool = False,
) -> DataFrame:
    """Volumes per combination of the dimensions, or a row count when there is no volume.

    With ``sketches`` every distinct count has a mergeable sketch beside it, from which ``pivot_from_rollup`` and all
    readers of stored rows estimate the distinct count over several days or values.
    """
    used = [x for x in lookups if set(x.columns) & set(dimensions)]
    rows = join_dimensions_dedup(source, used)
    missing = [d for d in model.calculated_dimensions(dimensions) if d.id not in rows.columns]
    rows = with_calculated_dimensions(rows, missing)
    wanted = model.required_volumes(metrics)
    volumes = [m.aggregate() for m in wanted]
    volumes += [m.sketch() for m in wanted if sketches and m.is_distinct]
    return rows.groupBy(*dimensions).agg(*(volumes or [F.count(F.lit(1)).alias("row_count")]))


def build_rollup(
    source: DataFrame,
    model: SemanticModel,
    dimensions: Sequence[str],
    path: str,
    metrics: Sequence[str] | None = None,
    lookups: Sequence[Lookup] = (),
    dates: Sequence[date] | None = None,
    sketches: bool = False,
) -> None:
    """Build a rollup in one write; with ``dates`` only those partitions are computed and replaced.

    ``sketches`` is as in ``rollup_frame``.
    """
    rows = source if dates is None else on_dates(source, dates, model.date)
    frame = rollup_frame(rows, model, dimensions, metrics, lookups, sketches)
    if dates is None:
        write_daily_table(frame, path, dimensions, model.date)
    else:
        append_dates(frame, path, dimensions, model.date)


def build_rollup_batched(
    source: DataFrame,
    model: SemanticModel,
    dimensions: Sequence[str],
    path: str,
    metrics: Sequence[str] | None = None,
    lookups: Sequence[Lookup] = (),
    batch_dates: int = BATCH_DATES,
    timestamp: str | None = None,
) -> int:
    """Backfill in batches of dates, each its own restartable job; returns the number of batches.

    The table equals ``build_rollup``'s. Prefer that one unless a single job would be too long to
    repeat: every batch reads the source again, pruned to its dates. Rows without a date are a job of
    their own after the batches; naming the ``timestamp`` that the date is computed from lets the reader prune that one too.
    """
    dates = collect_dates(source.select(model.date).filter(F.col(model.date).isNotNull()), model.date)
    batches = [dates[i : i + batch_dates] for i in range(0, len(dates), batch_dates)]
    for i, batch in enumerate(batches):
        # The first batch replaces whatever table was there.
        frame = rollup_frame(on_dates(source, batch, model.date), model, dimensions, metrics, lookups)
        (append_dates if i else write_daily_table)(frame, path, dimensions, model.date)
    undated = source.filter(F.col(model.date).isNull())
    if timestamp is not None:
        undated = undated.filter(F.col(timestamp).isNull())
    frame = rollup_frame(undated, model, dimensions, metrics, lookups)
    (append_dates if batches else write_daily_table)(frame, path, dimensions, model.date)
    return len(batches)


def _dates_to_write(
    source: DataFrame,
    path: str,
    date_column: str,
    since: date | None,
    source_dates: Sequence[date] | None,
) -> list[date]:
    """Dates of the source that the table at ``path`` lacks; the table's are read off its partitions, not its rows."""
    have = stored_dates(source.sparkSession, path, date_column)
    if source_dates is not None:
        known = have if have is not None else collect_dates(source.sparkSession.read.parquet(path), date_column)
        return sorted(d for d in set(source_dates) - set(known) if since is None or d >= since)
    target = have if have is not None else source.sparkSession.read.parquet(path)
    return collect_dates(missing_dates(source, target, date_column, since), date_column)


def _written_dates(source: DataFrame, path: str, date_column: str) -> int:
    dates = stored_dates(source.sparkSession, path, date_column)
    if dates is not None:
        return len(dates) + _has_undated(source, path, date_column)
    stored = source.sparkSession.read.parquet(path)
    return len(collect_dates(stored, date_column)) if date_column in stored.columns else 0


def _has_undated(source: DataFrame, path: str, date_column: str) -> bool:
    return path_exists(source, f"{path}/{date_column}=__HIVE_DEFAULT_PARTITION__")


def refresh_rollup(
    source: DataFrame,
    model: SemanticModel,
    dimensions: Sequence[str],
    path: str,
    metrics: Sequence[str] | None = None,
    lookups: Sequence[Lookup] = (),
    incremental: bool = True,
    recompute: Sequence[date] = (),
    since: date | None = None,
    source_dates: Sequence[date] | None = None,
    sketches: bool = False,
) -> int:
    """Bring a rollup up to date; returns the number of dates written.

    Incremental runs add the dates the rollup does not have. Dates it has are left alone, even if
    late rows arrived, except those named in ``recompute``. A missing rollup is built in full, and so is one without the date among
    its dimensions, which holds all dates in each row. Rows without a date belong to no day and are written by full builds only.

    Which dates the rollup has is read off its partitions. Which the source has takes its date column, unless
    ``source_dates`` tells (as ``stored_dates`` does for a source that is itself partitioned by date); ``since``, the first date
    looked at, spares reading what is before it.
    """
    if not incremental or model.date not in dimensions or not path_exists(source, path):
        build_rollup(source, model, dimensions, path, metrics, lookups, sketches=sketches)
        return _written_dates(source, path, model.date)
    dates = set(_dates_to_write(source, path, model.date, since, source_dates)) | set(recompute)
    if dates:
        build_rollup(source, model, dimensions, path, metrics, lookups, sorted(dates), sketches)
    return len(dates)


@dataclass
class _Step:
    """A rollup to refresh: what is to be written, and the rollup it can be made from."""

    name: str
    dimensions: Sequence[str]
    path: str
    full: bool = True
    dates: list[date] = field(default_factory=list)
    parent: _Step | None = None
    done: Future | None = None


def mergeable(metrics: Sequence[Metric], sketches: bool = False) -> bool:
    """Can stored values of all these metrics be merged without loss, or, for distinct counts, by their sketches?"""
    return all(m.agg in ("sum", "count", "min", "max") or (sketches and m.is_distinct) for m in metrics)


def from_parent(
    parent: DataFrame, model: SemanticModel, dimensions: Sequence[str], metrics: Sequence[str] | None, sketches: bool
) -> DataFrame:
    """A rollup computed from one with more dimensions: merged values, and merged sketches with their estimates."""
    volumes = model.required_volumes(metrics)
    columns = [m.merge(stored=parent.columns) for m in volumes]
    columns += [m.merged_sketch() for m in volumes if sketches and m.is_distinct]
    return parent.groupBy(*dimensions).agg(*(columns or [F.sum("row_count").alias("row_count")]))


def _lattice(steps: Sequence[_Step], date_column: str) -> None:
    """Gives each rollup the parent with the fewest dimensions that holds all its own and writes all its dates in the same run.

    A parent that only adds other dates would hand on what it held before, so it is none. Of rollups with the same dimensions the first is
    the parent of the others, so there are no circles.
    """
    for i, step in enumerate(steps):
        own = set(step.dimensions)
        fitting = []
        for j, other in enumerate(steps):
            more = set(other.dimensions)
            wider = own < more or (own == more and j < i)
            covers = other.full if step.full else other.full or set(step.dates) <= set(other.dates)
            if wider and covers and (step.full or date_column in more):
                fitting.append((len(more), j, other))
        step.parent = min(fitting, key=lambda f: f[:2])[2] if fitting else None


def refresh_all(
    source: DataFrame,
    model: SemanticModel,
    rollups: Mapping[str, tuple[Sequence[str], str]],
    lookups: Sequence[Lookup] = (),
    incremental: bool = True,
    metrics: Sequence[str] | None = None,
    sketches: bool = False,
    since: date | None = None,
    source_dates: Sequence[date] | None = None,
    at_once: int = 4,
) -> DataFrame:
    """Refresh every rollup (name -> dimensions, path) and report per rollup.

    Rollups are made from rollups: where the metrics can be merged (sums, counts, extremes, and with ``sketches`` distinct
    counts, then estimated), a rollup whose dimensions another one holds is computed from the smallest such one that writes the
    same dates in this run, and only those that no other holds read the fact. Rollups that do not wait for one another
    run at the same time, ``at_once`` of them. The fact's dates are found once for all, or given as ``source_dates``.

    One failing rollup does not stop the others: those that would have been made from it read the fact. Its message is in the report.
    """
    spark = source.sparkSession
    steps = [_Step(name, dimensions, path) for name, (dimensions, path) in rollups.items()]
    failed: dict[str, str] = {}
    for step in steps:
        try:
            step.full = not incremental or model.date not in step.dimensions or not path_exists(spark, step.path)
        except Exception as error:  # noqa: BLE001 - reported, not hidden
            failed[step.name] = str(error)
    if source_dates is None and any(not s.full for s in steps if s.name not in failed):
        # At most one row per calendar day, read once however many rollups there are.
        days = filter_dates(source, since, date_column=model.date).select(model.date).where(F.col(model.date).isNotNull())
        source_dates = collect_dates(days, model.date)
    for step in steps:
        if not step.full and step.name not in failed:
            try:
                step.dates = _dates_to_write(source, step.path, model.date, since, source_dates)
            except Exception as error:  # noqa: BLE001
                failed[step.name] = str(error)
    usable = [s for s in steps if s.name not in failed]
    if mergeable(model.required_volumes(metrics), sketches):
        _lattice(usable, model.date)

    def run(step: _Step) -> tuple[int, int]:
        frame = None
        if step.parent is not None and step.parent.done.exception() is None:
            parent = spark.read.parquet(step.parent.path)
            parent = parent if step.full else on_dates(parent, step.dates, model.date)
            frame = from_parent(parent, model, step.dimensions, metrics, sketches)
        elif step.full or step.dates:
            rows = source if step.full else on_dates(source, step.dates, model.date)
            frame = rollup_frame(rows, model, step.dimensions, metrics, lookups, sketches)
        if step.full:
            write_daily_table(frame, step.path, step.dimensions, model.date)
            return _written_dates(source, step.path, model.date), spark.read.parquet(step.path).count()
        if step.dates:
            append_dates(frame, step.path, step.dimensions, model.date)
        return len(step.dates), spark.read.parquet(step.path).count()

    with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
        # Parents first: those with more dimensions are handed in before those with fewer, so no worker waits for one not yet started.
        for step in sorted(usable, key=lambda s: -len(set(s.dimensions))):
            step.done = pool.submit(run, step)
    report = []
    for step in steps:
        error = failed.get(step.name) or (str(step.done.exception()) if step.done.exception() else None)
        if error is None:
            added, rows = step.done.result()
            report.append((step.name, True, "ready", added, rows, None))
        else:
            report.append((step.name, False, "error", 0, None, error))
    schema = (
        "rollup string, success boolean, status string, dates_added bigint, row_count bigint, message string"
    )
    return spark.createDataFrame(report, schema)


def staleness(
    source: DataFrame,
    target: DataFrame | None,
    date_column: str = "date",
    keys: Sequence[Sequence[str]] = (),
) -> DataFrame:
    """One row: does the target exist, lag behind in dates, or lack composite key columns?"""
    wanted = [composite_key_name(k) for k in keys]
    # All dates come from one pass: at most one row per calendar day.
    dates = source.select(date_column).filter(F.col(date_column).isNotNull()).distinct()
    newest = dates.agg(F.max(date_column).alias("source_max"))
    if target is None:
        return newest.select(
            F.lit(True).alias("is_stale"),
            F.lit(False).alias("target_exists"),
            "source_max",
            F.lit(None).cast("date").alias("target_max"),
            F.lit(None).cast("bigint").alias("missing_dates"),
            F.lit(",".join(wanted)).alias("missing_keys"),
        )
    absent = [k for k in wanted if k not in target.columns]
    target_max = target.agg(F.max(date_column)).scalar()
    lacking = missing_dates(source, target, date_column).agg(F.count(F.lit(1))).scalar()
    return newest.withColumns({"target_max": target_max, "missing_dates": lacking}).select(
        (
            F.coalesce(F.col("source_max") > F.col("target_max"), F.lit(False)) | F.lit(bool(absent))
        ).alias("is_stale"),
        F.lit(True).alias("target_exists"),
        "source_max",
        "target_max",
        "missing_dates",
        F.lit(",".join(absent)).alias("missing_keys"),
    )


def enriched_frame(
    source: DataFrame,
    model: SemanticModel,
    keys: Sequence[Sequence[str]] = (),
    lookups: Sequence[Lookup] = (),
    metrics: Sequence[str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Required fact columns, stored composite keys and joined dimensions; row count unchanged."""
    keep = [*keep, *[c for k in keys for c in k], *[x.target for x in lookups]]
    rows = required_columns(source, model, keep, metrics)
    return join_dimensions_dedup(with_composite_keys(rows, keys), lookups)


def build_enriched_source(
    source: DataFrame,
    model: SemanticModel,
    path: str,
    keys: Sequence[Sequence[str]] = (),
    lookups: Sequence[Lookup] = (),
    cluster_by: Sequence[str] = (),
    metrics: Sequence[str] | None = None,
    exchange: bool = True,
) -> None:
    """Write the enriched copy of the fact, partitioned by date and sorted by the cluster columns.

    A fact that is itself partitioned by date needs no ``exchange``.
    """
    frame = enriched_frame(source, model, keys, lookups, metrics, cluster_by)
    write_daily_table(frame, path, cluster_by, model.date, exchange)


def refresh_enriched_source(
    source: DataFrame,
    model: SemanticModel,
    path: str,
    keys: Sequence[Sequence[str]] = (),
    lookups: Sequence[Lookup] = (),
    cluster_by: Sequence[str] = (),
    metrics: Sequence[str] | None = None,
    incremental: bool = True,
    exchange: bool = True,
    since: date | None = None,
    source_dates: Sequence[date] | None = None,
) -> int:
    """Add the dates the copy lacks, or rebuild it; returns the number of dates written.

    New dates get the same de-duplicated joins as the full build. ``since`` and ``source_dates`` are as in ``refresh_rollup``.
    """
    if not incremental or not path_exists(source, path):
        build_enriched_source(source, model, path, keys, lookups, cluster_by, metrics, exchange)
        return _written_dates(source, path, model.date)
    dates = _dates_to_write(source, path, model.date, since, source_dates)
    if dates:
        frame = enriched_frame(on_dates(source, dates, model.date), model, keys, lookups, metrics, cluster_by)
        append_dates(frame, path, cluster_by, model.date, exchange)
    return len(dates)


# How well a rollup fits a query.
EXACT_SCORE = 150
REAGGREGATE_SCORE = 100
REAGGREGATE_DISTINCT_SCORE = 80
NO_FIT = -1


def _needs(dimensions: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(dimensions)), ",")


def _set_key(rollup: Rollup) -> str:
    return ",".join(sorted(set(rollup.dimensions)))


def _candidates(rollups: Sequence[Rollup]) -> Column:
    """Readable rollups by their set of dimensions, in the order given."""
    by_key: dict[str, list[Rollup]] = {}
    for r in rollups:
        if r.ready:
            by_key.setdefault(_set_key(r), []).append(r)
    pairs = []
    for key, members in by_key.items():
        entries = [
            F.struct(
                F.lit(r.id).alias("id"), F.array(*map(F.lit, r.metrics)).cast("array<string>").alias("metrics")
            )
            for r in members
        ]
        pairs += [F.lit(key), F.array(*entries)]
    empty = F.lit(None).cast("map<string,array<struct<id:string,metrics:array<string>>>>")
    return F.create_map(*pairs) if pairs else empty


def rollup_coverage(
    queries: DataFrame,
    rollups: Sequence[Rollup],
    model: SemanticModel | None = None,
    date_column: str = "date",
) -> DataFrame:
    """The best rollup for every logged query, or -1.

    ``queries``: query_id, dimensions, filter_dimensions, metrics (arrays) and, unless a model tells
    which metrics count distinct values, distinct_metrics (boolean). With a model only its volumes
    have to be stored; the other metrics are derived from them.

    A rollup fits only when its dimensions are exactly the query's (grouped and filtered), or those
    plus the date. So each query has at most two dimension sets to look up in the catalogue, which
    is part of the plan: no join, no shuffle, whatever the size of the log.
    """
    none = F.array().cast("array<string>")

    def names(metrics: Sequence[Metric]) -> Column:
        return F.array(*[F.lit(m.id) for m in metrics]).cast("array<string>")

    needs = F.array_union(F.coalesce("dimensions", none), F.coalesce("filter_dimensions", none))
    with_date = F.array_union(needs, F.array(F.lit(date_column)))
    wanted, distinct = F.coalesce("metrics", none), F.lit(False)
    if "distinct_metrics" in queries.columns:
        distinct = F.col("distinct_metrics")
    if model is not None:
        distinct = F.arrays_overlap(wanted, names([m for m in model.volumes if m.is_distinct]))
        wanted = F.array_intersect(wanted, names(model.volumes))
    catalogue = _candidates(rollups)

    def first_fit(key: Column) -> Column:
        fitting = F.filter(
            F.try_element_at(catalogue, key),
            lambda r: F.size(F.array_except(wanted, r["metrics"])) == 0,
        )
        return F.try_element_at(fitting, F.lit(1))["id"]

    found = queries.select(
        "query_id",
        distinct.alias("_distinct"),
        first_fit(_needs(needs)).alias("_exact"),
        F.when(~F.array_contains(needs, date_column), first_fit(_needs(with_date))).alias("_daily"),
    )
    exact, daily = F.col("_exact").isNotNull(), F.col("_daily").isNotNull()
    daily_score = F.when(F.col("_distinct"), REAGGREGATE_DISTINCT_SCORE).otherwise(REAGGREGATE_SCORE)
    return found.select(
        "query_id",
        F.coalesce("_exact", "_daily").alias("rollup_id"),
        F.when(exact, EXACT_SCORE).when(daily, daily_score).otherwise(NO_FIT).alias("score"),
        (~exact & daily).alias("needs_reaggregation"),
    )


def rollup_candidates(
    queries: DataFrame,
    rollups: Sequence[Rollup],
    model: SemanticModel | None = None,
    date_column: str = "date",
) -> DataFrame:
    """Every rollup for every logged query: its score, whether it can be used, and why not.

    ``queries`` and the rules are those of ``rollup_coverage``; names in a reason are in alphabetical order. The
    catalogue is part of the plan, so a query is only copied once per rollup: no join, no shuffle.
    """
    none = F.array().cast("array<string>")

    def names(values: Sequence[str]) -> Column:
        return F.array(*map(F.lit, values)).cast("array<string>")

    entries = [
        F.struct(
            F.lit(r.id).alias("id"), names(r.dimensions).alias("dims"), names(r.metrics).alias("stored"), F.lit(r.ready).alias("ready")
        )
        for r in rollups
    ]
    distinct = F.col("distinct_metrics") if "distinct_metrics" in queries.columns else F.lit(False)
    wanted = F.coalesce("metrics", none)
    if model is not None:
        distinct = F.arrays_overlap(wanted, names([m.id for m in model.volumes if m.is_distinct]))
        wanted = F.array_intersect(wanted, names([m.id for m in model.volumes]))
    asked = queries.select(
        "query_id",
        F.coalesce("dimensions", none).alias("dims"),
        F.coalesce("filter_dimensions", none).alias("filters"),
        wanted.alias("wanted"),
        F.coalesce(distinct, F.lit(False)).alias("distinct"),
    )
    catalogue = F.array(*entries) if entries else F.array().cast("array<struct<id:string,dims:array<string>,stored:array<string>,ready:boolean>>")
    rows = asked.withColumn("r", F.explode(catalogue))

    def listed(text: str, values: Column) -> Column:
        return F.concat(F.lit(text), F.array_join(F.array_sort(values), ", "))

    lacking = F.array_except("dims", "r.dims")
    unfiltered = F.array_except("filters", "r.dims")
    unstored = F.array_except("wanted", "r.stored")
    extra = F.array_except(F.array_except("r.dims", "dims"), F.col("filters"))
    daily = extra == F.array(F.lit(date_column))
    inexact = F.when(F.col("distinct"), F.lit("usable over dates, distinct counts may be too high")).otherwise("usable over dates")
    problem = (
        F.when(~F.col("r.ready"), F.lit("not ready"))
        .when(F.size(lacking) > 0, listed("lacks dimensions: ", lacking))
        .when(F.size(unfiltered) > 0, listed("lacks filter dimensions: ", unfiltered))
        .when(F.size(unstored) > 0, listed("lacks metrics: ", unstored))
        .when((F.size(extra) > 0) & ~daily, listed("has further dimensions: ", extra))
    )
    rows = rows.withColumns({"problem": problem, "daily": daily, "note": inexact})
    merged = F.when(F.col("distinct"), REAGGREGATE_DISTINCT_SCORE).otherwise(REAGGREGATE_SCORE)
    usable = F.col("problem").isNull()
    return rows.select(
        "query_id",
        F.col("r.id").alias("rollup_id"),
        F.when(~usable, NO_FIT).when(F.col("daily"), merged).otherwise(EXACT_SCORE).alias("score"),
        usable.alias("can_use"),
        F.when(usable, F.col("daily")).alias("needs_reaggregation"),
        F.coalesce("problem", F.when(F.col("daily"), F.col("note")), F.lit("fits")).alias("reason"),
    )


def rollup_recommendations(queries: DataFrame, rollups: Sequence[Rollup]) -> DataFrame:
    """Dimension combinations that are queried but not materialised, with how often."""
    have = sorted({_set_key(r) for r in rollups})
    none = F.array().cast("array<string>")  # no dimensions, as in the coverage report
    asked = queries.select(_needs(F.coalesce("dimensions", none)).alias("dimensions"))
    lacking = asked.filter(~F.col("dimensions").isin(have)) if have else asked
    counted = lacking.groupBy("dimensions").agg(F.count(F.lit(1)).alias("query_count"))
    return counted.select(
        "dimensions",
        F.concat(F.lit("rollup_"), F.translate("dimensions", ",", "_")).alias("suggested_id"),
        "query_count",
    )


__all__ = [
    "build_enriched_source",
    "build_rollup",
    "build_rollup_batched",
    "collect_dates",
    "enriched_frame",
    "from_parent",
    "mergeable",
    "on_dates",
    "refresh_all",
    "refresh_enriched_source",
    "refresh_rollup",
    "rollup_candidates",
    "rollup_coverage",
    "rollup_frame",
    "rollup_recommendations",
    "staleness",
]
