"""Enrichment from lookups, date differences, and column-against-column comparison.

No join is forced to broadcast: lookups are left to Catalyst and adaptive execution, which
broadcast a side whose size is below the threshold and otherwise sort-merge, with skewed partitions split. Joins that
multiply rows can be asked to sort-merge (``cluster``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from math import ceil, prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import label_value
from ..model import LABEL_SEPARATOR, Filters, Lookup, Segment, SemanticModel
from ..session import durable, scratch_path
from ..sources.lookups import store_lookup
from .aggregates import SEGMENT, in_columns, ordering, quoted, segment_metrics, segment_rows
from .filters import apply_filters, filter_dates, null_safe, search_values

Dates = Sequence[date]

_KEY = "_lookup_key"


# A key that holds this share of the fact's rows is hot; keys that a sketch of their counts follows, and copies of a hot key's row.
HOT_SHARE = 0.01
TRACKED = 10_000
HOT_SALTS = 32
# Rows that a task of a clustered join makes, about, and rows of the fact and of the lookup that meet at a time.
CLUSTERED_ROWS = 20_000_000
CLUSTERED_BLOCK = 256
CLUSTERED_SIDE = 64


def hot_keys(fact: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Keys that hold at least ``share`` of the rows, by a sketch of bounded size taken in one pass over the key.

    The sketch follows ``TRACKED`` keys; a key above the share is among them, as its count is off by the rows divided by ``TRACKED`` at
    most. So at most 1 / ``share`` keys come back.
    """
    kind = fact.schema[key].dataType
    found = fact.agg(
        F.count(F.col(quoted(key))).alias("n"), F.expr(f"approx_top_k({quoted(key)}, {int(1 / share)}, {TRACKED})").alias("top")
    )
    entries = found.select("n", F.inline("top")).filter(F.col("count") >= share * F.col("n") - F.col("n") / TRACKED)
    return [r[0] for r in entries.filter(F.col("item").isNotNull()).select(F.col("item").cast(kind)).collect()]


def _hashable(fact: DataFrame) -> list[Column]:
    return [F.col(quoted(f.name)) for f in fact.schema.fields if "map<" not in f.dataType.simpleString()]


def _salted(fact: DataFrame, lookup: Lookup, side: DataFrame, salts: int, hot: Sequence | None) -> tuple[DataFrame, DataFrame]:
    """Spread each fact key, or only the ``hot`` ones, over ``salts`` tasks and give every one of them a copy of the lookup row.

    The salt is a hash of the fact row, so a recomputed task places its rows as before.
    """
    salt = F.pmod(F.xxhash64(*_hashable(fact)), F.lit(salts)).cast("int")
    copies = F.sequence(F.lit(0), F.lit(salts - 1))
    if hot is not None:
        kind = fact.schema[lookup.target].dataType

        def is_hot(key: Column) -> Column:
            return F.coalesce(key.isin([F.lit(v).cast(kind) for v in hot]), F.lit(False))

        salt = F.when(is_hot(F.col(quoted(lookup.target))), salt).otherwise(0)
        copies = F.when(is_hot(F.col(_KEY).cast(kind)), copies).otherwise(F.array(F.lit(0)))
    return fact.withColumn("_salt", salt), side.withColumn("_copy", F.explode(copies))


def _parts(fact: DataFrame, lookup: Lookup, side: DataFrame) -> tuple[int, DataFrame | None]:
    """How many tasks a join's rows ask for, and the keys whose rows ask for several, with their number.

    One pass over the keys of either side counts the rows made. The keys are no more than the tasks. A part of a key has four fact rows
    at least, as each costs a copy of the key's lookup rows; those come from ``_sides`` tasks.
    """
    counts = fact.groupBy(F.col(quoted(lookup.target)).alias("_of")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    sides = side.groupBy(_KEY).agg(F.count(F.lit(1)).cast("double").alias("_m"))
    made = counts.join(sides, F.col("_of") == F.col(_KEY), "left").select("_of", "_n", F.coalesce("_m", F.lit(1.0)).alias("_m"))
    made = durable(made.withColumn("_made", F.col("_n") * F.col("_m")))
    tasks = ceil((made.agg(F.sum("_made")).first()[0] or 0) / CLUSTERED_ROWS)
    if tasks <= 1:
        return tasks, None
    parts = F.least(F.ceil(F.col("_made") / CLUSTERED_ROWS), F.ceil(F.col("_n") / 4)).cast("int")
    several = made.select("_of", parts.alias("_parts"), F.ceil(F.col("_m") / CLUSTERED_ROWS).cast("int").alias("_sides"))
    several = Lookup(several.filter("_parts > 1"), "_of", lookup.target, {"_parts": "_parts", "_sides": "_sides"})
    return tasks, store_lookup(several, scratch_path(fact.sparkSession, "parts")).df


def _in_blocks(df: DataFrame, by: Sequence[str], columns: Sequence[str], rows: int, name: str) -> DataFrame:
    """Rows that agree in ``by`` as arrays of so many, numbered in order of their values, so that a task run again makes the same ones."""
    number = F.row_number().over(Window.partitionBy(*map(quoted, by)).orderBy(*_hashable(df)))
    blocks = df.withColumn("_block", F.floor((number - 1) / rows)).groupBy(*map(quoted, by), "_block")
    return blocks.agg(F.collect_list(F.struct(*[F.col(quoted(c)) for c in columns])).alias(name))


def _attach_clustered(fact: DataFrame, lookup: Lookup, side: DataFrame, salts: int, find_hot: bool) -> DataFrame:
    """The join in tiles: a block of a key's fact rows meets a block of its lookup rows, and every lookup row goes with the block of fact rows.

    A column from the lookup then holds its value for a block long, and one from the fact goes through the values of one block again and
    again: both are short for a columnar file however many rows the key has, as no page has to hold all of them. Tiles are sorted
    before they are unpacked: a join that fed its rows on would first hold all that it makes of one block.
    """
    columns, target = fact.columns, quoted(lookup.target)
    tasks, several = _parts(fact, lookup, side)
    salted, spread = [], []
    if find_hot and several is not None:
        # A row without a key has no match and can go anywhere.
        to = F.when(F.col(target).isNull(), tasks).otherwise(F.coalesce("_parts", F.lit(1)))
        salt = F.pmod(F.xxhash64(*_hashable(fact)), to).cast("int")
        fact = fact.join(several, F.col(target) == F.col("_of"), "left").withColumn("_salt", salt).select(*map(quoted, columns), "_salt")
        # Keys of the fact may be one key of the lookup, as the strings '1' and '01' are one number.
        keys = side.select(F.col(_KEY).alias("_at")).distinct().join(several, F.col("_of") == F.col("_at"))
        keys = keys.groupBy("_at").agg(F.max("_parts").alias("_parts"), F.max("_sides").alias("_sides"))
        one_of = F.pmod(F.xxhash64(*_hashable(side)), F.coalesce("_sides", F.lit(1)))
        side = side.join(keys, F.col(_KEY) == F.col("_at"), "left").withColumn("_spread", one_of).drop("_at", "_sides")
        salted, spread = ["_salt"], ["_spread", "_parts"]
    elif salts > 1 and not find_hot:
        fact, side = _salted(fact, lookup, side, salts, None)
        salted, spread = ["_salt"], ["_copy"]
    if tasks > 1:  # adaptive execution would merge tasks by the bytes they read, which say nothing about the rows they make
        fact = fact.repartition(2 * tasks, target, *salted)  # twice as many, as some get several parts
    lookups = [quoted(c) for c in lookup.columns]
    tiles = _in_blocks(fact, [lookup.target, *salted], columns, CLUSTERED_BLOCK, "_rows").withColumnRenamed(lookup.target, "_target")
    side = _in_blocks(side, [_KEY, *spread], list(lookup.columns), CLUSTERED_SIDE, "_side").drop("_block")
    if "_parts" in spread:
        side = side.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    match = F.col("_target") == F.col(_KEY)
    if salted:
        match &= F.col("_salt") == F.col("_copy")
    tiles = tiles.join(side.hint("merge"), match, "left").sortWithinPartitions("_target", *salted, "_block")
    return tiles.select("_rows", F.inline_outer("_side")).select(F.inline("_rows"), *lookups)


def _attach(fact: DataFrame, lookup: Lookup, side: DataFrame, salts: int, find_hot: bool = False) -> DataFrame:
    hot = hot_keys(fact, lookup.target) if find_hot else None
    if hot:
        salts = max(salts, HOT_SALTS)
    if salts > 1 and (hot or not find_hot):
        fact, side = _salted(fact, lookup, side, salts, hot)
        match = (F.col(lookup.target) == F.col(_KEY)) & (F.col("_salt") == F.col("_copy"))
        return fact.join(side, match, "left").drop(_KEY, "_salt", "_copy")
    return fact.join(side, F.col(lookup.target) == F.col(_KEY), "left").drop(_KEY)


def _check_lookup(lookup: Lookup) -> None:
    missing = [c for c in [lookup.key, *lookup.columns.values()] if c not in lookup.df.columns]
    if missing:
        raise ValueError(f"columns not found in lookup: {missing}")


def join_dimensions(
    fact: DataFrame,
    lookups: Sequence[Lookup],
    allow_duplicates: bool = False,
    salts: int = 1,
    find_hot: bool = False,
    cluster: bool = False,
) -> DataFrame:
    """LEFT join of the named lookup columns. Duplicated lookup keys multiply fact rows.

    Unless duplicates are allowed, a lookup key that occurs twice fails the job instead. ``find_hot`` looks for hot keys first
    (``hot_keys``: one pass over the key) and spreads those alone over tasks; it is for lookups too large to be
    broadcast. ``salts`` without it spreads every key and copies the whole lookup as often.

    ``cluster`` is for lookups whose keys repeat many times: the rows of one key come out in tiles (``_attach_clustered``), so that a
    columnar file, which sees the same few values again and again, stores them in a fraction of the space; and the tasks are as many as
    the rows made ask for. It shuffles the fact once and takes one more pass over it; with it ``find_hot`` splits keys by the rows they
    make. What is not needed of the fact should be dropped before, as blocks hold whole rows.
    """
    for lookup in lookups:
        _check_lookup(lookup)
        attributes = [F.col(source).alias(name) for name, source in lookup.columns.items()]
        side = lookup.df.filter(F.col(lookup.key).isNotNull())
        if allow_duplicates or lookup.unique:
            side = side.select(F.col(lookup.key).alias(_KEY), *attributes)
        else:
            rows = side.groupBy(F.col(lookup.key).alias(_KEY)).agg(
                F.count(F.lit(1)).alias("_n"), *[F.first(a).alias(n) for a, n in zip(attributes, lookup.columns)]
            )
            # The failure sits in the join key, which no later projection can prune away.
            twice = F.raise_error(F.concat(F.lit(f"lookup key {lookup.key} is not unique: "), F.col(_KEY).cast("string")))
            key = F.when(F.col("_n") > 1, twice.cast(rows.schema[_KEY].dataType)).otherwise(F.col(_KEY))
            side = rows.select(key.alias(_KEY), *lookup.columns)
        fact = (_attach_clustered if cluster else _attach)(fact, lookup, side, salts, find_hot)
    return fact


def join_dimensions_dedup(
    fact: DataFrame, lookups: Sequence[Lookup], salts: int = 1, find_hot: bool = False
) -> DataFrame:
    """LEFT join that never changes the number of fact rows: one row per lookup key.

    Where a key repeats, each attribute takes its smallest value, so reruns agree. For lookups that are
    joined again and again, ``store_lookup`` does that once. ``salts`` and ``find_hot`` are as in ``join_dimensions``.
    """
    for lookup in lookups:
        _check_lookup(lookup)
        if lookup.unique:
            attributes = [F.col(source).alias(name) for name, source in lookup.columns.items()]
            side = lookup.df.filter(F.col(lookup.key).isNotNull()).select(F.col(lookup.key).alias(_KEY), *attributes)
            fact = _attach(fact, lookup, side, salts, find_hot)
            continue
        rows = (
            lookup.df.filter(F.col(lookup.key).isNotNull())
            .groupBy(F.col(lookup.key).alias(_KEY))
            .agg(
                F.count(F.lit(1)).alias("_n"),
                *[F.min(source).alias(name) for name, source in lookup.columns.items()],
            )
        )
        # Always the key itself, but no longer the grouping column: the join then shuffles this side
        # for itself instead of sitting on the aggregate, and only a join between two shuffles of its
        # own has its skewed partitions split by adaptive execution.
        key = F.when(F.col("_n") > 0, F.col(_KEY))
        fact = _attach(fact, lookup, rows.select(key.alias(_KEY), *lookup.columns), salts, find_hot)
    return fact


def joined_dimension_values(
    lookup: Lookup, name: str, search: str | None = None, limit: int = 1000
) -> DataFrame:
    """Distinct non-NULL values of a lookup column in order."""
    values = lookup.df.select(F.col(lookup.columns[name]).alias("value")).filter(F.col("value").isNotNull())
    return search_values(values, "value", search).distinct().orderBy("value").limit(limit)


def missing_dates(
    source: DataFrame | Dates,
    target: DataFrame | Dates,
    date_column: str = "date",
    since: date | str | None = None,
) -> DataFrame:
    """Dates of the source that the target does not have; at most one row per calendar day.

    Either side is a frame or, as ``stored_dates`` tells them for a table that is partitioned by date, a list of dates: then no row
    and no file of that side is read. ``since`` leaves older dates out, and with it the reader of a frame skips the files or
    partitions before it.
    """
    if not isinstance(source, DataFrame) and not isinstance(target, DataFrame):
        raise ValueError("one side has to be a frame; two lists of dates are a set difference")
    spark = (source if isinstance(source, DataFrame) else target).sparkSession

    def days(side: DataFrame | Dates) -> DataFrame:
        if not isinstance(side, DataFrame):
            side = spark.createDataFrame([(d,) for d in sorted(set(side))], f"{quoted(date_column)} date").coalesce(1)
        return filter_dates(side, since, date_column=date_column).select(date_column).filter(F.col(date_column).isNotNull()).distinct()

    return days(source).join(days(target), date_column, "left_anti")


def match_primary_rows(
    df: DataFrame, primary: DataFrame, dimensions: Sequence[str], metric: str, limit: int = 50
) -> DataFrame:
    """Restrict ``df`` to the row keys of the primary column's top rows, NULL matching NULL."""
    top = primary.orderBy(*ordering(primary, metric, dimensions)).limit(limit)
    keys = top.select(*[F.col(d).alias(f"_key_{d}") for d in dimensions])
    return df.join(keys, null_safe(df, keys, [(d, f"_key_{d}") for d in dimensions]), "left_semi")


def column_values(df: DataFrame, dimension: str, limit: int) -> list[str]:
    """The values of a column dimension as a list, needed before a wide result can be planned.

    ``limit`` is how many columns the caller can lay out; more values are an error, never a cut.
    """
    found = df.select(label_value(dimension).alias("v")).distinct().orderBy("v")
    values = found.limit(limit + 1).collect()
    if len(values) > limit:
        raise ValueError(f"{dimension!r} has more than {limit} values and cannot be laid out as columns")
    return [r.v for r in values]


# Combinations made at most, and by one task.
MOST_COMBINATIONS = 10_000_000
COMBINATIONS_PER_TASK = 100_000


def column_combinations(
    df: DataFrame,
    model: SemanticModel,
    dimensions: Sequence[str],
    filters: Filters | None = None,
    most: int = MOST_COMBINATIONS,
) -> DataFrame:
    """Every combination of the distinct values of the column dimensions, by index arithmetic.

    One scan finds the distinct values of all dimensions, which are numbered within their dimension. Combination i is made of the
    values that the digits of i name, in a number system with as many digits as there are dimensions, each counting its
    values; ranges of i are spread over tasks and a join for each dimension looks its digit up. No task holds all values of
    a dimension, and nothing is multiplied out on the way.

    The result is as long as the product of the numbers of values; more than ``most`` combinations are an error, found
    before any is made. ``observed_combinations`` has no such bound.
    """
    rows = apply_filters(df, model, filters, dimensions)
    values = (
        rows.select(*[label_value(d).alias(d) for d in dimensions])
        .unpivot([], list(dimensions), "dimension", "value")
        .distinct()
    )
    values = durable(values)
    sizes = {r["dimension"]: r["count"] for r in values.groupBy("dimension").count().collect()}
    total = prod(sizes.get(d, 0) for d in dimensions)
    if total > most:
        counts = ", ".join(f"{d} {sizes[d]}" for d in dimensions)
        raise ValueError(f"{total} combinations of columns ({counts}) are more than {most}")
    # The bound on the product bounds each dimension, so a window per dimension holds.
    order = Window.partitionBy("dimension").orderBy("value")
    numbered = durable(values.withColumn("digit", F.row_number().over(order).cast("bigint") - 1))
    tasks = max(1, -(-total // COMBINATIONS_PER_TASK))
    result, stride = df.sparkSession.range(0, total, 1, tasks), 1
    for k, d in reversed(list(enumerate(dimensions))):
        digit = F.expr(f"(id div {stride}) % {max(sizes.get(d, 0), 1)}")
        side = numbered.filter(F.col("dimension") == d).select(F.col("digit").alias(f"_digit_{k}"), F.col("value").alias(d))
        result = result.withColumn("_digit", digit).join(side, F.col("_digit") == F.col(f"_digit_{k}")).drop("_digit", f"_digit_{k}")
        stride *= max(sizes.get(d, 0), 1)
    return result.select(*dimensions, F.concat_ws(LABEL_SEPARATOR, *dimensions).alias("label"))


def observed_combinations(
    df: DataFrame, model: SemanticModel, dimensions: Sequence[str], filters: Filters | None = None
) -> DataFrame:
    """The combinations of column values that occur, of any number, as one distinct over the rows."""
    rows = apply_filters(df, model, filters, dimensions)
    found = rows.select(*[label_value(d).alias(d) for d in dimensions]).distinct()
    return found.withColumn("label", F.concat_ws(LABEL_SEPARATOR, *dimensions))


def segments_of(values: Mapping[str, Sequence[str]]) -> list[Segment]:
    """Segments for all combinations of the given values, labelled like the columns they make."""
    combos: list[dict[str, list[str]]] = [{}]
    for dimension, choices in values.items():
        combos = [{**c, dimension: [v]} for c in combos for v in choices]
    return [Segment(LABEL_SEPARATOR.join(v[0] for v in c.values()), c) for c in combos]


def difference_columns(value: Column, control: Column) -> tuple[Column, Column]:
    """Absolute and percent difference; an absent cell counts as 0, a zero control has no percent."""
    v, c = F.coalesce(value, F.lit(0)), F.coalesce(control, F.lit(0))
    return v - c, F.when(c != 0, (F.try_divide(v, c) - 1) * 100)


def compare_columns(
    df: DataFrame,
    model: SemanticModel,
    rows: Sequence[str],
    segments: Sequence[Segment],
    metrics: Sequence[str],
    filters: Filters | None = None,
    top_rows: int | None = None,
    stored: bool = False,
) -> DataFrame:
    """Rows against compared columns: ``<label>__<metric>`` and, against the first (control)
    column, ``..._diff`` and ``..._pct_diff``.

    One scan, aggregated by row and column and then laid out, so metrics may be of any kind. A row that a
    column does not have stays NULL there. ``top_rows`` keeps the control column's largest rows by
    the first metric. The layout has a column per cell; for very many compared columns there is ``compare_rows``.
    """
    cells = segment_metrics(df, model, segments, metrics, filters, rows, stored)
    control = segments[0].label
    select = [quoted(r) for r in rows]
    for m in metrics:
        c = f"coalesce({quoted(f'{control}__{m}')}, 0)"
        for s in segments:
            cell = f"{s.label}__{m}"
            select.append(quoted(cell))
            if s is not segments[0]:  # as ``difference_columns``, in SQL for the sake of wide layouts
                v = f"coalesce({quoted(cell)}, 0)"
                select.append(f"{v} - {c} AS {quoted(f'{cell}_diff')}")
                select.append(f"CASE WHEN {c} <> 0 THEN (try_divide({v}, {c}) - 1) * 100 END AS {quoted(f'{cell}_pct_diff')}")
    result = cells
    if top_rows is not None:
        first = f"{control}__{metrics[0]}"
        result = result.filter(F.col(f"`{control}__rows`") > 0)
        result = result.orderBy(*ordering(result, f"`{first}`", rows)).limit(top_rows)
    return result.selectExpr(*select)


def compare_rows(
    df: DataFrame,
    model: SemanticModel,
    rows: Sequence[str],
    segments: Sequence[Segment],
    metrics: Sequence[str],
    filters: Filters | None = None,
    stored: bool = False,
) -> DataFrame:
    """The comparison in long form: a row per (row, compared column) that has data, for any number of columns.

    ``segment`` is the column's label; each metric has ``<metric>_diff`` and ``<metric>_pct_diff`` against the
    first (control) column, which the control itself has as 0.
    """
    long = segment_rows(df, model, segments, metrics, filters, rows, stored)
    base = in_columns(long.filter(F.col(SEGMENT) == 0), [Segment("_control", {})], metrics, rows)
    keys = base.select(*[F.col(r).alias(f"_row_{r}") for r in rows], *[c for c in base.columns if c not in set(rows)])
    same = null_safe(long, keys, [(r, f"_row_{r}") for r in rows]) if rows else F.lit(True)
    joined = long.join(keys, same, "left")
    labels = F.array(*[F.lit(s.label) for s in segments])
    select = [*[F.col(r) for r in rows], F.get(labels, F.col(SEGMENT)).alias("segment")]
    for m in metrics:
        diff, pct = difference_columns(F.col(m), F.col(f"_control__{m}"))
        select += [F.col(m), diff.alias(f"{m}_diff"), pct.alias(f"{m}_pct_diff")]
    return joined.select(*select)


def comparison_long(
    compared: DataFrame, rows: Sequence[str], segments: Sequence[Segment], metrics: Sequence[str]
) -> DataFrame:
    """One row per (row, metric), with value, diff and % diff of each compared column."""
    fields = []
    for m in metrics:
        parts = [F.lit(m).alias("metric")]
        for i, s in enumerate(segments):
            parts.append(F.col(f"`{s.label}__{m}`").cast("double").alias(s.label))
            if i:
                parts.append(F.col(f"`{s.label}__{m}_diff`").cast("double").alias(f"{s.label} diff"))
                parts.append(F.col(f"`{s.label}__{m}_pct_diff`").cast("double").alias(f"{s.label} pct_diff"))
        fields.append(F.struct(*parts))
    return compared.select(*rows, F.inline(F.array(*fields)))


__all__ = [
    "column_combinations",
    "column_values",
    "hot_keys",
    "compare_columns",
    "compare_rows",
    "comparison_long",
    "join_dimensions",
    "join_dimensions_dedup",
    "joined_dimension_values",
    "match_primary_rows",
    "missing_dates",
    "observed_combinations",
    "segments_of",
]
