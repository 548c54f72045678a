"""Reading fact tables and describing them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import approx_distinct

DATE_COLUMN = "date"
# Hash buckets per column from which sample values are taken.
SAMPLE_BUCKETS = 4096


def fact_scan(
    spark: SparkSession,
    source: str,
    timestamp: str | None = None,
    date_column: str = DATE_COLUMN,
    format: str = "parquet",
) -> DataFrame:
    """Read a fact table, or a rollup or optimised copy of it, by path or by catalogue name.

    With ``timestamp`` the date is a plain cast of it; Catalyst turns date comparisons back into
    timestamp ranges that reach the file reader.
    """
    is_path = "/" in source or source.endswith((".parquet", ".orc"))
    df = spark.read.format(format).load(source) if is_path else spark.table(source)
    if timestamp and date_column not in df.columns:
        df = df.withColumn(date_column, F.to_date(timestamp))
    return df


def table_info(df: DataFrame, date_column: str = DATE_COLUMN) -> DataFrame:
    """First and last date, row count and columns in one aggregate; without a date column NULLs."""
    has_date = date_column in df.columns
    day = F.col(date_column) if has_date else F.lit(None).cast("date")
    return df.agg(
        F.min(day).alias("min_date"),
        F.max(day).alias("max_date"),
        F.count(F.lit(1)).alias("total_rows"),
    ).select(
        "*",
        F.lit(has_date).alias("has_date_column"),
        F.lit(len(df.columns)).alias("schema_fields"),
        F.lit(",".join(df.columns)).alias("schema_columns"),
    )


# The naming rules that tell metrics, flags and keys apart.
METRIC_KEYWORDS = (
    "queries",
    "query",
    "purchase",
    "revenue",
    "gross",
    "total",
    "count",
    "sum",
    "amount",
    "value",
    "price",
    "cost",
    "sales",
    "orders",
    "items",
    "products",
    "clicks",
    "impressions",
    "views",
    "sessions",
)
BOOLEAN_PREFIXES = ("is_", "has_", "attr_")
KEY_SUFFIXES = ("_id", "_key")
COUNT_PREFIXES = ("n_", "num_")


def inferred_type(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "BOOLEAN"
    if isinstance(data_type, T.IntegralType):
        return "INTEGER"
    if isinstance(data_type, T.NumericType):
        return "FLOAT"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "DATE"
    return "STRING"


def column_role(name: str, data_type: T.DataType) -> tuple[str, bool]:
    """(role, filterable) of a column by its type and name."""
    lower = name.lower()
    kind = inferred_type(data_type)
    if kind == "DATE":
        return "date", True
    if kind == "BOOLEAN" or lower.startswith(BOOLEAN_PREFIXES):
        return "boolean", True
    if kind in ("INTEGER", "FLOAT"):
        keyed = lower.endswith(KEY_SUFFIXES) or lower.startswith(COUNT_PREFIXES)
        measured = any(k in lower for k in METRIC_KEYWORDS)
        return ("metric", False) if measured and not keyed else ("dimension", True)
    return "dimension", not ("search" in lower and "term" in lower)


def preview(df: DataFrame, order_by: Sequence[str], rows: int = 10) -> DataFrame:
    """The first rows in the order of the given columns, each with ``row_count``, the number of rows there are.

    A top-k beside a count that reads no column; nothing is sorted in full.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    first = df.orderBy(*[F.col(c).asc_nulls_first() for c in order_by]).limit(rows)
    return first.withColumn("row_count", total)


def column_profile(df: DataFrame, samples: int = 5, exact: bool = False) -> DataFrame:
    """Per column: type, role, NULLs, distinct values and a few sample values.

    By default small sketches count the distinct values, and samples are the smallest of what is the smallest
    value in each of ``SAMPLE_BUCKETS`` hash buckets: over all rows, with a shuffle no larger than the buckets. These
    are the column's smallest values unless two of them share a bucket. ``exact`` counts distinct values by grouping
    (column, value) pairs, which spreads even a unique column over all tasks, and samples the smallest values.
    """
    scalar = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    facts = F.create_map(
        *[
            part
            for f in scalar
            for part in (
                F.lit(f.name),
                F.struct(
                    F.lit(inferred_type(f.dataType)).alias("inferred_type"),
                    F.lit(column_role(f.name, f.dataType)[0]).alias("role"),
                    F.lit(column_role(f.name, f.dataType)[1]).alias("is_filterable"),
                ),
            )
        ]
    )
    names = [f.name for f in scalar]

    def pairs(rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(n).cast("string").alias(n) for n in names]).unpivot([], names, "column", "value")

    first = Window.partitionBy("column").orderBy(F.col("value").asc_nulls_last())
    if exact:
        counted = pairs(df).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        summary = counted.groupBy("column").agg(
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
            F.count("value").alias("unique_count"),
        )
        # Reading the count as well keeps this branch identical, so both share one shuffle.
        sampled = counted.filter(F.col("n") > 0).select("column", "value")
    else:
        sketches = df.agg(
            *[F.count_if(F.col(n).isNull()).alias(f"nulls_{n}") for n in names],
            *[approx_distinct(F.col(n)).alias(f"unique_{n}") for n in names],
        )
        entries = [
            F.struct(
                F.lit(n).alias("column"),
                F.col(f"nulls_{n}").alias("null_count"),
                F.col(f"unique_{n}").alias("unique_count"),
            )
            for n in names
        ]
        summary = sketches.select(F.inline(F.array(*entries)))
        bucket = F.pmod(F.xxhash64("value"), F.lit(SAMPLE_BUCKETS)).alias("bucket")
        sampled = pairs(df).filter(F.col("value").isNotNull()).groupBy("column", bucket).agg(F.min("value").alias("value"))
    ranked = sampled.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= samples)
    # At most `samples` values per column are gathered.
    lists = ranked.groupBy("column").agg(
        F.array_sort(F.collect_list("value")).alias("sample_values")
    )
    return (
        summary.join(lists, "column", "left")
        .withColumn("_facts", F.element_at(facts, F.col("column")))
        .select("column", "_facts.*", "null_count", "unique_count", "sample_values")
    )
