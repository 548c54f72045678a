"""Queries for scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.joins import compare_columns, comparison_long
from ..session import scratch_path
from ..sources.facts import column_profile as profile_columns
from ..sources.facts import preview as preview_rows
from ..sources.facts import table_info as describe_table
from ..sources.lookups import conform_join_key as conform
from ..sources.lookups import load_lookup as read_lookup
from ..sources.tables import append_dates as add_dates
from ..sources.tables import export_csv
from ..sources.tables import write_daily_table as write_table
from .base import query, rounded, table
from .models import EV, SEGMENTS, SHOP, shop, shop_wide, volumes_sql

EVENT_ROWS = "SELECT event_id, CAST(ts AS DATE) AS date, user_id, event_type, value FROM events"
EVENT_COLUMNS = ("event_id", "date", "user_id", "event_type", "value")


@query("fact_scan", EVENT_ROWS)
def fact_scan(spark, sf_dir):
    return shop(spark, sf_dir).select(*EVENT_COLUMNS)


@query(
    "table_info",
    """SELECT min(CAST(ts AS DATE)) AS min_date, max(CAST(ts AS DATE)) AS max_date, count(*) AS total_rows,
              true AS has_date_column, CAST(7 AS INTEGER) AS schema_fields,
              'event_id,ts,user_id,event_type,value,props,date' AS schema_columns
       FROM events""",
)
def table_info(spark, sf_dir):
    return describe_table(shop(spark, sf_dir))


@query(
    "preview",
    """SELECT event_id, CAST(ts AS DATE) AS date, event_type, (SELECT count(*) FROM events) AS row_count FROM events
       ORDER BY event_id LIMIT 10""",
)
def preview(spark, sf_dir):
    return preview_rows(shop(spark, sf_dir).select("event_id", "date", "event_type"), ["event_id"], 10)


@query("load_lookup", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def load_lookup(spark, sf_dir):
    csv = scratch_path(spark, "customers.csv")
    export_csv(table(spark, sf_dir, "customer"), csv)
    return read_lookup(
        spark,
        csv,
        key="c_custkey",
        columns=["c_mktsegment", "c_acctbal"],
        target="bigint",
        save_to=scratch_path(spark, "lookup"),
    )


@query(
    "conform_join_key",
    """SELECT s_suppkey, TRY_CAST(CASE WHEN s_acctbal < 0 THEN s_name ELSE CAST(s_suppkey AS VARCHAR) END
                                  AS BIGINT) AS join_key
       FROM supplier""",
)
def conform_join_key(spark, sf_dir):
    text = F.when(F.col("s_acctbal") < 0, F.col("s_name")).otherwise(F.col("s_suppkey").cast("string"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("join_key"))
    return conform(suppliers, "join_key", "bigint")


def _profile_sql(column: str, kind: str, role: str, filterable: str, unique: str = "") -> str:
    unique = unique or f"count(DISTINCT {column}) AS unique_count"
    return f"""SELECT '{column}' AS "column", '{kind}' AS inferred_type, '{role}' AS role,
                      {filterable} AS is_filterable, count(*) - count({column}) AS null_count,
                      {unique},
                      (SELECT string_agg(v, ';' ORDER BY v) FROM
                        (SELECT DISTINCT CAST({column} AS VARCHAR) AS v FROM customer
                         WHERE {column} IS NOT NULL ORDER BY v LIMIT 5)) AS samples
               FROM customer"""


_CUSTOMER_COLUMNS = (
    ("c_custkey", "INTEGER", "dimension", "true"),
    ("c_name", "STRING", "dimension", "true"),
    ("c_nationkey", "INTEGER", "dimension", "true"),
    ("c_acctbal", "FLOAT", "dimension", "true"),
    ("c_mktsegment", "STRING", "dimension", "true"),
)


@query(
    "column_profile_sketched",
    " UNION ALL ".join(_profile_sql(*c, unique="true AS unique_is_close") for c in _CUSTOMER_COLUMNS),
)
def column_profile_sketched(spark, sf_dir):
    """The default profile; its distinct counts are held against the exact ones."""
    customers = table(spark, sf_dir, "customer")
    exact = profile_columns(customers, exact=True).select("column", F.col("unique_count").alias("_exact"))
    profile = profile_columns(customers).join(exact, "column")
    close = F.abs(F.col("unique_count") - F.col("_exact")) <= 0.1 * F.col("_exact")
    samples = F.array_join("sample_values", ";").alias("samples")
    return profile.select(
        "column", "inferred_type", "role", "is_filterable", "null_count", close.alias("unique_is_close"), samples
    )


@query("column_profile", " UNION ALL ".join(_profile_sql(*c) for c in _CUSTOMER_COLUMNS))
def column_profile(spark, sf_dir):
    profile = profile_columns(table(spark, sf_dir, "customer"), exact=True)
    return profile.withColumn("samples", F.array_join("sample_values", ";")).drop("sample_values")


@query("write_daily_table", EVENT_ROWS)
def write_daily_table(spark, sf_dir):
    path = scratch_path(spark, "daily")
    write_table(shop(spark, sf_dir).select(*EVENT_COLUMNS), path, ["event_type", "user_id"])
    return spark.read.parquet(path).select(*EVENT_COLUMNS)


@query("append_dates", EVENT_ROWS)
def append_dates(spark, sf_dir):
    path = scratch_path(spark, "daily")
    rows = shop(spark, sf_dir).select(*EVENT_COLUMNS)
    write_table(rows.filter("date <= DATE '2024-01-15'"), path, ["event_type"])
    # The dates written twice must not be doubled.
    add_dates(rows.filter("date >= DATE '2024-01-12'"), path, ["event_type"])
    return spark.read.parquet(path).select(*EVENT_COLUMNS)


_EXPORT_PAIRS = [s.label for s in SEGMENTS[1:]]


def _export_sql() -> str:
    cells = ", ".join(f"max(CASE WHEN segment = '{s.label}' THEN v END) AS \"{s.label}\"" for s in SEGMENTS)
    control = f'"{SEGMENTS[0].label}"'
    differences = ", ".join(
        f"""coalesce("{s}", 0) - coalesce({control}, 0) AS "{s} diff",
            round(CASE WHEN coalesce({control}, 0) <> 0 THEN (coalesce("{s}", 0) / {control} - 1) * 100 END, 6)
              AS "{s} pct_diff" """
        for s in _EXPORT_PAIRS
    )
    return f"""WITH {EV}, cells AS (
            SELECT search_term, segment, {volumes_sql("queries", "purchases")} FROM ev GROUP BY ALL),
        long AS (
            SELECT search_term, segment, 'queries' AS metric, CAST(queries AS DOUBLE) AS v FROM cells
            UNION ALL
            SELECT search_term, segment, 'purchases', CAST(purchases AS DOUBLE) FROM cells),
        wide AS (SELECT search_term, metric, {cells} FROM long GROUP BY ALL)
        SELECT *, {differences} FROM wide"""


@query("export_long", _export_sql())
def export_long(spark, sf_dir):
    metrics = ["queries", "purchases"]
    compared = compare_columns(shop_wide(spark, sf_dir), SHOP, ["search_term"], SEGMENTS, metrics)
    long = rounded(comparison_long(compared, ["search_term"], SEGMENTS, metrics))
    path = scratch_path(spark, "export.csv")
    export_csv(long, path)
    return spark.read.option("header", True).schema(long.schema).csv(path)
