"""Semantic models over the test tables: a shop funnel on events, and sales on line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Dimension, Lookup, Segment, SemanticModel, derived, volume
from ..operators.derived import ECOMMERCE_RATES
from ..operators.joins import join_dimensions_dedup
from ..session import scratch_path
from ..sources import path_exists, store_lookup
from ..sources.facts import fact_scan
from .base import table

AS_OF = "2024-01-30"

SHOP = SemanticModel(
    metrics=(
        volume("queries", "count", "CASE WHEN {event_type} = 'view' THEN 1 END"),
        volume("queries_pdp", "count", "CASE WHEN {event_type} = 'click' THEN 1 END"),
        volume("queries_a2c", "count", "CASE WHEN {event_type} = 'signup' THEN 1 END"),
        volume("purchases", "count", "CASE WHEN {event_type} = 'purchase' THEN 1 END"),
        volume("gross_purchase", "sum", "CASE WHEN {event_type} = 'purchase' THEN {value} ELSE 0 END"),
        volume("visitors", "count_distinct", "{user_id}"),
        *ECOMMERCE_RATES,
        derived("click_to_buy_gap", "{ctr} - {conversion_rate}"),
    ),
    dimensions=(
        Dimension("event_type"),
        Dimension("user_id"),
        Dimension("search_term", "get_json_object({props}, '$.k')", filterable=False),
        Dimension("term_group", "concat('group ', length(get_json_object({props}, '$.k')))"),
    ),
    primary_metric="queries",
)

# Additive volumes only: what can be summed over days without overstating.
FUNNEL = ("queries", "queries_pdp", "queries_a2c", "purchases", "gross_purchase")
RATES = tuple(m.id for m in ECOMMERCE_RATES)

SALES = SemanticModel(
    metrics=(
        volume("quantity", "sum", "{l_quantity}"),
        volume("revenue", "sum", "{l_extendedprice} * (1 - {l_discount})"),
        volume("lines", "count", "1"),
        volume("orders", "count_distinct", "{l_orderkey}"),
        derived("revenue_per_order", "try_divide({revenue}, {orders})", "revenue", "currency"),
    ),
    dimensions=(
        Dimension("l_returnflag"),
        Dimension("l_linestatus"),
        Dimension("l_linenumber"),
        Dimension("size_class", "CASE WHEN {l_quantity} < 15 THEN 'small' WHEN {l_quantity} < 35 THEN 'medium' ELSE 'large' END"),
    ),
    primary_metric="revenue",
)

SEGMENT_VALUES = ("BUILDING", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY")
SEGMENTS = [Segment(v, {"segment": [v]}) for v in SEGMENT_VALUES]


def shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event fact with its date."""
    return fact_scan(spark, f"{sf_dir}/events.parquet", timestamp="ts")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", "c_mktsegment", "n_name", "r_name")
    )


def customer_lookup(spark: SparkSession, sf_dir: str, target: str = "user_id", unique: bool = False) -> Lookup:
    columns = {"segment": "c_mktsegment", "nation": "n_name", "region": "r_name"}
    return Lookup(customers(spark, sf_dir), "c_custkey", target, columns, unique)


# Where this program has stored the customers of a folder, by application.
_stored: dict[tuple[str, str], str] = {}


def stored_customers(spark: SparkSession, sf_dir: str, target: str = "user_id") -> Lookup:
    """The customer lookup, joined from its three tables and stored once per session and folder.

    Its size is then known when a query is planned: while it is small the fact stays where it is.
    """
    lookup = customer_lookup(spark, sf_dir, target, unique=True)
    key = spark.sparkContext.applicationId, sf_dir
    path = _stored.get(key)
    if path is None or not path_exists(spark, path):
        path = _stored[key] = scratch_path(spark, "customers")
        store_lookup(lookup, path)
    return Lookup(spark.read.parquet(path), lookup.key, target, lookup.columns, unique=True)


def shop_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with segment, nation and region of the visitor."""
    return join_dimensions_dedup(shop(spark, sf_dir), [stored_customers(spark, sf_dir)])


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line item fact with its date."""
    return fact_scan(spark, f"{sf_dir}/lineitem.parquet", timestamp="l_shipdate")


def sales_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with order priority and the customer's segment, nation and region."""
    orders = Lookup(
        table(spark, sf_dir, "orders"),
        "o_orderkey",
        "l_orderkey",
        {"priority": "o_orderpriority", "custkey": "o_custkey"},
        unique=True,
    )
    return join_dimensions_dedup(
        sales(spark, sf_dir), [orders, stored_customers(spark, sf_dir, "custkey")]
    )


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query log read off the events: who asked what, when, how long it took."""
    events = table(spark, sf_dir, "events")
    term = F.get_json_object("props", "$.k")
    return events.select(
        F.col("event_id").alias("log_id"),
        F.col("ts").alias("created_at"),
        F.col("event_type").alias("query_type"),
        F.concat(F.lit("/api/"), F.col("event_type"), F.lit("/"), term).alias("endpoint"),
        F.floor(F.col("value") * 10).cast("bigint").alias("execution_time_ms"),
        (F.col("user_id") * 1024).alias("bytes_processed"),
        (F.col("user_id") * 2048).alias("bytes_billed"),
        (F.col("event_type") != "error").alias("is_success"),
        (F.col("value") < 25).alias("cache_hit"),
    )


# ---- the same tables in SQL -------------------------------------------------------------------

EV = """ev AS (
    SELECT e.event_id, e.ts, CAST(e.ts AS DATE) AS date, e.user_id, e.event_type, e.value,
           json_extract_string(e.props, '$.k') AS search_term,
           c.c_mktsegment AS segment, n.n_name AS nation, r.r_name AS region
    FROM events e
    LEFT JOIN customer c ON e.user_id = c.c_custkey
    LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
    LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

LI = """li AS (
    SELECT l.*, CAST(l.l_shipdate AS DATE) AS date, o.o_orderpriority AS priority, o.o_custkey AS custkey,
           c.c_mktsegment AS segment, n.n_name AS nation, r.r_name AS region
    FROM lineitem l
    LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
    LEFT JOIN customer c ON o.o_custkey = c.c_custkey
    LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
    LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

LOG = """lg AS (
    SELECT event_id AS log_id, ts AS created_at, event_type AS query_type,
           '/api/' || event_type || '/' || json_extract_string(props, '$.k') AS endpoint,
           CAST(floor(value * 10) AS BIGINT) AS execution_time_ms,
           user_id * 1024 AS bytes_processed, user_id * 2048 AS bytes_billed,
           event_type <> 'error' AS is_success, value < 25 AS cache_hit
    FROM events
)"""

VOLUME_SQL = {
    "queries": "count(CASE WHEN event_type = 'view' THEN 1 END)",
    "queries_pdp": "count(CASE WHEN event_type = 'click' THEN 1 END)",
    "queries_a2c": "count(CASE WHEN event_type = 'signup' THEN 1 END)",
    "purchases": "count(CASE WHEN event_type = 'purchase' THEN 1 END)",
    "gross_purchase": "round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 6)",
    "visitors": "count(DISTINCT user_id)",
    "quantity": "round(sum(l_quantity), 4)",
    "revenue": "round(sum(l_extendedprice * (1 - l_discount)), 4)",
    "lines": "count(*)",
    "orders": "count(DISTINCT l_orderkey)",
}

RATE_SQL = {m.id: f"round({m.numerator} / nullif({m.denominator}, 0), 10)" for m in ECOMMERCE_RATES}


def volumes_sql(*ids: str) -> str:
    return ", ".join(f"{VOLUME_SQL[i]} AS {i}" for i in ids)


def rates_sql(*ids: str) -> str:
    return ", ".join(f"{RATE_SQL[i]} AS {i}" for i in (ids or RATES))
