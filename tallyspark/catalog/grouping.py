"""Queries for grouped metrics: pivot, totals, trends, values, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import Filters, Segment
from ..operators import aggregates as ops
from ..plans.rollups import rollup_frame
from .base import query, rounded, timed
from .models import (
    EV,
    FUNNEL,
    LI,
    SALES,
    SHOP,
    customer_lookup,
    rates_sql,
    sales,
    sales_wide,
    shop,
    shop_wide,
    volumes_sql,
)

JANUARY = Filters(start="2024-01-01", end="2024-01-31")
_IN_JANUARY = "date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'"

_SHARES = ", ".join(
    f"round(CASE WHEN sum({m}) OVER () > 0 THEN {m} / sum({m}) OVER () * 100 ELSE 0 END, 2) AS {m}_pct"
    for m in (*FUNNEL, "visitors")
)


@query(
    "volume_metrics",
    """SELECT event_type, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean,
              min(value) AS low, max(value) AS high, count(DISTINCT user_id) AS users,
              round(sum(value) - count(*), 6) AS margin
       FROM events GROUP BY event_type""",
)
def volume_metrics(spark, sf_dir):
    from ..model import SemanticModel, sql_volume, volume

    model = SemanticModel(
        metrics=(
            volume("n", "count", "1"),
            volume("total", "sum", "{value}"),
            volume("mean", "avg", "{value}"),
            volume("low", "min", "{value}"),
            volume("high", "max", "{value}"),
            volume("users", "count_distinct", "{user_id}"),
            sql_volume("margin", "sum({value}) - count(1)"),
        )
    )
    return rounded(shop(spark, sf_dir).groupBy("event_type").agg(*ops.volume_metrics(model)))


@query(
    "pivot",
    f"""WITH {EV}, g AS (
            SELECT search_term, {volumes_sql(*FUNNEL, "visitors")} FROM ev WHERE {_IN_JANUARY} GROUP BY 1),
        s AS (
            SELECT *, search_term AS label, {rates_sql()},
                   round(queries_pdp / nullif(queries, 0) - purchases / nullif(queries, 0), 6) AS click_to_buy_gap,
                   {_SHARES},
                   round(CASE WHEN sum(queries) OVER () > 0 THEN queries / sum(queries) OVER () * 100 ELSE 0 END, 6)
                     AS percentage_of_total
            FROM g)
        SELECT * FROM s ORDER BY queries DESC, search_term LIMIT 50""",
)
def pivot(spark, sf_dir):
    return rounded(ops.pivot(shop(spark, sf_dir), SHOP, ["search_term"], JANUARY))


@query(
    "pivot_page",
    f"""WITH {LI}, g AS (
            SELECT segment, priority, {volumes_sql("revenue", "orders")} FROM li
            WHERE date >= DATE '1996-01-01' AND l_returnflag IN ('A', 'R') GROUP BY ALL),
        p AS (SELECT * FROM g ORDER BY revenue DESC, segment, priority LIMIT 5 OFFSET 3)
        SELECT segment, priority, segment || ' - ' || priority AS label, revenue, orders,
               round(revenue / nullif(orders, 0), 6) AS revenue_per_order,
               round(revenue / sum(revenue) OVER () * 100, 2) AS revenue_pct,
               round(orders / sum(orders) OVER () * 100, 2) AS orders_pct,
               round(revenue / sum(revenue) OVER () * 100, 6) AS percentage_of_total
        FROM p""",
)
def pivot_page(spark, sf_dir):
    filters = Filters(start="1996-01-01", dimensions={"l_returnflag": ["A", "R"]})
    page = ops.pivot(
        sales_wide(spark, sf_dir),
        SALES,
        ["segment", "priority"],
        filters,
        ["revenue", "orders", "revenue_per_order"],
        limit=5,
        offset=3,
        scope="page",
    )
    return rounded(page.withColumn("revenue", F.round("revenue", 4)))


@query(
    "kpi_totals",
    f"""WITH {EV}, g AS (
            SELECT {volumes_sql(*FUNNEL, "visitors")} FROM ev
            WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' AND segment IN ('BUILDING', 'MACHINERY'))
        SELECT *, {rates_sql()},
               round(queries_pdp / nullif(queries, 0) - purchases / nullif(queries, 0), 6) AS click_to_buy_gap
        FROM g""",
)
def kpi_totals(spark, sf_dir):
    filters = Filters("2024-01-10", "2024-01-20", dimensions={"segment": ["BUILDING", "MACHINERY"]})
    return rounded(ops.kpi_totals(shop_wide(spark, sf_dir), SHOP, filters))


@query(
    "trend",
    f"""WITH {EV}, g AS (
            SELECT date - CAST(dayofweek(date) AS INTEGER) AS date, {volumes_sql("queries", "purchases", "visitors")}
            FROM ev GROUP BY 1)
        SELECT *, {rates_sql("conversion_rate")} FROM g""",
)
def trend(spark, sf_dir):
    metrics = ["queries", "purchases", "visitors", "conversion_rate"]
    return rounded(ops.trend(shop(spark, sf_dir), SHOP, "weekly", metrics=metrics))


@query(
    "trend_monthly",
    f"""WITH {LI} SELECT CAST(date_trunc('month', date) AS DATE) AS date, {volumes_sql("quantity", "revenue", "orders")}
        FROM li GROUP BY 1""",
)
def trend_monthly(spark, sf_dir):
    metrics = ["quantity", "revenue", "orders"]
    return rounded(ops.trend(sales(spark, sf_dir), SALES, "monthly", metrics=metrics), 4)


@query(
    "breakdown",
    f"""WITH {LI} SELECT coalesce(CAST(l_linenumber AS VARCHAR), '__NULL__') AS dimension_value,
               {volumes_sql("quantity", "lines", "orders")}
        FROM li GROUP BY 1 ORDER BY 1 LIMIT 20""",
)
def breakdown(spark, sf_dir):
    metrics = ["quantity", "lines", "orders"]
    return rounded(ops.breakdown(sales(spark, sf_dir), SALES, "l_linenumber", metrics=metrics), 4)


@query(
    "top_terms",
    f"""WITH {EV}, g AS (SELECT search_term, {volumes_sql(*FUNNEL)} FROM ev GROUP BY 1)
        SELECT *, {rates_sql("ctr", "aov")} FROM g ORDER BY purchases DESC, search_term LIMIT 30""",
)
def top_terms(spark, sf_dir):
    metrics = [*FUNNEL, "ctr", "aov"]
    return rounded(ops.top_terms(shop(spark, sf_dir), SHOP, None, metrics, sort_by="purchases", limit=30))


@query(
    "dimension_values",
    f"""WITH {EV} SELECT DISTINCT search_term AS value FROM ev WHERE contains(search_term, '1')
        ORDER BY 1 LIMIT 1000""",
)
def dimension_values(spark, sf_dir):
    return ops.dimension_values(shop(spark, sf_dir), SHOP, "search_term", search="1")


@query(
    "dimension_values_by_metric",
    f"""WITH {EV} SELECT search_term AS value, {volumes_sql("purchases")} FROM ev GROUP BY 1
        ORDER BY 2 DESC, 1 LIMIT 40""",
)
def dimension_values_by_metric(spark, sf_dir):
    daily = rollup_frame(shop(spark, sf_dir), SHOP, ["date", "search_term"], FUNNEL)
    return ops.dimension_values_by_metric(daily, SHOP, "search_term", "purchases", limit=40)


def _options_sql(dimension: str) -> str:
    return f"""SELECT '{dimension}' AS dimension, coalesce(CAST(v AS VARCHAR), '__NULL__') AS value,
                      CAST(row_number() OVER (ORDER BY v NULLS FIRST) AS INTEGER) AS position
               FROM (SELECT DISTINCT {dimension} AS v FROM ev) QUALIFY position <= 25"""


@query(
    "filter_options",
    f"WITH {EV} " + " UNION ALL ".join(map(_options_sql, ("event_type", "segment", "region", "user_id"))),
)
def filter_options(spark, sf_dir):
    dims = ["event_type", "segment", "region", "user_id"]
    return ops.filter_options(shop_wide(spark, sf_dir), SHOP, dims, limit=25)


@query(
    "group_count",
    f"WITH {EV} SELECT count(*) AS total_count FROM (SELECT DISTINCT search_term, user_id FROM ev)",
)
def group_count(spark, sf_dir):
    return ops.group_count(shop(spark, sf_dir), SHOP, ["search_term", "user_id"])


@query(
    "group_count_approx",
    f"""WITH {EV} SELECT count(*) AS total_count, true AS is_close
        FROM (SELECT DISTINCT search_term, user_id FROM ev)""",
)
def group_count_approx(spark, sf_dir):
    """The exact count, and whether the sketch is within five percent of it."""
    names = ["search_term", "user_id"]
    estimate = ops.group_count_approx(shop(spark, sf_dir), SHOP, names).scalar()
    exact = ops.group_count(shop(spark, sf_dir), SHOP, names)
    return exact.withColumn("is_close", F.abs(estimate - F.col("total_count")) <= 0.05 * F.col("total_count"))


@timed("group_count_approx")
def _group_count_approx(spark, sf_dir):
    return ops.group_count_approx(shop(spark, sf_dir), SHOP, ["search_term", "user_id"])


@query(
    "composite_key",
    """SELECT l_returnflag, count(DISTINCT CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_partkey AS VARCHAR)) AS pairs,
              min(CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_partkey AS VARCHAR)) AS first_key
       FROM lineitem GROUP BY 1""",
)
def composite_key(spark, sf_dir):
    keyed = ops.with_composite_keys(sales(spark, sf_dir), [["l_partkey", "l_orderkey"]])
    key = "_key_l_orderkey_l_partkey"
    return keyed.groupBy("l_returnflag").agg(
        F.count_distinct(key).alias("pairs"), F.min(key).alias("first_key")
    )


def _distinct_sql(column: str) -> str:
    return f"SELECT '{column}' AS column_name, count(DISTINCT {column}) AS n FROM li"


_RANKED = ("l_orderkey", "l_partkey", "l_suppkey", "segment", "l_returnflag", "l_linestatus", "l_linenumber")


@query(
    "cardinality_ranking",
    f"""WITH {LI} SELECT column_name, CAST(row_number() OVER (ORDER BY n DESC) AS INTEGER) AS position FROM
        ({" UNION ALL ".join(map(_distinct_sql, _RANKED))}) QUALIFY position <= 4""",
)
def cardinality_ranking(spark, sf_dir):
    # The counts are approximate, their order is not at these distances.
    return ops.cardinality_ranking(sales_wide(spark, sf_dir), list(_RANKED)).select("column_name", "position")


@query(
    "rollup_totals",
    f"""WITH {EV} SELECT {volumes_sql("queries", "purchases", "gross_purchase")} FROM ev
        WHERE date >= DATE '2024-01-15' AND segment = 'MACHINERY'""",
)
def rollup_totals(spark, sf_dir):
    fact, lookup = shop(spark, sf_dir), customer_lookup(spark, sf_dir)
    daily = rollup_frame(fact, SHOP, ["date", "segment"], FUNNEL, [lookup])
    filters = Filters(start="2024-01-15", dimensions={"segment": ["MACHINERY"]})
    return rounded(ops.rollup_totals(daily, SHOP, ["queries", "purchases", "gross_purchase"], filters))


@query(
    "pivot_from_rollup",
    f"""WITH {EV} SELECT segment, search_term, {volumes_sql("queries", "purchases")} FROM ev
        GROUP BY ALL ORDER BY queries DESC, segment, search_term LIMIT 60 OFFSET 20""",
)
def pivot_from_rollup(spark, sf_dir):
    fact, lookup = shop(spark, sf_dir), customer_lookup(spark, sf_dir)
    daily = rollup_frame(fact, SHOP, ["date", "segment", "search_term"], FUNNEL, [lookup])
    return ops.pivot_from_rollup(
        daily, SHOP, ["segment", "search_term"], ["queries", "purchases"], limit=60, offset=20
    )


@query(
    "segment_totals",
    f"""WITH {EV} SELECT
            count(*) FILTER (WHERE region = 'ASIA') AS "asia__rows",
            count(*) FILTER (WHERE region = 'ASIA' AND event_type = 'view') AS "asia__queries",
            count(*) FILTER (WHERE region = 'ASIA' AND event_type = 'purchase') AS "asia__purchases",
            count(DISTINCT user_id) FILTER (WHERE region = 'ASIA') AS "asia__visitors",
            count(DISTINCT user_id) FILTER (WHERE region IN ('ASIA', 'EUROPE') AND segment = 'BUILDING')
              AS "builders__visitors",
            count(*) FILTER (WHERE region IN ('ASIA', 'EUROPE') AND segment = 'BUILDING') AS "builders__rows",
            count(*) FILTER (WHERE region IN ('ASIA', 'EUROPE') AND segment = 'BUILDING' AND event_type = 'view')
              AS "builders__queries",
            count(*) FILTER (WHERE region IN ('ASIA', 'EUROPE') AND segment = 'BUILDING' AND event_type = 'purchase')
              AS "builders__purchases"
        FROM ev WHERE date >= DATE '2024-01-05'""",
)
def segment_totals(spark, sf_dir):
    # The second segment overlaps the first and keeps the base filter's regions.
    segments = [Segment("asia", {"region": ["ASIA"]}), Segment("builders", {"segment": ["BUILDING"]})]
    filters = Filters(start="2024-01-05", dimensions={"region": ["ASIA", "EUROPE"]})
    return ops.segment_totals(shop_wide(spark, sf_dir), SHOP, segments, ["queries", "purchases", "visitors"], filters)


@query(
    "observed_days",
    f"""WITH {EV} SELECT search_term, min(date) AS min_date, max(date) AS max_date,
               CAST(max(date) - min(date) + 1 AS INTEGER) AS num_days
        FROM ev WHERE event_type = 'purchase' GROUP BY 1""",
)
def observed_days(spark, sf_dir):
    filters = Filters(dimensions={"event_type": ["purchase"]})
    return ops.observed_days(shop(spark, sf_dir), SHOP, filters, by=["search_term"])


@query(
    "avg_per_day",
    f"""WITH {EV}, g AS (SELECT segment, {volumes_sql("queries")} FROM ev
            WHERE date BETWEEN DATE '2024-01-24' AND DATE '2024-01-30' GROUP BY 1)
        SELECT *, round(queries / 7, 6) AS queries_per_day FROM g""",
)
def avg_per_day(spark, sf_dir):
    filters = Filters(preset="last_7_days", as_of="2024-01-30")
    rows = ops.grouped(shop_wide(spark, sf_dir), SHOP, ["segment"], filters, ["queries"])
    return rounded(ops.avg_per_day(rows, "queries", filters))


@query(
    "reaggregate_metric",
    f"""WITH {LI}, g AS (SELECT segment, priority, {volumes_sql("quantity", "lines")} FROM li GROUP BY ALL)
        SELECT *, round(sum(quantity) OVER (PARTITION BY segment), 4) AS quantity_sum,
               round(avg(quantity) OVER (PARTITION BY segment), 4) AS quantity_avg,
               max(lines) OVER (PARTITION BY priority) AS lines_max,
               min(lines) OVER () AS lines_min, count(lines) OVER (PARTITION BY priority) AS lines_count
        FROM g""",
)
def reaggregate_metric(spark, sf_dir):
    dims = ["segment", "priority"]
    rows = ops.grouped(sales_wide(spark, sf_dir), SALES, dims, None, ["quantity", "lines"])
    rows = ops.reaggregate_metrics(
        rows,
        dims,
        [
            ops.Reaggregation("quantity_sum", "quantity", ["priority"], "sum"),
            ops.Reaggregation("quantity_avg", "quantity", ["priority"], "avg"),
            ops.Reaggregation("lines_max", "lines", ["segment"], "max"),
            ops.Reaggregation("lines_min", "lines", dims, "min"),
            ops.Reaggregation("lines_count", "lines", ["segment"], "count"),
        ],
    )
    return rounded(rows, 4)


@query(
    "total_row",
    f"""WITH {EV}, g AS (SELECT search_term, {volumes_sql(*FUNNEL, "visitors")} FROM ev GROUP BY 1),
        t AS (SELECT sum(queries)::BIGINT AS queries, sum(queries_pdp)::BIGINT AS queries_pdp,
                     sum(queries_a2c)::BIGINT AS queries_a2c, sum(purchases)::BIGINT AS purchases,
                     round(sum(gross_purchase), 6) AS gross_purchase, sum(visitors)::BIGINT AS visitors,
                     count(*) AS row_count FROM g)
        SELECT 'Total' AS label, *, {rates_sql()},
               round(queries_pdp / nullif(queries, 0) - purchases / nullif(queries, 0), 6) AS click_to_buy_gap,
               CAST(100 AS DOUBLE) AS percentage_of_total FROM t""",
)
def total_row(spark, sf_dir):
    return rounded(ops.total_row(shop(spark, sf_dir), SHOP, ["search_term"]))
