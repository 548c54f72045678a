"""Queries for derived metrics, shares and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import truncate_date
from ..functions.scalars import extract_or_null, strict_greatest, strict_least
from ..functions.scalars import safe_divide as divide
from ..model import derived
from ..operators import derived as ops
from ..operators.aggregates import grouped
from ..plans.rollups import rollup_frame
from .base import query, rounded
from .models import EV, FUNNEL, LI, SALES, SHOP, customer_lookup, rates_sql, sales_wide, shop, volumes_sql

_TERMS = f"t AS (SELECT search_term, {volumes_sql(*FUNNEL)} FROM ev GROUP BY 1)"


@query(
    "safe_divide",
    """WITH k AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
       SELECT event_id, round(value / nullif(k, 0), 12) AS or_null,
              coalesce(round(value / nullif(k, 0), 12), 0) AS or_zero FROM k""",
)
def safe_divide(spark, sf_dir):
    divisor = F.get_json_object("props", "$.k").cast("bigint")
    return rounded(
        shop(spark, sf_dir).select(
            "event_id",
            divide(F.col("value"), divisor).alias("or_null"),
            divide(F.col("value"), divisor, 0.0).alias("or_zero"),
        ),
        12,
    )


@query(
    "derived_metrics",
    f"""WITH {LI}, g AS (SELECT segment, region, {volumes_sql("revenue", "orders", "quantity")} FROM li GROUP BY ALL)
        SELECT *, round(revenue / nullif(orders, 0), 4) AS revenue_per_order,
               round(revenue / nullif(quantity, 0), 4) AS price FROM g""",
)
def derived_metrics(spark, sf_dir):
    rows = grouped(sales_wide(spark, sf_dir), SALES, ["segment", "region"], None, ["revenue", "orders", "quantity"])
    metrics = [
        SALES.metric("revenue_per_order"),
        derived("price", "try_divide({revenue}, {quantity})"),
        derived("skipped", "{no_such_metric} * 2"),
    ]
    return rounded(ops.derived_metrics(rows, metrics), 4)


@query(
    "nested_metrics",
    f"""WITH {EV}, {_TERMS}, r AS (SELECT *, queries_pdp / nullif(queries, 0) AS ctr,
                                          purchases / nullif(queries, 0) AS conversion_rate FROM t)
        SELECT search_term, queries, queries_pdp, purchases, round(ctr, 10) AS ctr,
               round(conversion_rate, 10) AS conversion_rate, round(ctr - conversion_rate, 6) AS gap,
               round((ctr - conversion_rate) * 100 / nullif(ctr, 0), 6) AS gap_pct
        FROM r""",
)
def nested_metrics(spark, sf_dir):
    base = ["queries", "queries_pdp", "purchases"]
    rows = grouped(shop(spark, sf_dir), SHOP, ["search_term"], None, base)
    metrics = [
        # Listed before what they need: order follows the references, not the list.
        derived("gap_pct", "try_divide({gap} * 100, {ctr})"),
        derived("gap", "{ctr} - {conversion_rate}"),
        SHOP.metric("ctr"),
        SHOP.metric("conversion_rate"),
    ]
    return rounded(ops.derived_metrics(rows, metrics))


@query("ecommerce_rates", f"WITH {EV}, {_TERMS} SELECT *, {rates_sql()} FROM t")
def ecommerce_rates(spark, sf_dir):
    rows = grouped(shop(spark, sf_dir), SHOP, ["search_term"], None, FUNNEL)
    return rounded(ops.derived_metrics(rows, ops.ECOMMERCE_RATES))


_PCT = """round(CASE WHEN sum(queries) OVER () > 0 THEN queries / sum(queries) OVER () * 100 ELSE 0 END, {digits})"""


@query(
    "pct_of_total",
    f"""WITH {EV}, {_TERMS} SELECT search_term, queries, purchases, {_PCT.format(digits=2)} AS queries_pct,
               round(purchases / sum(purchases) OVER () * 100, 2) AS purchases_pct,
               {_PCT.format(digits=6)} AS percentage_of_total FROM t""",
)
def pct_of_total(spark, sf_dir):
    rows = grouped(shop(spark, sf_dir), SHOP, ["search_term"], None, ["queries", "purchases"])
    return rounded(ops.pct_of_total(rows, ["queries", "purchases"]))


@query(
    "baseline_inflation",
    f"""WITH {EV}, d AS (SELECT date, {volumes_sql("queries", "visitors")} FROM ev GROUP BY 1),
        b AS (SELECT date, segment, search_term, {volumes_sql("queries", "visitors")} FROM ev GROUP BY ALL),
        c AS (SELECT 'queries' AS metric, (SELECT sum(queries) FROM d) AS baseline, (SELECT sum(queries) FROM b) AS current
              UNION ALL SELECT 'visitors', (SELECT sum(visitors) FROM d), (SELECT sum(visitors) FROM b))
        SELECT metric, CAST(baseline AS DOUBLE) AS baseline, CAST(current AS DOUBLE) AS current,
               round(current / baseline, 6) AS ratio, current / baseline > 1.01 AS is_inflated FROM c""",
)
def baseline_inflation(spark, sf_dir):
    fact, metrics = shop(spark, sf_dir), ["queries", "visitors"]
    baseline = rollup_frame(fact, SHOP, ["date"], metrics)
    lookup = customer_lookup(spark, sf_dir)
    detailed = rollup_frame(fact, SHOP, ["date", "segment", "search_term"], metrics, [lookup])
    return rounded(ops.baseline_inflation(detailed, baseline, metrics))


@query(
    "cumulative_share",
    f"""WITH {EV}, {_TERMS}, p AS (SELECT search_term, queries, queries / sum(queries) OVER () * 100 AS share FROM t)
        SELECT search_term, queries, round(share, 6) AS percentage_of_total,
               round(sum(share) OVER (ORDER BY queries DESC, search_term ROWS UNBOUNDED PRECEDING), 6)
                 AS cumulative_percentage FROM p""",
)
def cumulative_share(spark, sf_dir):
    rows = grouped(shop(spark, sf_dir), SHOP, ["search_term"], None, ["queries"])
    shares = ops.pct_of_total(rows, ["queries"]).drop("queries_pct")
    return rounded(ops.cumulative_share(shares, [F.col("queries").desc(), F.col("search_term")]))


@query(
    "cumulative_count",
    f"""WITH {EV}, g AS (SELECT user_id, search_term, {volumes_sql("queries")} FROM ev GROUP BY ALL)
        SELECT *, row_number() OVER (ORDER BY queries DESC, user_id, search_term) AS cumulative_terms FROM g""",
)
def cumulative_count(spark, sf_dir):
    rows = grouped(shop(spark, sf_dir), SHOP, ["user_id", "search_term"], None, ["queries"])
    order = [F.col("queries").desc(), F.col("user_id"), F.col("search_term")]
    return ops.cumulative_count(rows, order)


@query(
    "scalar_metrics",
    """SELECT l_orderkey, l_linenumber,
              CASE WHEN l_quantity > 25 THEN 'bulk' ELSE 'single' END AS case_when,
              CASE WHEN l_discount = 0 THEN 'full' ELSE 'cut' END AS if_else,
              l_returnflag LIKE 'A%' AS like_a, l_returnflag ILIKE 'a%' AS ilike_a,
              l_linenumber IN (1, 2) AND NOT l_quantity BETWEEN 10 AND 20 OR l_tax IS NULL AS logic,
              coalesce(NULLIF(l_returnflag, 'N'), 'none') AS coalesced,
              ifnull(NULLIF(l_linestatus, 'O'), 'open') AS if_null,
              round(l_extendedprice / nullif(l_discount, 0), 4) AS safe_quotient,
              CAST(l_quantity AS BIGINT) AS as_int, CAST(l_linenumber AS VARCHAR) AS as_text,
              CAST(l_linenumber AS DOUBLE) AS as_float, CAST(l_linenumber - 1 AS BOOLEAN) AS as_bool,
              TRY_CAST(l_returnflag AS BIGINT) IS NULL AS lenient_cast,
              abs(l_quantity - 25) AS absolute, CAST(floor(l_tax * 50) AS BIGINT) AS floored,
              CAST(ceil(l_tax * 50) AS BIGINT) AS ceiled,
              CASE WHEN NULLIF(l_linenumber, 7) IS NOT NULL THEN greatest(l_linenumber, 3) END AS largest,
              CASE WHEN NULLIF(l_linenumber, 7) IS NOT NULL THEN least(l_linenumber, 3) END AS smallest,
              l_returnflag || '/' || l_linestatus AS joined,
              CAST(CAST(l_shipdate AS DATE) - DATE '1995-01-01' AS INTEGER) AS date_difference,
              NULLIF(regexp_extract(l_returnflag, '[AN]', 0), '') AS extracted,
              CAST(date_trunc('month', l_shipdate) AS DATE) AS month_start,
              CAST(l_shipdate AS DATE) - CAST(dayofweek(l_shipdate) AS INTEGER) AS week_start,
              lower(l_returnflag) AS lowered
       FROM lineitem""",
)
def scalar_metrics(spark, sf_dir):
    from .models import sales

    line = F.nullif("l_linenumber", F.lit(7))
    return rounded(
        sales(spark, sf_dir)
        .withColumns(
            {
                "largest": strict_greatest(line, F.lit(3)),
                "smallest": strict_least(line, F.lit(3)),
                "extracted": extract_or_null(F.col("l_returnflag"), "[AN]"),
                "week_start": truncate_date(F.col("date"), "weekly"),
                "month_start": truncate_date(F.col("date"), "monthly"),
            }
        )
        .selectExpr(
            "l_orderkey",
            "l_linenumber",
            "CASE WHEN l_quantity > 25 THEN 'bulk' ELSE 'single' END AS case_when",
            "if(l_discount = 0, 'full', 'cut') AS if_else",
            "l_returnflag LIKE 'A%' AS like_a",
            "l_returnflag ILIKE 'a%' AS ilike_a",
            "l_linenumber IN (1, 2) AND NOT l_quantity BETWEEN 10 AND 20 OR l_tax IS NULL AS logic",
            "coalesce(nullif(l_returnflag, 'N'), 'none') AS coalesced",
            "ifnull(nullif(l_linestatus, 'O'), 'open') AS if_null",
            "round(try_divide(l_extendedprice, l_discount), 4) AS safe_quotient",
            "cast(l_quantity AS bigint) AS as_int",
            "cast(l_linenumber AS string) AS as_text",
            "cast(l_linenumber AS double) AS as_float",
            "cast(l_linenumber - 1 AS boolean) AS as_bool",
            "try_cast(l_returnflag AS bigint) IS NULL AS lenient_cast",
            "abs(l_quantity - 25) AS absolute",
            "floor(l_tax * 50) AS floored",
            "ceil(l_tax * 50) AS ceiled",
            "largest",
            "smallest",
            "concat(l_returnflag, '/', l_linestatus) AS joined",
            "datediff(date, DATE '1995-01-01') AS date_difference",
            "extracted",
            "month_start",
            "week_start",
            "lower(l_returnflag) AS lowered",
        )
    )
