"""Queries for custom dimensions."""

from __future__ import annotations

from ..model import Bucket, Condition, LabelRule, Period
from ..operators import buckets as ops
from ..operators.aggregates import grouped
from .base import query, rounded
from .models import AS_OF, EV, FUNNEL, SHOP, shop, shop_wide, volumes_sql

# Overlapping on purpose.
BUCKETS = (
    Bucket("high", min=22),
    Bucket("middle", min=18, max=24),
    Bucket("low", max=17),
    Bucket("fifteen", equals=15),
)
_BUCKET_SQL = """CASE WHEN queries = 15 THEN 'fifteen' WHEN queries <= 17 THEN 'low'
                      WHEN queries BETWEEN 18 AND 24 THEN 'middle' WHEN queries >= 22 THEN 'high' ELSE 'Other' END"""
_TERMS = f"t AS (SELECT search_term, {volumes_sql('queries', 'purchases')} FROM ev GROUP BY 1)"


@query("bucket_by_metric", f"WITH {EV}, {_TERMS} SELECT *, {_BUCKET_SQL} AS bucket FROM t")
def bucket_by_metric(spark, sf_dir):
    terms = grouped(shop(spark, sf_dir), SHOP, ["search_term"], None, ["queries", "purchases"])
    return ops.bucket_by_metric(terms, "queries", BUCKETS)


@query(
    "bucket_by_condition",
    f"""WITH {EV}, t AS (SELECT search_term, segment, {volumes_sql(*FUNNEL)} FROM ev GROUP BY ALL),
        b AS (SELECT CASE WHEN queries >= 4 AND queries <> 5 THEN 'busy and rising'
                          WHEN queries BETWEEN 2 AND 5 THEN 'middling'
                          WHEN queries < 1 AND queries IS NOT NULL THEN 'quiet' ELSE 'Other' END AS bucket, * FROM t)
        SELECT bucket, sum(queries)::BIGINT AS queries, sum(queries_pdp)::BIGINT AS queries_pdp,
               sum(queries_a2c)::BIGINT AS queries_a2c, sum(purchases)::BIGINT AS purchases,
               round(sum(gross_purchase), 6) AS gross_purchase
        FROM b GROUP BY 1""",
)
def bucket_by_condition(spark, sf_dir):
    rules = (
        LabelRule("busy and rising", (Condition(">=", 4), Condition("!=", 5))),
        LabelRule("middling", (Condition("between", 2, 5),)),
        LabelRule("quiet", (Condition("<", 1), Condition("is_not_null"))),
        # A comparison without a value is skipped, so this rule can never match.
        LabelRule("unusable", (Condition(">"),)),
    )
    dims = ["search_term", "segment"]
    return rounded(
        ops.bucket_by_condition(shop_wide(spark, sf_dir), SHOP, dims, "queries", rules, metrics=FUNNEL)
    )


@query(
    "bucket_by_period",
    f"""WITH {EV} SELECT CASE WHEN date BETWEEN DATE '2024-01-22' AND DATE '2024-01-28' THEN 'last week'
               WHEN date BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' THEN 'mid January'
               WHEN date BETWEEN DATE '2024-01-01' AND DATE '2024-01-14' THEN 'first half' ELSE 'Other' END AS period,
               {volumes_sql("queries", "purchases", "visitors")}
        FROM ev GROUP BY 1""",
)
def bucket_by_period(spark, sf_dir):
    periods = (
        Period("first half", "2024-01-01", "2024-01-14"),
        Period("mid January", "2024-01-10", "2024-01-20"),
        Period("last week", preset="last_week"),
    )
    labelled = ops.bucket_by_period(shop(spark, sf_dir), periods, as_of=AS_OF)
    return grouped(labelled, SHOP, ["period"], None, ["queries", "purchases", "visitors"])


@query(
    "reaggregate_by_bucket",
    f"""WITH {EV}, {_TERMS}, b AS (SELECT *, {_BUCKET_SQL} AS bucket FROM t)
        SELECT bucket, sum(queries)::BIGINT AS queries, sum(purchases)::BIGINT AS purchases FROM b GROUP BY 1""",
)
def reaggregate_by_bucket(spark, sf_dir):
    terms = grouped(shop(spark, sf_dir), SHOP, ["search_term"], None, ["queries", "purchases"])
    labelled = ops.bucket_by_metric(terms, "queries", BUCKETS)
    return ops.reaggregate_by_bucket(labelled, "bucket", ["queries", "purchases"])
