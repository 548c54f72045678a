"""Queries for joins, comparison of columns, layout and significance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.normal import FRACTION_TERMS, HART_DENOMINATOR, HART_NUMERATOR, HART_SWITCH, SQRT_2_PI, Z_975, norm_cdf
from ..model import Filters, Lookup, SemanticModel, sql_volume, volume
from ..operators import joins, shape
from ..operators import significance as tests
from ..operators.aggregates import grouped
from ..operators.aggregates import page as paged
from ..session import durable, scratch_path
from ..sources import store_lookup
from .base import query, rounded, table, timed
from .models import (
    EV,
    LI,
    SALES,
    SEGMENT_VALUES,
    SEGMENTS,
    SHOP,
    customer_lookup,
    query_log,
    rates_sql,
    sales,
    sales_wide,
    shop,
    shop_wide,
    volumes_sql,
)

CONTROL, TREATMENTS = SEGMENTS[0], SEGMENTS[1:]


# ---- joins ------------------------------------------------------------------------------------


@query(
    "join_dimensions",
    f"WITH {EV} SELECT event_id, user_id, segment, nation, region FROM ev",
)
def join_dimensions(spark, sf_dir):
    joined = joins.join_dimensions(shop(spark, sf_dir), [customer_lookup(spark, sf_dir)])
    return joined.select("event_id", "user_id", "segment", "nation", "region")


@query(
    "join_stored_lookup",
    f"WITH {EV} SELECT event_id, user_id, segment, nation, region FROM ev",
)
def join_stored_lookup(spark, sf_dir):
    """A lookup that is de-duplicated and stored once, then joined as unique."""
    stored = store_lookup(customer_lookup(spark, sf_dir), scratch_path(spark, "customers"))
    joined = joins.join_dimensions_dedup(shop(spark, sf_dir), [stored])
    return joined.select("event_id", "user_id", "segment", "nation", "region")


@query(
    "join_dimensions_duplicates",
    """SELECT e.event_id, s.s_suppkey AS supplier FROM events e JOIN customer c ON e.user_id = c.c_custkey
       LEFT JOIN supplier s ON c.c_nationkey = s.s_nationkey""",
)
def join_dimensions_duplicates(spark, sf_dir):
    fact = joins.join_dimensions_dedup(
        shop(spark, sf_dir),
        [Lookup(table(spark, sf_dir, "customer"), "c_custkey", "user_id", {"nationkey": "c_nationkey"})],
    )
    suppliers = Lookup(table(spark, sf_dir, "supplier"), "s_nationkey", "nationkey", {"supplier": "s_suppkey"})
    fact = fact.select("event_id", "nationkey")  # what the blocks of a clustered join hold is not pruned
    joined = joins.join_dimensions(fact, [suppliers], allow_duplicates=True, find_hot=True, cluster=True)
    return joined.select("event_id", "supplier")


@query(
    "join_dimensions_dedup",
    """WITH s AS (SELECT s_nationkey, min(s_name) AS supplier, min(s_acctbal) AS balance FROM supplier GROUP BY 1)
       SELECT c_custkey, supplier, balance FROM customer LEFT JOIN s ON c_nationkey = s_nationkey""",
)
def join_dimensions_dedup(spark, sf_dir):
    columns = {"supplier": "s_name", "balance": "s_acctbal"}
    suppliers = Lookup(table(spark, sf_dir, "supplier"), "s_nationkey", "c_nationkey", columns)
    joined = joins.join_dimensions_dedup(table(spark, sf_dir, "customer"), [suppliers])
    return joined.select("c_custkey", "supplier", "balance")


@query(
    "join_dimensions_salted",
    f"WITH {LI} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, priority FROM li",
)
def join_dimensions_salted(spark, sf_dir):
    orders = Lookup(table(spark, sf_dir, "orders"), "o_orderkey", "l_orderkey", {"priority": "o_orderpriority"})
    fact = sales(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return joins.join_dimensions_dedup(fact, [orders], salts=4)


@query(
    "join_dimensions_hot",
    """SELECT event_id, user_id, k AS key, t.label FROM
       (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS k FROM events)
       LEFT JOIN (SELECT c_custkey, c_name AS label FROM customer) t ON k = c_custkey""",
)
def join_dimensions_hot(spark, sf_dir):
    """A third of the rows on one key, which is found and spread."""
    lookup = Lookup(table(spark, sf_dir, "customer"), "c_custkey", "key", {"label": "c_name"}, unique=True)
    key = F.when(F.col("event_id") % 3 == 0, 1).otherwise(F.col("user_id")).cast("bigint")
    fact = table(spark, sf_dir, "events").select("event_id", "user_id", key.alias("key"))
    return joins.join_dimensions_dedup(fact, [lookup], find_hot=True)


@query(
    "missing_dates",
    """SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders
       WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_returnflag = 'R')""",
)
def missing_dates(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))
    return joins.missing_dates(orders, sales(spark, sf_dir).filter("l_returnflag = 'R'"))


@query(
    "match_primary_rows",
    f"""WITH {EV}, g AS (SELECT search_term, segment, {volumes_sql("queries", "purchases")} FROM ev GROUP BY ALL),
        top AS (SELECT search_term FROM g WHERE segment = 'BUILDING' ORDER BY queries DESC, search_term LIMIT 15)
        SELECT * FROM g WHERE search_term IN (SELECT search_term FROM top)""",
)
def match_primary_rows(spark, sf_dir):
    # Both sides come from the same cells: stored once, the fact is scanned once.
    dims, metrics = ["search_term", "segment"], ["queries", "purchases"]
    cells = durable(grouped(shop_wide(spark, sf_dir), SHOP, dims, None, metrics))
    primary = cells.filter(F.col("segment") == "BUILDING")
    return joins.match_primary_rows(cells, primary, ["search_term"], "queries", limit=15)


@query(
    "column_combinations",
    f"""WITH {EV}, a AS (SELECT DISTINCT segment FROM ev), b AS (SELECT DISTINCT region FROM ev),
        c AS (SELECT DISTINCT event_type FROM ev)
        SELECT segment, region, event_type, segment || ' - ' || region || ' - ' || event_type AS label
        FROM a CROSS JOIN b CROSS JOIN c""",
)
def column_combinations(spark, sf_dir):
    return joins.column_combinations(shop_wide(spark, sf_dir), SHOP, ["segment", "region", "event_type"])


@query(
    "observed_combinations",
    f"""WITH {EV} SELECT DISTINCT segment, region, event_type, segment || ' - ' || region || ' - ' || event_type AS label
        FROM ev""",
)
def observed_combinations(spark, sf_dir):
    return joins.observed_combinations(shop_wide(spark, sf_dir), SHOP, ["segment", "region", "event_type"])


def _wide_sql(metrics: tuple[str, ...], values: tuple[str, ...] = SEGMENT_VALUES) -> str:
    return ", ".join(
        f"max(CASE WHEN segment = '{v}' THEN {m} END) AS \"{v}__{m}\"" for m in metrics for v in values
    )


def _differences_sql(metrics: tuple[str, ...]) -> str:
    parts = []
    for m in metrics:
        c = f'"{SEGMENT_VALUES[0]}__{m}"'
        for s in SEGMENT_VALUES[1:]:
            v = f'"{s}__{m}"'
            parts.append(f'round(coalesce({v}, 0) - coalesce({c}, 0), 6) AS "{s}__{m}_diff"')
            parts.append(
                f"round(CASE WHEN coalesce({c}, 0) <> 0 THEN (coalesce({v}, 0) / {c} - 1) * 100 END, 6) "
                f'AS "{s}__{m}_pct_diff"'
            )
    return ", ".join(parts)


_COMPARED = ("queries", "gross_purchase", "ctr")


def _compare_sql(tail: str = "") -> str:
    shown = ", ".join(f'round("{v}__{m}", 6) AS "{v}__{m}"' for m in _COMPARED for v in SEGMENT_VALUES)
    return f"""WITH {EV}, g AS (
            SELECT search_term, segment, {volumes_sql("queries", "queries_pdp", "gross_purchase")} FROM ev GROUP BY ALL),
        r AS (SELECT *, queries_pdp / nullif(queries, 0) AS ctr FROM g),
        w AS (SELECT search_term, {_wide_sql(_COMPARED)} FROM r GROUP BY 1)
        SELECT search_term, {shown}, {_differences_sql(_COMPARED)} FROM w {tail}"""


@query("compare_columns", _compare_sql())
def compare_columns(spark, sf_dir):
    compared = joins.compare_columns(
        shop_wide(spark, sf_dir), SHOP, ["search_term"], SEGMENTS, list(_COMPARED)
    )
    return rounded(compared)


@query(
    "compare_top_rows",
    _compare_sql('WHERE "BUILDING__queries" IS NOT NULL ORDER BY "BUILDING__queries" DESC, search_term LIMIT 20'),
)
def compare_top_rows(spark, sf_dir):
    compared = joins.compare_columns(
        shop_wide(spark, sf_dir), SHOP, ["search_term"], SEGMENTS, list(_COMPARED), top_rows=20
    )
    return rounded(compared)


_FREE = SemanticModel(
    metrics=(
        sql_volume("buyers_per_value", "count(DISTINCT {user_id}) / sum({value})"),
        volume("users", "count_distinct", "{user_id}"),
        volume("mean_value", "avg", "{value}"),
    ),
    dimensions=SHOP.dimensions,
)
_FREE_METRICS = ("buyers_per_value", "users", "mean_value")
_FREE_SQL = """count(DISTINCT user_id) / sum(value) AS buyers_per_value, count(DISTINCT user_id) AS users,
               avg(value) AS mean_value"""


@query(
    "compare_free_metrics",
    f"""WITH {EV}, r AS (SELECT search_term, segment, {_FREE_SQL} FROM ev GROUP BY ALL),
        w AS (SELECT search_term, {_wide_sql(_FREE_METRICS)} FROM r GROUP BY 1)
        SELECT search_term, {", ".join(f'round("{v}__{m}", 6) AS "{v}__{m}"' if m != "users" else f'"{v}__{m}"'
                                       for m in _FREE_METRICS for v in SEGMENT_VALUES)},
               {_differences_sql(_FREE_METRICS)} FROM w""",
)
def compare_free_metrics(spark, sf_dir):
    """Any aggregate expression, an average and distinct counts per compared column."""
    compared = joins.compare_columns(shop_wide(spark, sf_dir), _FREE, ["search_term"], SEGMENTS, list(_FREE_METRICS))
    return rounded(compared)


@query(
    "compare_rows",
    f"""WITH {EV}, g AS (
            SELECT search_term, segment, {volumes_sql("queries", "queries_pdp", "gross_purchase")} FROM ev GROUP BY ALL),
        r AS (SELECT *, queries_pdp / nullif(queries, 0) AS ctr FROM g),
        c AS (SELECT search_term, {", ".join(f"{m} AS c_{m}" for m in _COMPARED)} FROM r WHERE segment = '{SEGMENT_VALUES[0]}')
        SELECT search_term, segment, {", ".join(
            f"round({m}, 6) AS {m}, round(coalesce({m}, 0) - coalesce(c_{m}, 0), 6) AS {m}_diff, "
            f"round(CASE WHEN coalesce(c_{m}, 0) <> 0 THEN (coalesce({m}, 0) / c_{m} - 1) * 100 END, 6) AS {m}_pct_diff"
            for m in _COMPARED)}
        FROM r LEFT JOIN c USING (search_term)""",
)
def compare_rows(spark, sf_dir):
    compared = joins.compare_rows(shop_wide(spark, sf_dir), SHOP, ["search_term"], SEGMENTS, list(_COMPARED))
    return rounded(compared, fine={})


@query(
    "joined_dimension_values",
    "SELECT DISTINCT n_name AS value FROM nation WHERE contains(lower(n_name), 'n_1') ORDER BY 1 LIMIT 8",
)
def joined_dimension_values(spark, sf_dir):
    return joins.joined_dimension_values(customer_lookup(spark, sf_dir), "nation", "N_1", limit=8)


# ---- layout -----------------------------------------------------------------------------------


@query(
    "page",
    f"""WITH {LI} SELECT segment, nation, {volumes_sql("lines", "quantity")} FROM li GROUP BY ALL
        ORDER BY lines DESC, segment, nation LIMIT 15 OFFSET 30""",
)
def page(spark, sf_dir):
    rows = grouped(sales_wide(spark, sf_dir), SALES, ["segment", "nation"], None, ["lines", "quantity"])
    return rounded(paged(rows, "lines", ["segment", "nation"], 15, 30), 4)


@query(
    "sort_rows",
    f"""WITH {EV}, g AS (SELECT search_term, segment, {volumes_sql("purchases")} FROM ev GROUP BY ALL),
        w AS (SELECT search_term, {_wide_sql(("purchases",), ("BUILDING", "MACHINERY"))} FROM g GROUP BY 1),
        d AS (SELECT *, CASE WHEN coalesce("BUILDING__purchases", 0) <> 0
                  THEN (coalesce("MACHINERY__purchases", 0) / "BUILDING__purchases" - 1) * 100 END AS key FROM w)
        SELECT search_term, "BUILDING__purchases", "MACHINERY__purchases" FROM d
        ORDER BY key DESC NULLS LAST, search_term""",
)
def sort_rows(spark, sf_dir):
    pair = [s for s in SEGMENTS if s.label in ("BUILDING", "MACHINERY")]
    compared = joins.compare_columns(shop_wide(spark, sf_dir), SHOP, ["search_term"], pair, ["purchases"])
    ordered = shape.sort_rows(
        compared, "purchases", ["search_term"], column="MACHINERY", control="BUILDING", by="pct_diff"
    )
    return ordered.select("search_term", "BUILDING__purchases", "MACHINERY__purchases")


@query(
    "order_columns",
    f"""WITH {EV}, g AS (SELECT segment, {volumes_sql("queries")} FROM ev GROUP BY 1)
        SELECT segment, segment AS label, queries AS total,
               row_number() OVER (ORDER BY queries DESC, segment) AS position FROM g""",
)
def order_columns(spark, sf_dir):
    return shape.order_columns(shop_wide(spark, sf_dir), SHOP, ["segment"], "queries")


@query(
    "sort_by_label",
    f"""WITH {EV} SELECT segment, region, segment || ' - ' || region AS label, {volumes_sql("queries")}
        FROM ev GROUP BY ALL ORDER BY label DESC""",
)
def sort_by_label(spark, sf_dir):
    rows = grouped(shop_wide(spark, sf_dir), SHOP, ["segment", "region"], None, ["queries"])
    return shape.sort_by_label(rows, ["segment", "region"], ascending=False)


def _chart_sql() -> str:
    series = ", ".join(
        f"coalesce(round(max(CASE WHEN segment = '{v}' THEN {m} END), 6), 0) AS \"{v}_{m}\""
        for v in SEGMENT_VALUES
        for m in ("purchases", "conversion_rate")
    )
    return f"""WITH {EV}, g AS (SELECT nation, segment, {volumes_sql("queries", "purchases")} FROM ev GROUP BY ALL),
        r AS (SELECT *, purchases / nullif(queries, 0) AS conversion_rate FROM g)
        SELECT nation, {series} FROM r GROUP BY 1"""


@query("chart_series", _chart_sql())
def chart_series(spark, sf_dir):
    metrics = ["purchases", "conversion_rate"]
    return rounded(shape.chart_series(shop_wide(spark, sf_dir), SHOP, "nation", SEGMENTS, metrics))


@query(
    "chart_single",
    f"""WITH {EV}, g AS (SELECT search_term, {volumes_sql("queries", "purchases")} FROM ev GROUP BY ALL)
        SELECT search_term, queries, coalesce({rates_sql("conversion_rate").split(" AS ")[0]}, 0) AS conversion_rate
        FROM g ORDER BY queries DESC, search_term LIMIT 20""",
)
def chart_single(spark, sf_dir):
    return rounded(shape.chart_series(shop(spark, sf_dir), SHOP, "search_term", [], ["queries", "conversion_rate"]))


@query(
    "merge_small_rows",
    f"""WITH {EV}, g AS (SELECT search_term, {volumes_sql("queries", "purchases")} FROM ev GROUP BY 1)
        SELECT CASE WHEN queries < 20 THEN 'Other' ELSE search_term END AS search_term,
               sum(queries)::BIGINT AS queries, sum(purchases)::BIGINT AS purchases FROM g GROUP BY 1""",
)
def merge_small_rows(spark, sf_dir):
    rows = grouped(shop(spark, sf_dir), SHOP, ["search_term"], None, ["queries", "purchases"])
    return shape.merge_small_rows(rows, "search_term", "queries", 20, ["queries", "purchases"])


@query(
    "stack_columns",
    f"""WITH {EV}, g AS (SELECT region, segment, event_type, {volumes_sql("visitors")} FROM ev GROUP BY ALL)
        SELECT *, segment || ' - ' || event_type AS combination,
               region || ' - ' || segment || ' - ' || event_type AS label FROM g""",
)
def stack_columns(spark, sf_dir):
    return shape.stack_columns(
        shop_wide(spark, sf_dir), SHOP, ["region"], ["segment", "event_type"], None, ["visitors"]
    )


# ---- significance -----------------------------------------------------------------------------


def _horner_sql(coefficients: tuple[float, ...], x: str) -> str:
    text = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r}::DOUBLE)"
    return text


def _cdf_sql(z: str) -> str:
    """The normal integral in SQL."""
    x = f"abs({z})"
    near = f"exp(-{x} * {x} / 2) * {_horner_sql(HART_NUMERATOR, x)} / {_horner_sql(HART_DENOMINATOR, x)}"
    fraction = x
    for k in range(FRACTION_TERMS, 0, -1):
        fraction = f"({x} + {k}::DOUBLE / {fraction})"
    # The fraction only in range: DuckDB evaluates both branches.
    far = f"exp(-{x} * {x} / 2) / ({SQRT_2_PI!r} * greatest({fraction.replace(x, f'greatest({x}, 1.0)')}, 1.0))"
    tail = f"(CASE WHEN {x} < {HART_SWITCH!r} THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END)"


def z_test_sql(source: str, keys: str) -> str:
    """The z-test over a relation with x1, n1, x2, n2, high and the key columns."""
    return f"""
        a AS (SELECT *, n1 > 0 AND n2 > 0 AS usable FROM {source} WHERE n1 <> 0 OR n2 <> 0),
        b AS (SELECT * REPLACE (CASE WHEN usable THEN least(x1, n1) ELSE x1 END AS x1,
                                CASE WHEN usable THEN least(x2, n2) ELSE x2 END AS x2) FROM a),
        c AS (SELECT *, CASE WHEN usable THEN x1 / nullif(n1, 0) ELSE 0 END AS p1,
                     CASE WHEN usable THEN x2 / nullif(n2, 0) ELSE 0 END AS p2,
                     CASE WHEN usable THEN (x1 + x2) / nullif(n1 + n2, 0) ELSE 0 END AS pool FROM b),
        d AS (SELECT *, p2 - p1 AS diff, CASE WHEN usable AND pool > 0 AND pool < 1
                     THEN sqrt(pool * (1 - pool) * (1.0 / n1 + 1.0 / n2)) ELSE 0 END AS se FROM c),
        e AS (SELECT *, CASE WHEN se > 0 THEN diff / nullif(se, 0) ELSE 0 END AS z FROM d),
        f AS (SELECT *, usable AND 2 * {_cdf_sql("(-abs(z))")} < 0.05 AS sig FROM e)
        SELECT {keys}, x1 AS control_successes, n1 AS control_trials, x2 AS treatment_successes,
               n2 AS treatment_trials,
               round(CASE WHEN NOT usable THEN 0.5 WHEN high THEN {_cdf_sql("z")} ELSE {_cdf_sql("(-z)")} END, 6)
                 AS prob_beat_control,
               round(diff - {Z_975!r} * se, 6) AS credible_interval_lower,
               round(diff + {Z_975!r} * se, 6) AS credible_interval_upper,
               round(diff, 6) AS mean_difference,
               round(CASE WHEN p1 > 0 THEN diff / p1 WHEN diff = 0 THEN 0 ELSE 'inf'::DOUBLE END, 6)
                 AS relative_difference,
               sig AS is_significant,
               CASE WHEN NOT sig THEN 'neutral' WHEN high = (diff > 0) THEN 'better' ELSE 'worse' END AS direction,
               round(p1, 6) AS control_mean, round(p2, 6) AS treatment_mean,
               n1 AS n_control_events, n2 AS n_treatment_events,
               CASE WHEN NOT usable THEN '{tests.NO_TRIALS_WARNING}'
                    WHEN least(n1, n2) < {tests.MIN_TRIALS}
                         THEN replace('{tests.FEW_TRIALS_WARNING}', '%d', least(n1, n2)::VARCHAR)
                    WHEN least(x1, x2) < {tests.MIN_SUCCESSES} THEN '{tests.FEW_SUCCESSES_WARNING}'
               END AS warning
        FROM f"""


@query(
    "proportion_test",
    f"""WITH {EV}, u AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase' AND value >= 20) AS x1,
               count(*) FILTER (WHERE event_type = 'purchase') AS n1,
               count(*) FILTER (WHERE event_type = 'view' AND value >= 40) AS x2,
               count(*) FILTER (WHERE event_type = 'view') AS n2, true AS high FROM ev GROUP BY 1),
        {z_test_sql("u", "user_id")}""",
)
def proportion_test(spark, sf_dir):
    bought, seen = F.col("event_type") == "purchase", F.col("event_type") == "view"
    counts = shop(spark, sf_dir).groupBy("user_id").agg(
        F.count_if(bought & (F.col("value") >= 20)).alias("control_successes"),
        F.count_if(bought).alias("control_trials"),
        F.count_if(seen & (F.col("value") >= 40)).alias("treatment_successes"),
        F.count_if(seen).alias("treatment_trials"),
    )
    tested = counts.filter("control_trials <> 0 OR treatment_trials <> 0")
    return rounded(tests.proportion_test(tested))


_PAIRS = (("ctr", "queries_pdp", "queries"), ("conversion_rate", "purchases", "queries"))


def _significance_sql(rows: str = "", where: str = "") -> str:
    row = f"{rows}, " if rows else ""
    group = f"GROUP BY {rows}" if rows else ""
    cells = ", ".join(
        f"count(*) FILTER (WHERE segment = '{s}' AND event_type = '{e}') AS {s}_{m}"
        for s in SEGMENT_VALUES
        for m, e in (("queries", "view"), ("queries_pdp", "click"), ("purchases", "purchase"))
    )
    c = SEGMENT_VALUES[0]
    union = " UNION ALL ".join(
        f"""SELECT {row}'{m}' AS metric_id, '{s}' AS segment, CAST({i} AS INTEGER) AS column_index,
                   {c}_{num} AS x1, {c}_{den} AS n1, {s}_{num} AS x2, {s}_{den} AS n2, true AS high FROM w"""
        for i, s in enumerate(SEGMENT_VALUES[1:], start=1)
        for m, num, den in _PAIRS
    )
    return f"""WITH {EV}, w AS (SELECT {row}{cells} FROM ev {where} {group}), u AS ({union}),
        {z_test_sql("u", f"{row}metric_id, segment, column_index")}"""


@query("segment_significance", _significance_sql(where="WHERE date >= DATE '2024-01-03'"))
def segment_significance(spark, sf_dir):
    filters = Filters(start="2024-01-03")
    return rounded(
        tests.segment_significance(
            shop_wide(spark, sf_dir), SHOP, CONTROL, TREATMENTS, ["ctr", "conversion_rate", "aov"], filters
        )
    )


@query("row_significance", _significance_sql("search_term"))
def row_significance(spark, sf_dir):
    return rounded(
        tests.row_significance(
            shop_wide(spark, sf_dir), SHOP, CONTROL, TREATMENTS, ["ctr", "conversion_rate"], ["search_term"]
        )
    )


def _share_sql() -> str:
    cells = ", ".join(
        f"count(*) FILTER (WHERE segment = '{s}' AND event_type = 'view') AS {s}" for s in SEGMENT_VALUES
    )
    c = SEGMENT_VALUES[0]
    union = " UNION ALL ".join(
        f"""SELECT nation, 'queries_pct' AS metric_id, '{s}' AS segment, CAST({i} AS INTEGER) AS column_index,
                   {c} AS x1, (SELECT sum({c})::BIGINT FROM w) AS n1, {s} AS x2,
                   (SELECT sum({s})::BIGINT FROM w) AS n2, true AS high FROM w"""
        for i, s in enumerate(SEGMENT_VALUES[1:], start=1)
    )
    return f"""WITH {EV}, w AS (SELECT nation, {cells} FROM ev GROUP BY 1), u AS ({union}),
        {z_test_sql("u", "nation, metric_id, segment, column_index")}"""


@query("share_significance", _share_sql())
def share_significance(spark, sf_dir):
    return rounded(
        tests.share_significance(
            shop_wide(spark, sf_dir), SHOP, CONTROL, TREATMENTS, ["queries_pct"], ["nation"]
        )
    )


@query(
    "metric_direction",
    f"""SELECT event_type || '_rate' AS metric, count(*) AS n,
              NOT regexp_matches(event_type, '{"|".join(tests.LOWER_IS_BETTER_KEYWORDS)}') AS higher_is_better
       FROM events GROUP BY 1, 3""",
)
def metric_direction(spark, sf_dir):
    types = query_log(spark, sf_dir).groupBy("query_type").agg(F.count(F.lit(1)).alias("n"))
    return tests.metric_direction(types.select(F.concat("query_type", F.lit("_rate")).alias("metric"), "n"))


_DAILY_METRICS = ("queries", "gross_purchase", "conversion_rate")


def _daily_sql() -> str:
    c = SEGMENT_VALUES[0]
    stats = ", ".join(
        f"count({m}) FILTER (WHERE segment = '{s}') AS {s}_{m}_n, "
        f"avg({m}) FILTER (WHERE segment = '{s}') AS {s}_{m}_avg, "
        f"stddev_samp({m}) FILTER (WHERE segment = '{s}') AS {s}_{m}_std"
        for s in SEGMENT_VALUES
        for m in _DAILY_METRICS
    )
    union = " UNION ALL ".join(
        f"""SELECT '{m}' AS metric_id, '{s}' AS segment, true AS better_high,
                   {c}_{m}_n AS control_n, round({c}_{m}_avg, 6) AS control_avg, round({c}_{m}_std, 6) AS control_std,
                   {s}_{m}_n AS treatment_n, round({s}_{m}_avg, 6) AS treatment_avg,
                   round({s}_{m}_std, 6) AS treatment_std FROM w"""
        for s in SEGMENT_VALUES[1:]
        for m in _DAILY_METRICS
    )
    return f"""WITH {EV}, g AS (SELECT date, segment, {volumes_sql("queries", "purchases", "gross_purchase")}
                               FROM ev GROUP BY ALL),
        r AS (SELECT *, purchases / nullif(queries, 0) AS conversion_rate FROM g),
        w AS (SELECT {stats} FROM r) {union}"""


@query("daily_statistics", _daily_sql())
def daily_statistics(spark, sf_dir):
    return rounded(
        tests.daily_statistics(shop_wide(spark, sf_dir), SHOP, CONTROL, TREATMENTS, list(_DAILY_METRICS))
    )


@query(
    "daily_bayes_test",
    f"""SELECT metric_id, segment, coalesce(control_avg, 0) AS control_mean, coalesce(treatment_avg, 0) AS treatment_mean,
               CASE WHEN least(control_n, treatment_n) < 2 THEN 0 ELSE round(treatment_avg - control_avg, 5) END AS mean_difference,
               least(control_n, treatment_n) AS n_days,
               true AS probability_agrees, true AS interval_agrees FROM ({_daily_sql()})""",
)
def daily_bayes_test(spark, sf_dir):
    """The test's means and days, and whether its draws agree with the posterior in closed form.

    With thirty days that is a normal distribution; fewer days have wider tails, for which more room is given.
    """
    args = (shop_wide(spark, sf_dir), SHOP, CONTROL, TREATMENTS, list(_DAILY_METRICS))
    stats = durable(tests.daily_statistics(*args))
    drawn = tests.daily_bayes_draws(stats).join(stats, ["metric_id", "segment"])
    variance = [F.pow(F.col(f"{s}_std"), 2) / F.col(f"{s}_n") for s in ("control", "treatment")]
    error = F.sqrt(variance[0] + variance[1])
    exact = norm_cdf(F.col("mean_difference") / error)
    exact = F.when(F.col("better_high"), exact).otherwise(1 - exact)
    few = F.col("n_days") < 30
    near = F.abs(F.col("prob_beat_control") - exact) <= F.when(few, 0.05).otherwise(0.02)
    room = F.when(few, 1.0).otherwise(0.15) * error
    ends = [("credible_interval_lower", -Z_975), ("credible_interval_upper", Z_975)]
    inside = [F.abs(F.col(c) - F.col("mean_difference") - z * error) <= room for c, z in ends]
    return drawn.select(
        "metric_id",
        "segment",
        F.round("control_mean", 6).alias("control_mean"),
        F.round("treatment_mean", 6).alias("treatment_mean"),
        F.when(F.col("n_days") < 2, 0.0)
        .otherwise(F.round(F.round("treatment_mean", 6) - F.round("control_mean", 6), 5))
        .alias("mean_difference"),
        "n_days",
        F.when(F.col("n_days") < 2, F.col("prob_beat_control") == 0.5).otherwise(near).alias("probability_agrees"),
        F.when(F.col("n_days") < 2, F.col("credible_interval_lower") == F.col("credible_interval_upper"))
        .otherwise(inside[0] & inside[1])
        .alias("interval_agrees"),
    )


@timed("daily_bayes_test")
def _daily_bayes_test(spark, sf_dir):
    return tests.daily_bayes_test(shop_wide(spark, sf_dir), SHOP, CONTROL, TREATMENTS, list(_DAILY_METRICS))
