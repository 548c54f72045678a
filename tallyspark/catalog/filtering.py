"""Queries for filters and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import DATE_PRESETS, preset_table
from ..functions.scalars import dimension_label as label_of
from ..model import Dimension, Filters
from ..operators import filters as ops
from ..operators.aggregates import kpi_totals
from .base import query, rounded, table
from .models import EV, LI, LOG, SALES, SHOP, query_log, sales, sales_wide, shop, volumes_sql


@query(
    "filter_dates",
    """SELECT event_id, CAST(ts AS DATE) AS date, value FROM events
       WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
)
def filter_dates(spark, sf_dir):
    rows = ops.filter_dates(shop(spark, sf_dir), "2024-01-05", "2024-01-20")
    return rows.select("event_id", "date", "value")


@query(
    "clamp_dates",
    """SELECT event_id, CAST(ts AS DATE) AS date FROM events
       WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-25'
         AND CAST(ts AS DATE) >= DATE '2024-01-02'""",
)
def clamp_dates(spark, sf_dir):
    # The end is open: the allowed range still applies.
    rows = ops.filter_dates(shop(spark, sf_dir), "2024-01-02")
    return ops.clamp_dates(rows, "2024-01-08", "2024-01-25").select("event_id", "date")


_D = "as_of"
_MONDAY = f"CAST(date_trunc('week', {_D}) AS DATE)"
_MONTH = f"CAST(date_trunc('month', {_D}) AS DATE)"
_QUARTER = f"CAST(date_trunc('quarter', {_D}) AS DATE)"
_YEAR = f"CAST(date_trunc('year', {_D}) AS DATE)"
_PRESET_SQL = {
    "today": (_D, _D),
    "yesterday": (f"{_D} - 1", f"{_D} - 1"),
    "last_7_days": (f"{_D} - 6", _D),
    "last_14_days": (f"{_D} - 13", _D),
    "last_30_days": (f"{_D} - 29", _D),
    "last_90_days": (f"{_D} - 89", _D),
    "this_week": (_MONDAY, _D),
    "last_week": (f"{_MONDAY} - 7", f"{_MONDAY} - 1"),
    "this_month": (_MONTH, _D),
    "last_month": (f"CAST({_MONTH} - INTERVAL 1 MONTH AS DATE)", f"{_MONTH} - 1"),
    "this_quarter": (_QUARTER, _D),
    "last_quarter": (f"CAST({_QUARTER} - INTERVAL 3 MONTH AS DATE)", f"{_QUARTER} - 1"),
    "this_year": (_YEAR, _D),
    "last_year": (f"CAST({_YEAR} - INTERVAL 1 YEAR AS DATE)", f"{_YEAR} - 1"),
    "year_to_date": (_YEAR, _D),
    "month_to_date": (_MONTH, _D),
    "quarter_to_date": (_QUARTER, _D),
    "week_to_date": (_MONDAY, _D),
}


@query(
    "relative_dates",
    "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS as_of FROM orders) "
    + " UNION ALL ".join(
        f"SELECT as_of, '{p}' AS preset, {_PRESET_SQL[p][0]} AS start_date, {_PRESET_SQL[p][1]} AS end_date FROM d"
        for p in DATE_PRESETS
    ),
)
def relative_dates(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("as_of")).distinct()
    return days.select("as_of", F.inline(preset_table(F.col("as_of"))))


@query(
    "filter_relative_dates",
    f"""WITH {EV} SELECT {volumes_sql("queries", "purchases", "visitors")} FROM ev
        WHERE date BETWEEN DATE '2024-01-22' AND DATE '2024-01-28'""",
)
def filter_relative_dates(spark, sf_dir):
    last_week = Filters(preset="last_week", as_of="2024-01-30")
    return kpi_totals(shop(spark, sf_dir), SHOP, last_week, ["queries", "purchases", "visitors"])


_FLAGGED = """SELECT l_orderkey, l_linenumber, NULLIF(l_returnflag, 'N') AS flag,
                     CASE WHEN l_linestatus = 'O' THEN '' ELSE l_linestatus END AS status
              FROM lineitem"""


@query(
    "filter_dimensions",
    f"""SELECT * FROM ({_FLAGGED})
        WHERE (flag = 'A' OR flag IS NULL) AND (status = 'none' OR status = '') AND l_linenumber IN (1, 2, 3)""",
)
def filter_dimensions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.nullif("l_returnflag", F.lit("N")).alias("flag"),
        F.when(F.col("l_linestatus") == "O", "").otherwise(F.col("l_linestatus")).alias("status"),
    )
    wanted = {
        "flag": ["A", "__NULL__"],
        "status": ["none", "__EMPTY__"],
        "l_linenumber": ["1", "2", "3"],
        "l_orderkey": [],
    }
    return ops.filter_dimensions(rows, wanted)


@query(
    "search_values",
    "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red w')",
)
def search_values(spark, sf_dir):
    return ops.search_values(table(spark, sf_dir, "part"), "p_name", "RED w").select("p_partkey", "p_name")


@query(
    "filter_dimension_tuples",
    f"""WITH {LI} SELECT segment, region, {volumes_sql("quantity", "lines")} FROM li
        WHERE (segment = 'BUILDING' AND region = 'ASIA') OR (segment = 'MACHINERY' AND region = 'MIDDLE EAST')
           OR (segment = 'FURNITURE' AND region = 'EUROPE')
        GROUP BY ALL""",
)
def filter_dimension_tuples(spark, sf_dir):
    wanted = [("BUILDING", "ASIA"), ("MACHINERY", "MIDDLE EAST"), ("FURNITURE", "EUROPE")]
    dims = ["segment", "region"]
    rows = ops.filter_dimension_tuples(sales_wide(spark, sf_dir), dims, wanted)
    volumes = [SALES.metric(m).aggregate() for m in ("quantity", "lines")]
    return rounded(rows.groupBy(*dims).agg(*volumes).orderBy(*dims), 4)


@query(
    "with_calculated_dimensions",
    """SELECT CASE WHEN l_quantity < 15 THEN 'small' WHEN l_quantity < 35 THEN 'medium' ELSE 'large' END AS size_class,
              year(l_shipdate) AS ship_year, count(*) AS lines
       FROM lineitem GROUP BY ALL""",
)
def with_calculated_dimensions(spark, sf_dir):
    year = Dimension("ship_year", "cast(year({l_shipdate}) as bigint)")
    dims = [d for d in SALES.dimensions if d.id == "size_class"] + [year]
    rows = ops.with_calculated_dimensions(sales(spark, sf_dir), dims)
    return rows.groupBy("size_class", "ship_year").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "filter_calculated",
    """SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, 'large' AS size_class FROM lineitem
       WHERE l_returnflag = 'R' AND l_quantity >= 35""",
)
def filter_calculated(spark, sf_dir):
    dims = [d for d in SALES.dimensions if d.id == "size_class"]
    rows = ops.filter_calculated(
        sales(spark, sf_dir), {"l_returnflag": ["R"], "size_class": ["large"]}, dims
    )
    return rows.select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "size_class")


@query(
    "required_columns",
    """SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_linestatus, l_partkey,
              CAST(l_shipdate AS DATE) AS date
       FROM lineitem""",
)
def required_columns(spark, sf_dir):
    return ops.required_columns(sales(spark, sf_dir), SALES, keep=["l_partkey"], metrics=["quantity", "orders"])


@query(
    "dimension_label",
    f"""WITH {EV} SELECT segment, region, coalesce(segment, '__NULL__') || ' - ' || coalesce(r2, '__NULL__') AS label,
               count(*) AS n
        FROM (SELECT segment, region, NULLIF(region, 'ASIA') AS r2 FROM ev) GROUP BY ALL""",
)
def dimension_label(spark, sf_dir):
    from .models import shop_wide

    rows = shop_wide(spark, sf_dir).withColumn("r2", F.nullif("region", F.lit("ASIA")))
    labelled = rows.withColumn("label", label_of(["segment", "r2"]))
    return labelled.groupBy("segment", "region", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "filter_query_log",
    f"""WITH {LOG} SELECT log_id, created_at, query_type, endpoint FROM lg
        WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-20'
          AND query_type = 'click' AND contains(lower(endpoint), '/click/1')
        ORDER BY created_at DESC, log_id LIMIT 25 OFFSET 10""",
)
def filter_query_log(spark, sf_dir):
    found = ops.filter_query_log(
        query_log(spark, sf_dir), "2024-01-03", "2024-01-20", "click", "/CLICK/1", limit=25, offset=10
    )
    return found.select("log_id", "created_at", "query_type", "endpoint")
