"""Queries for rollups, enriched copies, coverage and usage reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import Rollup
from ..operators.aggregates import grouped, kpi_totals, pivot_from_rollup, rollup_totals
from ..operators.derived import baseline_inflation
from ..operators.joins import missing_dates
from ..plans import rollups as jobs
from ..plans import usage
from ..session import scratch_path
from ..sources.tables import stored_dates, write_daily_table
from .base import query, rounded
from .models import EV, FUNNEL, LOG, SHOP, customer_lookup, query_log, shop, shop_wide, volumes_sql

ROLLUP_DIMS = ["date", "segment", "search_term"]
ROLLUP_SQL = f"""WITH {EV} SELECT date, segment, search_term, {volumes_sql(*FUNNEL)} FROM ev GROUP BY ALL"""


def _stored(spark, path, *columns):
    return rounded(spark.read.parquet(path).select(*columns))


@query("build_rollup", ROLLUP_SQL)
def build_rollup(spark, sf_dir):
    path = scratch_path(spark, "rollup")
    lookups = [customer_lookup(spark, sf_dir)]
    jobs.build_rollup(shop(spark, sf_dir), SHOP, ROLLUP_DIMS, path, FUNNEL, lookups)
    return _stored(spark, path, *ROLLUP_DIMS, *FUNNEL)


@query("build_rollup_batched", ROLLUP_SQL)
def build_rollup_batched(spark, sf_dir):
    path = scratch_path(spark, "rollup")
    lookups = [customer_lookup(spark, sf_dir)]
    jobs.build_rollup_batched(shop(spark, sf_dir), SHOP, ROLLUP_DIMS, path, FUNNEL, lookups)
    return _stored(spark, path, *ROLLUP_DIMS, *FUNNEL)


@query("refresh_rollup", ROLLUP_SQL)
def refresh_rollup(spark, sf_dir):
    path = scratch_path(spark, "rollup")
    fact, lookups = shop(spark, sf_dir), [customer_lookup(spark, sf_dir)]
    # The rollup as it stood on 20 January, then brought up to date, then refreshed in vain.
    jobs.build_rollup(fact.filter("date <= DATE '2024-01-20'"), SHOP, ROLLUP_DIMS, path, FUNNEL, lookups)
    jobs.refresh_rollup(fact, SHOP, ROLLUP_DIMS, path, FUNNEL, lookups)
    jobs.refresh_rollup(fact, SHOP, ROLLUP_DIMS, path, FUNNEL, lookups)
    return _stored(spark, path, *ROLLUP_DIMS, *FUNNEL)


@query(
    "refresh_all",
    """WITH d AS (SELECT CAST(ts AS DATE) AS date, event_type, user_id FROM events),
       n AS (SELECT count(DISTINCT date) AS dates FROM d)
       SELECT 'daily_types' AS rollup, true AS success, 'ready' AS status, (SELECT dates FROM n) AS dates_added,
              (SELECT count(*) FROM (SELECT DISTINCT date, event_type FROM d)) AS row_count
       UNION ALL
       SELECT 'daily_users', true, 'ready', (SELECT count(DISTINCT date) FROM d WHERE date > DATE '2024-01-20'),
              (SELECT count(*) FROM (SELECT DISTINCT date, user_id FROM d))""",
)
def refresh_all(spark, sf_dir):
    fact, root = shop(spark, sf_dir), scratch_path(spark, "rollups")
    rollups = {
        "daily_types": (["date", "event_type"], f"{root}/daily_types"),
        "daily_users": (["date", "user_id"], f"{root}/daily_users"),
    }
    # One rollup is missing altogether, the other ends on 20 January.
    jobs.build_rollup(fact.filter("date <= DATE '2024-01-20'"), SHOP, *rollups["daily_users"])
    return jobs.refresh_all(fact, SHOP, rollups).drop("message")


NESTED = {
    "by_type_segment": ["date", "event_type", "segment"],
    "by_type": ["date", "event_type"],
    "by_segment": ["date", "segment"],
    "by_day": ["date"],
    "by_type_ever": ["event_type"],
}


def _nested_sql() -> str:
    parts = []
    for name, dims in NESTED.items():
        cells = [f"{d} AS {d}" if d in dims else f"NULL AS {d}" for d in ("date", "event_type", "segment")]
        parts.append(f"SELECT '{name}' AS rollup, {', '.join(cells)}, {volumes_sql(*FUNNEL)} FROM ev GROUP BY {', '.join(dims)}")
    return f"WITH {EV} " + " UNION ALL ".join(parts)


@query("refresh_nested", _nested_sql())
def refresh_nested(spark, sf_dir):
    """Nested rollups, one missing and the others behind by ten days, of which only the widest reads the fact."""
    fact, root = shop(spark, sf_dir), scratch_path(spark, "nested")
    lookups = [customer_lookup(spark, sf_dir, unique=True)]
    rollups = {name: (dims, f"{root}/{name}") for name, dims in NESTED.items()}
    early = {n: r for n, r in rollups.items() if n not in ("by_day", "by_type_ever")}
    jobs.refresh_all(fact.filter("date <= DATE '2024-01-20'"), SHOP, early, lookups, metrics=FUNNEL)
    jobs.refresh_all(fact, SHOP, rollups, lookups, metrics=FUNNEL)
    stored = None
    for name, (dims, path) in rollups.items():
        own = spark.read.parquet(path)
        cells = [F.col(d) if d in dims else F.lit(None).cast("date" if d == "date" else "string").alias(d) for d in ("date", "event_type", "segment")]
        own = own.select(F.lit(name).alias("rollup"), *cells, *FUNNEL)
        stored = own if stored is None else stored.unionByName(own)
    return rounded(stored)


# A merged distinct count is within this share of the exact one: four standard errors of a sketch and more.
SKETCH_ERROR = 0.035


def _sketched(spark, sf_dir):
    """A daily rollup by segment with sketches of the visitors."""
    path = scratch_path(spark, "sketched")
    metrics, lookups = ["queries", "visitors"], [customer_lookup(spark, sf_dir, unique=True)]
    jobs.build_rollup(shop(spark, sf_dir), SHOP, ["date", "segment"], path, metrics, lookups, sketches=True)
    return spark.read.parquet(path)


@query(
    "pivot_from_sketches",
    f"WITH {EV} SELECT segment, {volumes_sql('queries', 'visitors')}, true AS merged_within_error FROM ev GROUP BY 1",
)
def pivot_from_sketches(spark, sf_dir):
    """Distinct visitors by segment, merged from 30 daily sketches, beside the exact count."""
    merged = pivot_from_rollup(_sketched(spark, sf_dir), SHOP, ["segment"], ["queries", "visitors"], limit=1000)
    merged = merged.select("segment", "queries", F.col("visitors").alias("merged"))
    exact = grouped(shop_wide(spark, sf_dir), SHOP, ["segment"], None, ["visitors"]).withColumnRenamed("segment", "of")
    both = merged.join(exact, F.col("segment").eqNullSafe(F.col("of")))
    within = F.abs(F.col("merged") - F.col("visitors")) <= SKETCH_ERROR * F.col("visitors") + 0.5
    return both.select("segment", "queries", "visitors", within.alias("merged_within_error"))


@query(
    "daily_from_sketches",
    f"WITH {EV} SELECT date, segment, {volumes_sql('queries', 'visitors')} FROM ev GROUP BY ALL",
)
def daily_from_sketches(spark, sf_dir):
    """At the rollup's own grain, where nothing is merged, counts are the exact ones."""
    merged = pivot_from_rollup(_sketched(spark, sf_dir), SHOP, ["date", "segment"], ["queries", "visitors"], limit=10**6)
    return merged.select("date", "segment", "queries", "visitors")


@query(
    "baseline_inflation_merged",
    f"WITH {EV} SELECT 'visitors' AS metric, {volumes_sql('visitors').removesuffix(' AS visitors')} AS exact, true AS sums_inflate, false AS sketches_inflate FROM ev",
)
def baseline_inflation_merged(spark, sf_dir):
    """Summed daily counts overstate the visitors; those merged by sketch do not."""
    stored = _sketched(spark, sf_dir)
    fact = shop(spark, sf_dir)
    exact = kpi_totals(fact, SHOP, metrics=["visitors"])
    plain = baseline_inflation(stored.select("visitors"), exact, ["visitors"], SKETCH_ERROR)
    sketched = baseline_inflation(rollup_totals(stored, SHOP, ["visitors"]), exact, ["visitors"], SKETCH_ERROR)
    rows = plain.select("metric", F.col("baseline").cast("bigint").alias("exact"), F.col("is_inflated").alias("sums_inflate"))
    return rows.join(sketched.select("metric", F.col("is_inflated").alias("sketches_inflate")), "metric")


@query(
    "missing_dates_stored",
    """SELECT DISTINCT CAST(ts AS DATE) AS date FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-20'""",
)
def missing_dates_stored(spark, sf_dir):
    """Dates that a daily table lacks, its own read off its partitions."""
    fact, path = shop(spark, sf_dir), scratch_path(spark, "daily")
    jobs.build_rollup(fact.filter("date <= DATE '2024-01-20'"), SHOP, ["date", "event_type"], path, FUNNEL)
    return missing_dates(fact, stored_dates(spark, path))


@query(
    "staleness",
    """SELECT true AS is_stale, true AS target_exists, max(CAST(ts AS DATE)) AS source_max,
              DATE '2024-01-20' AS target_max,
              count(DISTINCT CAST(ts AS DATE)) FILTER (WHERE CAST(ts AS DATE) > DATE '2024-01-20') AS missing_dates,
              '_key_event_type_user_id' AS missing_keys
       FROM events""",
)
def staleness(spark, sf_dir):
    fact = shop(spark, sf_dir)
    path = scratch_path(spark, "copy")
    write_daily_table(fact.filter("date <= DATE '2024-01-20'"), path)
    return jobs.staleness(fact, spark.read.parquet(path), keys=[["user_id", "event_type"]])


ENRICHED_SQL = f"""WITH {EV}, p AS (SELECT event_id, props FROM events)
    SELECT date, event_type, user_id, value, props,
           event_type || '|' || CAST(user_id AS VARCHAR) AS _key_event_type_user_id, segment, nation, region
    FROM ev JOIN p USING (event_id)"""
ENRICHED_COLUMNS = (
    "date",
    "event_type",
    "user_id",
    "value",
    "props",
    "_key_event_type_user_id",
    "segment",
    "nation",
    "region",
)


@query("build_enriched_source", ENRICHED_SQL)
def build_enriched_source(spark, sf_dir):
    path = scratch_path(spark, "enriched")
    jobs.build_enriched_source(
        shop(spark, sf_dir),
        SHOP,
        path,
        keys=[["user_id", "event_type"]],
        lookups=[customer_lookup(spark, sf_dir)],
        cluster_by=["user_id", "event_type"],
    )
    return spark.read.parquet(path).select(*ENRICHED_COLUMNS)


@query("refresh_enriched_source", ENRICHED_SQL)
def refresh_enriched_source(spark, sf_dir):
    path = scratch_path(spark, "enriched")
    fact = shop(spark, sf_dir)
    how = {
        "keys": [["user_id", "event_type"]],
        "lookups": [customer_lookup(spark, sf_dir)],
        "cluster_by": ["user_id"],
    }
    jobs.build_enriched_source(fact.filter("date <= DATE '2024-01-12'"), SHOP, path, **how)
    jobs.refresh_enriched_source(fact, SHOP, path, **how)
    return spark.read.parquet(path).select(*ENRICHED_COLUMNS)


# Which dimensions, filters and metrics each kind of logged query uses.
_LOGGED = {
    "view": (["search_term"], [], ["queries"], False),
    "click": (["search_term"], ["segment"], ["queries", "purchases"], False),
    "signup": (["segment"], ["segment"], ["visitors"], True),
    "purchase": (["date", "region"], [], ["purchases"], False),
    "error": (["nation"], ["user_id"], ["queries"], False),
}
_ROLLUPS = (
    Rollup("daily_terms", ["date", "search_term"], ["queries", "purchases"]),
    Rollup("terms", ["search_term"], ["purchases"]),
    Rollup("segment_terms", ["segment", "search_term"], ["queries", "purchases"]),
    Rollup("daily_segments", ["date", "segment"], ["queries", "visitors"]),
    Rollup("daily_regions", ["region", "date"], ["purchases"]),
    Rollup("nations", ["nation", "user_id"], ["queries"], ready=False),
)


def logged_queries(spark, sf_dir):
    """What each entry of the log asked for."""

    def pick(part, cast):
        chain = F
        for kind, spec in _LOGGED.items():
            value = spec[part]
            literal = F.lit(value) if cast == "boolean" else F.array(*map(F.lit, value)).cast(cast)
            chain = chain.when(F.col("query_type") == kind, literal)
        return chain

    return query_log(spark, sf_dir).select(
        F.col("log_id").alias("query_id"),
        pick(0, "array<string>").alias("dimensions"),
        pick(1, "array<string>").alias("filter_dimensions"),
        pick(2, "array<string>").alias("metrics"),
        pick(3, "boolean").alias("distinct_metrics"),
    )


@query(
    "rollup_coverage",
    """SELECT event_id AS query_id,
              CASE event_type WHEN 'view' THEN 'daily_terms' WHEN 'click' THEN 'segment_terms'
                   WHEN 'signup' THEN 'daily_segments' WHEN 'purchase' THEN 'daily_regions' END AS rollup_id,
              CAST(CASE event_type WHEN 'view' THEN 100 WHEN 'click' THEN 150 WHEN 'signup' THEN 80
                   WHEN 'purchase' THEN 150 ELSE -1 END AS INTEGER) AS score,
              event_type IN ('view', 'signup') AS needs_reaggregation
       FROM events""",
)
def rollup_coverage(spark, sf_dir):
    return jobs.rollup_coverage(logged_queries(spark, sf_dir), _ROLLUPS)


def _list_sql(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]::VARCHAR[]"


def _candidates_sql() -> str:
    """The rules over the log's queries and the rollups as lists."""
    asked = ", ".join(
        f"('{k}', {_list_sql(d)}, {_list_sql(f)}, {_list_sql(m)}, {str(u).lower()})" for k, (d, f, m, u) in _LOGGED.items()
    )
    have = ", ".join(f"('{r.id}', {_list_sql(r.dimensions)}, {_list_sql(r.metrics)}, {str(r.ready).lower()})" for r in _ROLLUPS)
    without = "list_sort(list_filter({a}, lambda x: NOT list_contains({b}, x)))"
    extra = "list_sort(list_filter(r.dims, lambda x: NOT list_contains(q.dims || q.filters, x)))"
    return f"""
        WITH q(kind, dims, filters, metrics, uniq) AS (VALUES {asked}), r(id, dims, metrics, ready) AS (VALUES {have}),
        p AS (SELECT q.kind, q.uniq, r.id, r.ready, {without.format(a="q.dims", b="r.dims")} AS a,
                     {without.format(a="q.filters", b="r.dims")} AS b, {without.format(a="q.metrics", b="r.metrics")} AS c,
                     {extra} AS d FROM q, r),
        s AS (SELECT *, ready AND len(a) + len(b) + len(c) = 0 AND (len(d) = 0 OR d = ['date']) AS ok FROM p)
        SELECT event_id AS query_id, id AS rollup_id,
               CAST(CASE WHEN NOT ok THEN -1 WHEN len(d) = 0 THEN 150 WHEN uniq THEN 80 ELSE 100 END AS INTEGER) AS score,
               ok AS can_use, CASE WHEN ok THEN len(d) > 0 END AS needs_reaggregation,
               CASE WHEN NOT ready THEN 'not ready'
                    WHEN len(a) > 0 THEN 'lacks dimensions: ' || array_to_string(a, ', ')
                    WHEN len(b) > 0 THEN 'lacks filter dimensions: ' || array_to_string(b, ', ')
                    WHEN len(c) > 0 THEN 'lacks metrics: ' || array_to_string(c, ', ')
                    WHEN NOT ok THEN 'has further dimensions: ' || array_to_string(d, ', ')
                    WHEN len(d) = 0 THEN 'fits'
                    WHEN uniq THEN 'usable over dates, distinct counts may be too high' ELSE 'usable over dates' END AS reason
        FROM events JOIN s ON event_type = kind"""


@query("rollup_candidates", _candidates_sql())
def rollup_candidates(spark, sf_dir):
    return jobs.rollup_candidates(logged_queries(spark, sf_dir), _ROLLUPS)


@query(
    "rollup_recommendations",
    """SELECT CASE event_type WHEN 'signup' THEN 'segment' ELSE 'nation' END AS dimensions,
              CASE event_type WHEN 'signup' THEN 'rollup_segment' ELSE 'rollup_nation' END AS suggested_id,
              count(*) AS query_count
       FROM events WHERE event_type IN ('signup', 'error') GROUP BY ALL""",
)
def rollup_recommendations(spark, sf_dir):
    return jobs.rollup_recommendations(logged_queries(spark, sf_dir), _ROLLUPS)


_USAGE = """count(*) AS {n}, coalesce(sum(bytes_processed), 0)::BIGINT AS {p},
            coalesce(sum(bytes_billed), 0)::BIGINT AS {b},
            round(coalesce(avg(execution_time_ms), 0), 6) AS avg_execution_time_ms"""
_STATS = _USAGE.format(n="total_queries", p="total_bytes_processed", b="total_bytes_billed") + """,
            round(count(*) FILTER (WHERE cache_hit) / nullif(count(*), 0), 6) AS cache_hit_rate,
            count(*) FILTER (WHERE NOT is_success) AS error_count"""


@query(
    "usage_stats",
    f"WITH {LOG} SELECT {_STATS} FROM lg WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-28'",
)
def usage_stats(spark, sf_dir):
    return rounded(usage.usage_stats(query_log(spark, sf_dir), "2024-01-02", "2024-01-28"))


@query("usage_today", f"WITH {LOG} SELECT {_STATS} FROM lg WHERE CAST(created_at AS DATE) = DATE '2024-01-30'")
def usage_today(spark, sf_dir):
    return rounded(usage.usage_today(query_log(spark, sf_dir), "2024-01-30"))


@query("usage_by_type", f"WITH {LOG} SELECT query_type, count(*) AS query_count FROM lg GROUP BY 1")
def usage_by_type(spark, sf_dir):
    return usage.usage_by_type(query_log(spark, sf_dir))


def _series_sql(unit: str) -> str:
    sums = _USAGE.format(n="query_count", p="bytes_processed", b="bytes_billed")
    return f"WITH {LOG} SELECT CAST(date_trunc('{unit}', created_at) AS TIMESTAMP) AS period, {sums} FROM lg GROUP BY 1"


@query("usage_timeseries", _series_sql("hour"))
def usage_timeseries(spark, sf_dir):
    return rounded(usage.usage_timeseries(query_log(spark, sf_dir), "hourly"))


@query("usage_timeseries_weekly", _series_sql("week"))
def usage_timeseries_weekly(spark, sf_dir):
    return rounded(usage.usage_timeseries(query_log(spark, sf_dir), "weekly"))
