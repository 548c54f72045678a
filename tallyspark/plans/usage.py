"""Usage reports over a query log.

Columns of the log: query_type, endpoint, execution_time_ms, bytes_processed, bytes_billed,
is_success, cache_hit, created_at.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import as_date

_UNITS = {"hourly": "hour", "weekly": "week"}


def _in_range(log: DataFrame, start: str | None, end: str | None) -> DataFrame:
    day = F.to_date("created_at")
    if start:
        log = log.filter(day >= as_date(start))
    if end:
        log = log.filter(day <= as_date(end))
    return log


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def _period(log: DataFrame, unit: str) -> Column:
    moment = F.col("created_at")
    if not isinstance(log.schema["created_at"].dataType, T.TimestampNTZType):
        return F.date_trunc(unit, moment)
    # Without a zone: plain calendar arithmetic, which date_trunc would do in the session's zone.
    day = F.to_date(moment)
    begin = (F.trunc(day, "week") if unit == "week" else day).cast("timestamp_ntz")
    return begin + F.make_dt_interval(hours=F.hour(moment)) if unit == "hour" else begin


def usage_stats(log: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Totals of the log in one aggregate; an empty range gives zeros."""
    return _in_range(log, start, end).agg(
        F.count(F.lit(1)).alias("total_queries"),
        _zero(F.sum("bytes_processed")).alias("total_bytes_processed"),
        _zero(F.sum("bytes_billed")).alias("total_bytes_billed"),
        _zero(F.avg("execution_time_ms")).alias("avg_execution_time_ms"),
        _zero(F.try_divide(F.count_if("cache_hit"), F.count(F.lit(1)))).alias("cache_hit_rate"),
        F.count_if(~F.col("is_success")).alias("error_count"),
    )


def usage_today(log: DataFrame, today: str | date | None = None) -> DataFrame:
    """The same for one day."""
    day = str(today or date.today())
    return usage_stats(log, day, day)


def usage_by_type(log: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Number of queries per type."""
    return _in_range(log, start, end).groupBy("query_type").agg(F.count(F.lit(1)).alias("query_count"))


def usage_timeseries(
    log: DataFrame, granularity: str = "daily", start: str | None = None, end: str | None = None
) -> DataFrame:
    """Log activity per hour, day or week (from Monday), in order."""
    period = _period(log, _UNITS.get(granularity, "day"))
    return (
        _in_range(log, start, end)
        .groupBy(period.alias("period"))
        .agg(
            F.count(F.lit(1)).alias("query_count"),
            _zero(F.sum("bytes_processed")).alias("bytes_processed"),
            _zero(F.sum("bytes_billed")).alias("bytes_billed"),
            _zero(F.avg("execution_time_ms")).alias("avg_execution_time_ms"),
        )
        .orderBy("period")
    )


__all__ = ["usage_by_type", "usage_stats", "usage_timeseries", "usage_today"]
