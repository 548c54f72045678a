"""Relative date presets and date truncation as Spark columns.

Bounds are columns, so the reference day may be a literal (folded by Catalyst and pushed to the
scan as plain dates) or a column of the data.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# The preset names.
DATE_PRESETS = (
    "today",
    "yesterday",
    "last_7_days",
    "last_14_days",
    "last_30_days",
    "last_90_days",
    "this_week",
    "last_week",
    "this_month",
    "last_month",
    "this_quarter",
    "last_quarter",
    "this_year",
    "last_year",
    "year_to_date",
    "month_to_date",
    "quarter_to_date",
    "week_to_date",
)

_UNIT_MONTHS = {"month": 1, "quarter": 3, "year": 12}


def as_date(value: str | date | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("date")


def preset_bounds(preset: str, as_of: str | date | Column) -> tuple[Column, Column]:
    """Inclusive (first day, last day) of a preset as seen from ``as_of``; weeks start on Monday."""
    if preset not in DATE_PRESETS:
        raise ValueError(f"unknown date preset: {preset}")
    day = as_date(as_of)
    if preset == "today":
        return day, day
    if preset == "yesterday":
        return F.date_sub(day, 1), F.date_sub(day, 1)
    head, _, tail = preset.partition("_")
    if tail.endswith("_days"):
        return F.date_sub(day, int(tail.removesuffix("_days")) - 1), day
    if tail == "to_date":
        return F.trunc(day, head), day
    begin = F.trunc(day, tail)
    if head == "this":
        return begin, day
    # The whole calendar unit before the current one.
    before = F.date_sub(begin, 7) if tail == "week" else F.add_months(begin, -_UNIT_MONTHS[tail])
    return before, F.date_sub(begin, 1)


def preset_table(as_of: Column) -> Column:
    """Every preset for one day, as an array of (preset, start_date, end_date) to explode."""
    rows = []
    for name in DATE_PRESETS:
        start, end = preset_bounds(name, as_of)
        rows.append(F.struct(F.lit(name).alias("preset"), start.alias("start_date"), end.alias("end_date")))
    return F.array(*rows)


def truncate_date(day: Column, granularity: str, week_start: str = "sunday") -> Column:
    """First day of the day, week or month; any other granularity means the day itself."""
    if granularity == "weekly":
        if week_start == "monday":
            return F.trunc(day, "week")
        return F.date_sub(day, F.dayofweek(day) - 1)
    if granularity == "monthly":
        return F.trunc(day, "month")
    return day
