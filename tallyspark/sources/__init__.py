"""Scans, lookups, daily tables and export."""

from .facts import column_profile, column_role, fact_scan, inferred_type, preview, table_info
from .lookups import conform_join_key, load_lookup, store_lookup
from .tables import append_dates, export_csv, path_exists, stored_dates, write_daily_table

__all__ = [
    "append_dates",
    "column_profile",
    "column_role",
    "conform_join_key",
    "export_csv",
    "fact_scan",
    "inferred_type",
    "load_lookup",
    "path_exists",
    "preview",
    "store_lookup",
    "stored_dates",
    "table_info",
    "write_daily_table",
]
