"""Runnable queries over the test tables, by operator name."""

from . import bucketing, comparing, deriving, filtering, grouping, materialising, scans  # noqa: F401
from .base import REGISTRY, Query

__all__ = ["REGISTRY", "Query"]
