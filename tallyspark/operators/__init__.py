"""Operators: every one takes and returns a lazy DataFrame."""

from .aggregates import *  # noqa: F403
from .buckets import (
    bucket_by_condition,
    bucket_by_metric,
    bucket_by_period,
    bucket_column,
    period_column,
    reaggregate_by_bucket,
    rule_column,
)
from .derived import (
    ECOMMERCE_RATES,
    MARKETING_RATES,
    SAAS_RATES,
    baseline_inflation,
    cumulative_count,
    cumulative_share,
    derived_metrics,
    pct_of_total,
)
from .filters import *  # noqa: F403
from .joins import *  # noqa: F403
from .running import running_totals
from .shape import *  # noqa: F403
from .significance import *  # noqa: F403
