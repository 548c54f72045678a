"""Column functions: dates, labels and keys, safe arithmetic, the normal distribution."""

from .dates import DATE_PRESETS, preset_bounds, preset_table, truncate_date
from .normal import norm_cdf, normal_tail
from .scalars import (
    approx_distinct,
    composite_key,
    composite_key_name,
    dimension_label,
    extract_or_null,
    label_value,
    safe_divide,
    strict_greatest,
    strict_least,
)

__all__ = [
    "DATE_PRESETS",
    "approx_distinct",
    "composite_key",
    "composite_key_name",
    "dimension_label",
    "extract_or_null",
    "label_value",
    "norm_cdf",
    "normal_tail",
    "preset_bounds",
    "preset_table",
    "safe_divide",
    "strict_greatest",
    "strict_least",
    "truncate_date",
]
