"""Labels, keys and null-safe arithmetic."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import LABEL_SEPARATOR, NULL_MARKER

KEY_SEPARATOR = "|"


def safe_divide(numerator: Column, denominator: Column, default: float | None = None) -> Column:
    """Quotient that is ``default`` (NULL unless given) where the denominator is zero or NULL."""
    quotient = F.try_divide(numerator, denominator)
    return quotient if default is None else F.coalesce(quotient, F.lit(default))


def label_value(name: str) -> Column:
    """A dimension value as text, with NULL spelled out."""
    return F.coalesce(F.col(name).cast("string"), F.lit(NULL_MARKER))


def dimension_label(names: Sequence[str]) -> Column:
    """One display label for a row; the dimensions themselves stay the join key."""
    if not names:
        return F.lit("All")
    return F.concat_ws(LABEL_SEPARATOR, *[label_value(n) for n in names])


def composite_key_name(names: Sequence[str]) -> str:
    return "_key_" + "_".join(sorted(n.lower() for n in names))


def composite_key(names: Sequence[str]) -> Column:
    """Text key over several columns; the separator keeps ('ab','c') apart from ('a','bc')."""
    return F.concat_ws(KEY_SEPARATOR, *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names])


def _null_if_any_null(value: Column, inputs: Sequence[Column]) -> Column:
    return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in inputs]), value)


def strict_greatest(*inputs: Column) -> Column:
    """Largest value, NULL as soon as one input is NULL (Spark's own skips NULLs)."""
    return _null_if_any_null(F.greatest(*inputs), inputs)


def strict_least(*inputs: Column) -> Column:
    return _null_if_any_null(F.least(*inputs), inputs)


def extract_or_null(text: Column, pattern: str, group: int = 0) -> Column:
    """Regular-expression match, NULL (not '') when there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def approx_distinct(*inputs: Column, nulls: bool = False) -> Column:
    """Approximate number of distinct values or combinations, about 2 % off, from one sketch per task.

    A combination counts NULL as a value with ``nulls``; otherwise rows with a NULL are left out.
    """
    fingerprint = F.xxhash64(*inputs)
    if not nulls:
        fingerprint = _null_if_any_null(fingerprint, inputs)
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(fingerprint, 12)), F.lit(0))
