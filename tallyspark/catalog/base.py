"""Registry of the runnable queries: one per operator, each with SQL for a second opinion."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.derived import ECOMMERCE_RATES

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None
    # The operator alone, where ``build`` also holds its result against another.
    timed: Build | None = None


# Digits of the preset rates in both the Spark result and the SQL.
FINE = dict.fromkeys((m.id for m in ECOMMERCE_RATES), 10)

REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query. Without ``sql`` its result is random, approximate or a matter of tests."""

    def register(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Query(name, build, sql)
        return build

    return register


def timed(name: str) -> Callable[[Build], Build]:
    """Name the operator itself of a registered query that also checks its result, for ``bench.py``."""

    def register(build: Build) -> Build:
        REGISTRY[name] = replace(REGISTRY[name], timed=build)
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, fine: Mapping[str, int] | None = None) -> DataFrame:
    """Round floating-point columns, whose last digits depend on the order of addition.

    ``fine`` gives columns their own number of digits, e.g. amounts over counts, which are often
    exact ties at few digits.
    """
    places = FINE if fine is None else fine
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    quoted = {n: F.col(f"`{n}`") for n in df.columns}
    return df.select(*[F.round(c, places.get(n, digits)).alias(n) if n in floats else c for n, c in quoted.items()])
