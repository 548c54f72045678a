"""Lookup files for joined dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Lookup


def conform_join_key(df: DataFrame, key: str, target: T.DataType | str) -> DataFrame:
    """Cast a lookup key to the type of the dimension it joins; what cannot be cast becomes NULL."""
    wanted = target if isinstance(target, str) else target.simpleString()
    return df.withColumn(key, F.col(key).try_cast(wanted))


def load_lookup(
    spark: SparkSession,
    path: str,
    key: str,
    columns: Sequence[str],
    target: T.DataType | str = "string",
    save_to: str | None = None,
    schema: str | T.StructType | None = None,
) -> DataFrame:
    """Read a CSV lookup, keep the key and the chosen columns, and optionally replace a table with it.

    Without a schema the column types are inferred, which reads the (small) file twice.
    """
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    df = reader.csv(path)
    if key not in df.columns:
        raise ValueError(f"join key column {key!r} not found in file")
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"columns not found in file: {missing}")
    lookup = conform_join_key(df.select(key, *columns), key, target)
    if save_to is None:
        return lookup
    lookup.write.mode("overwrite").parquet(save_to)
    return spark.read.parquet(save_to)


def store_lookup(lookup: Lookup, path: str) -> Lookup:
    """De-duplicate a lookup by key (smallest values), replace a table with it and return it as unique.

    A stored table has a known size: joins broadcast it if it is small and sort-merge it if not, and never
    look for duplicates again.
    """
    rows = lookup.df.filter(F.col(lookup.key).isNotNull()).groupBy(lookup.key)
    sources = [c for c in dict.fromkeys(lookup.columns.values()) if c != lookup.key]
    rows = rows.agg(*[F.min(c).alias(c) for c in sources]) if sources else rows.count().select(lookup.key)
    rows.write.mode("overwrite").parquet(path)
    stored = lookup.df.sparkSession.read.parquet(path)
    return Lookup(stored, lookup.key, lookup.target, lookup.columns, unique=True)
