"""Daily partitioned tables and CSV export."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession


def _laid_out(
    df: DataFrame, date_column: str, cluster_by: Sequence[str], exchange: bool = True
) -> DataFrame:
    """Rows of one day together, sorted by the cluster columns.

    REBALANCE lets adaptive execution cut a large day into several tasks of advisory size and pack
    small days into one, so no day, however large, has to pass through a single writer.
    """
    cluster = [c for c in cluster_by if c != date_column]
    if not exchange:
        order = [c for c in [date_column, *cluster] if c in df.columns]
        return df.sortWithinPartitions(*order) if order else df
    if date_column not in df.columns:
        return df.hint("rebalance").sortWithinPartitions(*cluster) if cluster else df.hint("rebalance")
    return df.hint("rebalance", date_column).sortWithinPartitions(date_column, *cluster)


def write_daily_table(
    df: DataFrame,
    path: str,
    cluster_by: Sequence[str] = (),
    date_column: str = "date",
    exchange: bool = True,
) -> None:
    """Create or replace a table, partitioned by date and sorted by the cluster columns.

    ``exchange=False`` skips the shuffle for rows that already arrive by date, as from a daily
    partitioned fact.
    """
    writer = _laid_out(df, date_column, cluster_by, exchange).write.mode("overwrite")
    # Replace the whole table, whatever the session's overwrite mode is.
    writer = writer.option("partitionOverwriteMode", "static")
    if date_column in df.columns:
        writer = writer.partitionBy(date_column)
    writer.parquet(path)


def append_dates(
    df: DataFrame,
    path: str,
    cluster_by: Sequence[str] = (),
    date_column: str = "date",
    exchange: bool = True,
) -> None:
    """Add whole dates to a daily table.

    Only the dates present in ``df`` are written, each replaced as a whole, so a repeated or retried
    run leaves the same table.
    """
    (
        _laid_out(df, date_column, cluster_by, exchange)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(date_column)
        .parquet(path)
    )


def export_csv(df: DataFrame, path: str) -> None:
    """Write a result as CSV with a header, one file per task."""
    df.write.mode("overwrite").option("header", True).csv(path)


def stored_dates(spark: SparkSession, path: str, date_column: str = "date") -> list[date] | None:
    """The dates of a daily table from the names of its partitions: no file is opened, whatever the size of the table.

    Dates of empty folders do not count, nor does the folder of rows without a date. None if the table is not there or is not
    partitioned by date at its top level: then only its rows can tell.
    """
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    found, prefix = [], f"{date_column}="
    for entry in fs.listStatus(root):
        name = entry.getPath().getName()
        if name.startswith(("_", ".")):
            continue
        if not entry.isDirectory() or not name.startswith(prefix):
            return None
        try:
            day = date.fromisoformat(unquote(name[len(prefix) :]))
        except ValueError:
            continue  # rows without a date
        if any(not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(entry.getPath())):
            found.append(day)
    return sorted(found)


def path_exists(df_or_spark, path: str) -> bool:
    """Does a table exist at this path (any Hadoop file system)?"""
    spark = df_or_spark.sparkSession if isinstance(df_or_spark, DataFrame) else df_or_spark
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(target))


__all__ = ["append_dates", "export_csv", "path_exists", "stored_dates", "write_daily_table"]
