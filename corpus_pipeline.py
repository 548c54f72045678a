"""A training corpus from raw documents, in stages that are written and read again one after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm.mixing import mix_sources
from tallyspark.llm.packing import pack
from tallyspark.llm.pii import redact
from tallyspark.llm.quality_rules import keep_good
from tallyspark.llm.simhash import keep_one
from tallyspark.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or are probably bad go.

    Null, empty and very short texts fail the base rule. Rows with null or repeated ids are judged each by its own text; repeated
    rows stay repeated; an empty table stays empty. Columns keep their values, whatever their names.
    """
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id.

    A null id comes last; among rows with the same id that with the smallest hash of its text stays, and one of rows alike in
    both. Texts without words are near one another. An empty table stays empty. Columns keep their values.
    """
    return keep_one(docs, shingle=4, max_bits=4)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, and n_chars follows the text.

    Null texts stay null with a null length, empty ones empty; rows with null or repeated ids are cleaned each for itself; spans that
    overlap share one replacement; an empty table stays empty. Other columns keep their values.
    """
    return redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to equal weight, as many rows in all as there are, in a random order.

    A null source is a source like any other; a null id draws by its text; rows alike in id draw alike; an empty table stays empty.
    Columns keep their values.
    """
    return mix_sources(docs, seed=42).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place in it; a repeated document is packed each time.

    Null and empty texts are a piece of one token; a null id stays null; pieces of equal length are in an arbitrary but fixed order; an
    empty table gives an empty result.
    """
    return pack(docs, capacity=2048)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("personal data", personal_data),
    ("source mixing", mixing),
    ("best-fit packing", packing),
]

# Fingerprint groups, boosted trees and packing are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each reads what the one before has written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
