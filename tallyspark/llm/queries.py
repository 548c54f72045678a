"""One query per operator over the test tables, with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .backoff_lm import score_texts
from .collocations import collocations, collocations_sql
from .hnsw import nearest
from .line_crf import line_quality
from .mixing import mix_sources, mixing_sql
from .packing import pack
from .pii import personal_data
from .quality_rules import quality_sql, quality_verdicts
from .simhash import near_duplicates
from .substring_dedup import remove_repeats
from .token_counts import count_tokens
from .topk import top_k
from .variants import spelling_variants, variants_sql


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), shingle=4, max_bits=4)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_documents(spark, sf_dir), fields=("source", "lang", "text"), by="line")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_documents(spark, sf_dir))


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return line_quality(_documents(spark, sf_dir), labels, fold=(4, 2), threshold=0.7)


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, every=50, scale=256)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), capacity=2048)


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_documents(spark, sf_dir), order=2, fold=(7, 2))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_documents(spark, sf_dir)).drop("quality")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir), seed=42)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir), window=13)


def op11_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=20, every=20)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_documents(spark, sf_dir), spoil=199, min_length=6, min_count=5, ratio=5)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_documents(spark, sf_dir), min_count=100, top=2000)


TOP_K_SQL = """
    WITH v AS (SELECT DISTINCT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS vec
               FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
               AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.id AS query_id, c.id AS vec_id,
                 max(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])))::BIGINT AS score
          FROM v q JOIN v c ON q.id <> c.id WHERE q.id % 50 = 0 GROUP BY ALL)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_duplicates,
        op2_token_counts,
        op3_personal_data,
        op4_line_quality,
        op5_exact_top_k,
        op6_best_fit_packing,
        op7_lm_scores,
        op8_quality_rules,
        op9_mix_sources,
        op10_substring_dedup,
        op11_approximate_neighbours,
        op12_spelling_variants,
        op13_collocations,
    )
}

SQL: dict[str, str] = {
    "op5_exact_top_k": TOP_K_SQL,
    "op8_quality_rules": quality_sql(),
    "op9_mix_sources": mixing_sql(seed=42),
    "op12_spelling_variants": variants_sql(),
    "op13_collocations": collocations_sql(),
}
