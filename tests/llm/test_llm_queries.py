"""The registered queries against DuckDB on the same files, and the pipeline stage by stage."""

import re
import zlib

import pytest

import corpus_pipeline
from tallyspark.llm.queries import QUERIES, SQL
from tests.llm import brute
from tests.oracle import connect, difference, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", SQL)
def test_query_against_sql(spark, name):
    problem = difference(spark_rows(QUERIES[name](spark, SF)), duck_rows(connect(SF), SQL[name]))
    assert problem is None, problem


@pytest.mark.parametrize("name", ["op3_personal_data", "op8_quality_rules", "op9_mix_sources"])
def test_native_plans_hold_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", plan)


@pytest.mark.parametrize("name", ["op1_simhash_near_duplicates", "op6_best_fit_packing", "op10_substring_dedup", "op11_approximate_neighbours", "op12_spelling_variants", "op13_collocations"])
def test_no_cross_joins(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "_"))
        stage(spark, frames[-1], SF).write.parquet(path)
        frames.append(spark.read.parquet(path))
    raw, good, one, clean, mixed, packed = frames
    assert all(f.columns == raw.columns for f in frames[:-1])
    text = {r["doc_id"]: r["text"] for r in raw.collect()}
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    assert all(text[k] == t for k, t in kept.items())
    for k, t in text.items():
        words, _, symbols, _, repeats = brute.quality_counts(t)
        failed = words < 50 or 100 * repeats > 50 * words
        assert not (failed and k in kept)
        if not failed and 25 * symbols <= words and 20 * repeats <= words and words >= 100 and t.rstrip().endswith("."):
            assert k in kept or t.upper() == t
    firsts = {k for k, _, c in brute.near_groups(sorted(kept.items())) if k == c}
    assert {r["doc_id"]: r["text"] for r in one.collect()} == {k: kept[k] for k in firsts}
    for r in clean.collect():
        assert r["n_chars"] == len(r["text"])
        assert bool(brute.personal(text[r["doc_id"]])) <= ("[" in r["text"])
        assert not brute.personal(r["text"])
    cleaned = {r["doc_id"]: r["text"] for r in clean.collect()}
    copies = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    assert all(cleaned[k] == t for k, t in copies)
    assert sorted(r["doc_id"] for r in packed.where("piece = 0").collect()) == sorted(k for k, _ in copies)


def test_run_is_all_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    again = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in again)
    assert all(0 <= r["offset"] and r["offset"] + r["length"] <= 2048 for r in rows)


def test_pipeline_of_nothing_and_of_odd_rows(spark, empty, odd, tmp_path):
    for name, start in (("empty", empty), ("odd", odd)):
        docs = start
        for stage_name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}_{zlib.crc32(stage_name.encode())}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
        assert "sequence_id" in docs.columns
