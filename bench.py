"""Wall time of the headline queries, one JSON line.

Each query runs to completion into a sink that keeps nothing, so the time is that of the plan, not
of moving rows to Python. The first run of each query compiles; the better of two is reported. Queries that also hold their result
against another are timed without that.
"""

from __future__ import annotations

import contextlib
import io
import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "pivot",
    "pivot_page",
    "kpi_totals",
    "trend",
    "trend_monthly",
    "breakdown",
    "top_terms",
    "dimension_values",
    "filter_options",
    "group_count",
    "group_count_approx",
    "composite_key",
    "cardinality_ranking",
    "column_profile",
    "segment_totals",
    "reaggregate_metric",
    "total_row",
    "bucket_by_condition",
    "bucket_by_period",
    "pct_of_total",
    "baseline_inflation",
    "cumulative_share",
    "cumulative_count",
    "join_dimensions",
    "join_dimensions_dedup",
    "match_primary_rows",
    "compare_columns",
    "order_columns",
    "chart_series",
    "segment_significance",
    "row_significance",
    "share_significance",
    "daily_bayes_test",
    "build_rollup",
    "refresh_rollup",
    "build_enriched_source",
    "pivot_from_rollup",
    "rollup_coverage",
    "rollup_recommendations",
    "usage_timeseries",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    with contextlib.redirect_stdout(io.StringIO()):
        from tallyspark.catalog import REGISTRY
        from tallyspark.session import local_session

        shared = tempfile.TemporaryDirectory(prefix="bench-", ignore_cleanup_errors=True)
        spark = local_session(cores, "bench", int(cores), shared.name)
        spark.sparkContext.setLogLevel("ERROR")
        REGISTRY["kpi_totals"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times: dict[str, float] = {}
        for name in HEADLINE:
            best = float("inf")
            for _ in range(runs):
                start = time.perf_counter()
                (REGISTRY[name].timed or REGISTRY[name].build)(spark, sf_dir).write.format("noop").mode("overwrite").save()
                best = min(best, time.perf_counter() - start)
            times[name] = round(best, 3)
        spark.stop()
        shared.cleanup()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": int(cores),
            }
        )
    )


if __name__ == "__main__":
    main()
