"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import time

from tallyspark.plans.catalog import QUERIES
from tallyspark.session import local_session

HEADLINE = (
    "slice_value", "slice_stats", "grain_trend_month", "period_compare_month", "contributors", "breakdown_with_other",
    "breakdown_median_other", "records_page", "kpi_totals", "kpi_delta", "breakdown_share", "distribution", "treemap",
    "filter_options", "correlation_pairs", "anomalies", "variance_waterfall", "variance_ranking", "significance",
    "pvm_total", "drivers", "metrics_all", "targets_eval", "row_rules", "masked_projection", "quality_columns", "pii_detect",
    "duplicate_rows", "append_dedup", "replace_period", "join_facts", "forecast_best", "chunks", "bm25_top", "hash_embed",
    "hybrid_topk", "number_gate", "stream_trend_day")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.time() - start

    for name in ("slice_stats", "contributors", "bm25_top", "hash_embed"):
        run(name)  # the JVM and the Python workers are warm before the clock starts
    seconds = {name: round(run(name), 3) for name in HEADLINE}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
