"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = (
    "profile_null_rate", "profile_numeric_core", "profile_quantiles", "profile_top_frequencies", "profile_disguised_nulls", "profile_pattern_detect", "qc_report",
    "dedup_full_row", "dedup_key_most_complete", "dedup_key_phone", "dedup_groups", "fuzzy_pairs_jaccard", "fuzzy_evidence", "cast_int", "cast_datetime", "cast_report",
    "null_fill_median", "null_fill_mode", "null_sequential_plan", "rule_null_rate", "diff_column_summary", "eval_f1", "sql_asof", "sql_window_rank", "sql_rollup_cube", "popular_rows")
RUNS = 3


def main() -> None:
    from tidelake import registry
    from tidelake.session import local_session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    steps = []
    for _ in range(RUNS + 1):  # a fixed task that tells how fast the machine is, to compare runs by
        began = time.perf_counter()
        spark.range(40_000_000).selectExpr("sum(hash(id, id * 7)) AS s", "max(sha2(CAST(id % 1000 AS STRING), 256)) AS m").write.format("noop").mode("overwrite").save()
        steps.append(time.perf_counter() - began)
    for name in HEADLINE:
        seconds = []
        for i in range(RUNS + 1):  # the first warms up
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                seconds.append(time.perf_counter() - began)
        took[name] = round(statistics.median(seconds), 3)
    print(json.dumps({"metric": "total_seconds_headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "calibration_sec": round(statistics.median(steps[1:]), 3), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
