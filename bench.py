"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Every query is
built and run to its last row (``noop`` sink); ``value`` is the sum of the best of BENCH_RUNS runs
(default 2, so that the second run is free of code generation).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from crosstally.session import build_session  # noqa: E402
from crosstally.workload.queries import QUERIES  # noqa: E402

HEADLINES = (
    "filter_ne_keeps_null", "agg_compare_sum", "unmatched_orders_lineitem",
    "unmatched_summary_both_ways", "unmatched_preview", "dup_exact_lineitem", "dup_repeated_key",
    "dup_document_text", "values_numeric", "values_exact", "rows_by_key_summary",
    "rows_by_key_columns", "bridge_summary", "bridge_extra_copies", "segment_sum",
    "segment_month", "segment_unmatched", "segment_topk", "localize_segment", "impact_unmatched",
    "impact_orders_without_lines", "profile_columns", "profile_table", "relationships",
    "quality_review", "baseline", "baseline_with_inferred_key", "citation_check", "inject_offset", "inject_truth", "score_checks",
    "score_pass_rate", "score_call_counts", "score_terms", "redact_text",
)


def seconds(spark, sf_dir: str, name: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINES
    spark = build_session(f"local[{cpus}]", "crosstally-bench", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    cold, best = {}, {}
    for name in names:
        times = [seconds(spark, sf_dir, name) for _ in range(runs)]
        cold[name], best[name] = round(times[0], 3), round(min(times), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline reconciliation queries, best of runs, summed",
                "value": round(sum(best.values()), 3),
                "unit": "sec",
                "queries": best,
                "cold": cold,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
