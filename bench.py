"""Time headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each query is
run to completion into a sink that keeps nothing; the better of two runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetscope import catalog  # noqa: E402
from fleetscope.session import local_session  # noqa: E402

HEADLINE = [
    "log_patterns",
    "log_pattern_clients",
    "scan_skew",
    "command_distribution_by_name",
    "activity_timeline",
    "client_spikes",
    "client_stats",
    "key_pattern_snapshot",
    "hot_keys",
    "composite_keys",
    "latency_profile",
    "latency_trend",
    "annotate_indexing",
    "trace_summary",
    "counter_deltas",
    "rolling_baseline",
    "downsampled_series",
    "capacity_forecast",
    "data_loss",
    "new_command_shapes",
    "slowlog_regressions",
    "match_triggers",
    "duplicate_primaries",
    "correlate_spans",
    "parse_capture",
    "otlp_spans",
    "info_rows",
    "spike_events",
    "correlated_anomalies",
    "client_lockout",
    "resync_loop",
    "admitted_requests",
    "knn",
    "cache_lookup",
    "hybrid_rerank",
    "memory_recall",
    "memory_evictions",
    "threshold_effectiveness",
    "replay_dense_sweep",
    "consolidation_plan",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", int(os.environ.get("BENCH_CPUS", "8")))
    queries = catalog.load().QUERIES
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(2):
            started = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - started
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
