"""Time the headline queries and print one JSON line.

Every query is built, planned and fully materialised (``noop`` sink): one
warm-up run, then the median of ``BENCH_RUNS`` timed runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "health_verdict",
    "verdict_by_profile",
    "tail_per_node",
    "node_summary",
    "node_history_summary",
    "reason_counts",
    "health_transitions",
    "fleet_rollup",
    "parse_lines",
    "validate_reports",
    "validate_events",
    "assign_seq",
    "sequence_audit",
    "tick_rollup",
    "sustained_alerts",
    "render_table",
    "spool_summary",
    "stream_transitions",
]


def main() -> None:
    from suite.queries import REGISTRY
    from vigil.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        taken = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
