"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  tables, default /root/testdata/sf0.1
BENCH_CPUS    local cores, default 8
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sessionmill.session import build_session, local_master  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "summary_kpis", "harness_rollup", "provider_rollup", "model_rollup", "project_rollup", "tool_rollup",
    "model_tool_rollup", "daily_timeline", "session_list_top", "session_terms", "term_groups", "term_models",
    "term_harnesses", "term_model_harness", "term_summary", "session_model_stats", "model_tools", "sessions",
    "tool_turn_asof", "tool_error_or_join", "pricing_flatten", "usage_cost", "normalize_pi", "normalize_opencode",
    "normalize_claude", "normalize_codex", "normalize_gemini", "detect_terms", "display_formats",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", local_master(), spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"), spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's code paths and the Python workers before anything is timed.
    for name in ("harness_rollup", "session_terms"):
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        # 'noop' computes every row and column without moving them to the driver.
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(sf).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
