"""Time the headline queries: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hindcast.plans.queries import QUERIES  # noqa: E402
from hindcast.session import session  # noqa: E402

HEADLINE = [
    "evidence_agg_cutoff",
    "evidence_entity_rows",
    "evidence_entity_rows_recent",
    "evidence_entity_static",
    "result_summary",
    "evidence_packet",
    "followup_evidence",
    "leakage_audit",
    "customer_spend",
    "evaluation_summary",
    "regression_mae",
    "ground_truth_match",
    "profile_row_counts",
    "profile_nulls_distinct",
    "profile_numeric",
    "profile_top_values",
    "relationship_support",
    "final_prompt",
    "trajectories",
    "loop_metrics",
    "sample_episodes",
    "chat_text",
    "preference_pairs",
    "memory_search",
    "memory_upsert",
    "log_page",
    "cascade_delete",
    "query_audit",
]


def run(spark, name: str, folder: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = session(
        f"local[{cpus}]",
        cpus,
        **{"spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        runs = [run(spark, name, folder) for _ in range(3)]  # the first run compiles the generated code
        times[name] = round(statistics.median(runs), 3)
        print(f"{name} first {runs[0]:.2f} median {times[name]:.2f}", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
