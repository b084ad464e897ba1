"""Times the headline queries and prints one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times; the median counts. Results go to the ``noop`` sink, so
every row and column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

os.environ.setdefault("LORESPAN_DRIVER_MEMORY", "16g")

from lorespan.plans import load  # noqa: E402
from lorespan.session import local_session  # noqa: E402

HEADLINE = (
    "search_cosine",
    "retrieve",
    "hybrid_score_search",
    "clean_documents",
    "chunk_recursive",
    "remove_duplicate_lines",
    "remove_duplicate_chunks",
    "dashboard",
    "session_table",
    "context_window",
    "faithfulness",
    "hallucination",
    "ranking_metrics",
    "latency_requests",
    "stage_statistics",
    "missing_values",
    "describe_customers",
    "correlation",
    "correlation_ranks",
    "mmr_search",
    "document_relevance",
    "stream_sessions",
)


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, app="bench")
    entries = load()
    took = {}
    for name in names:
        times = []
        for i in range(runs + 1):
            start = time.perf_counter()
            entries[name].run(spark, root).write.format("noop").mode("overwrite").save()
            if i:
                times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times), 3)
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": root.rstrip("/").rsplit("sf", 1)[-1],
                "cores": cores,
                "spark": spark.version,
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
