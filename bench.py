"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Every query is run to completion into a no-op sink: once cold, then $BENCH_RUNS times; the median of the later runs counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from seekspark.plans.catalog import CATALOG  # noqa: E402
from seekspark.session import build_session  # noqa: E402

HEADLINE = (
    "scan_stats", "safety_filter", "line_chunks_60_12", "regex_symbols", "hash_skip", "upsert_result",
    "events_replay_upsert", "knn_batch", "postings_stats", "bm25_topk", "rrf_fusion", "rerank_natural", "search_e2e",
)


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    CATALOG[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
           "spark.driver.host": "127.0.0.1", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}
    for name in names:
        cold[name] = round(run(spark, name, folder), 3)
        warm[name] = round(statistics.median(run(spark, name, folder) for _ in range(runs)), 3) if runs else cold[name]
        print(name, cold[name], warm[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds_of_headline_queries", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "sf": folder.rstrip("/").split("sf")[-1],
    }))


if __name__ == "__main__":
    main()
