"""Headline queries on the driver tables; prints one JSON line.

BENCH_SF_DIR   tables to read (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     timed runs per query after one warm-up (default 3, the median counts)
BENCH_QUERIES  comma-separated names (default: the list below)
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tallyloom.plans import catalog
from tallyloom.session import build_session

HEADLINE = (
    "prompt_style", "document_words", "distinct_prompts", "token_ledger", "models_ranked", "report_totals",
    "project_ranking", "daily_activity", "longest_streak", "heat_levels", "history_bag_minus", "unmaterialized_refs",
    "copy_coalesce", "copied_calls", "update_merge", "update_transitions", "cumulative_final", "segment_stitch",
    "digest_dedupe", "manifest_digest", "content_fingerprint", "claude_owner_prompts", "grok_ingest", "hermes_ingest",
    "copilot_ingest", "sqlite_scan",
)
#: The largest readers take long; one run each, without a warm-up.
READERS = ("claude_ingest", "codex_ingest")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE + READERS)).split(",")
    spark = build_session(f"local[{cpus}]", cpus, **{"spark.ui.enabled": "false", "spark.driver.memory": "12g",
                                                     "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    seconds: dict[str, float] = {}
    for name in names:
        timings = []
        for _ in range(1 if name in READERS else runs + 1):
            started = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            timings.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(timings[1:] or timings), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
