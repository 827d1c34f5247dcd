"""Times the headline queries and prints one JSON line.

Each query is built and run in full, into a sink that throws rows away: once to
warm up, then BENCH_RUNS times, of which the best counts.
"""

from __future__ import annotations

import json
import os
import time

from mailsieve.checks import load
from mailsieve.session import local_session

HEADLINE = [
    "e1_process",
    "e2_passed",
    "e6_process_tenants",
    "c6_blocklist_verdict",
    "d15_redact_all",
    "d21_html_to_text",
    "d24_injection_labels",
    "a2_gmail_export",
    "a3_eml",
    "c13_search_from",
    "h6_thread_page",
    "g1_threads",
    "h8_message_position",
    "l2_awaiting_reply",
    "l6_transcripts",
    "f2_resolve_requests",
    "f3_draft_recipients",
    "g7_connection_counts",
    "i2_upsert_policies",
    "i7_touch_keys",
    "j1_rate_limit",
    "j1_trailing_attempts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    times = {}
    for name in HEADLINE:
        best = None
        for attempt in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if attempt and (best is None or took < best):
                best = took
        times[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "total time of headline queries, best run each",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
