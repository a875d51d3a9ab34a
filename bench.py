"""Time the headline queries: one warm-up, then the median of BENCH_RUNS runs each.

Prints one JSON line. Every query writes all of its rows to a sink that discards them.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from geovis.plans import catalog
from geovis.session import get_session

HEADLINE = [
    "page_meta", "page_links", "visible_text", "document_readability", "jsonld_objects", "robots_rules",
    "bot_access", "sitemap_stats", "capture_choice", "technical_scores", "exact_mentions", "fuzzy_mentions",
    "mention_report", "visibility_scores", "top_competitors", "audit_scores", "call_costs", "threshold_crossings",
    "usage_crossings", "request_admission", "monthly_rollup", "rate_limit_history", "owned_answers",
    "integrity_report", "audit_states",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_session(
        "geovis-bench", f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, median seconds, total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus), "runs": runs,
    }))


if __name__ == "__main__":
    main()
