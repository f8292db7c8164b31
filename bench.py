"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query is written in full to the noop sink; BENCH_RUNS (default 1) runs give a median.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    "fair_price_score", "fair_price", "rule_score", "reject_histogram", "upsert_listings", "price_changes",
    "dup_groups", "fuzzy_match", "change_log", "top_alerts", "address_key", "extract_features",
    "json_flatten", "html_icon_cards", "watch_scan", "stream_scan", "resolve_units",
]


def main() -> int:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE

    from hearthline.plans import registry
    from hearthline.session import build_session

    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = registry.load()
    queries["reject_histogram"](spark, folder).collect()  # warm the JVM and the file cache
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
