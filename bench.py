"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from wiretally.plans.catalog import QUERIES
from wiretally.plans.catalog.registry import table
from wiretally.plans.detection import tune
from wiretally.session import build_session

HEADLINE = (
    "detection_alert_summary", "flood_and_scan_alerts", "flood_detector", "scan_detector", "tunnel_detector",
    "sliding_counts_and_rates", "sliding_distinct_counts", "ewma_baseline", "greedy_emission", "fused_alerts",
    "incidents", "normalised_flows", "dns_lexical_features", "topology_nodes", "alert_summary",
    "population_stability", "feature_drift_report", "ranking_metrics", "streaming_sliding_counts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("wiretally-bench", int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    tune(spark)
    events = table(spark, sf_dir, "events").count()
    seconds = {}
    for name in HEADLINE:
        t = time.time()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - t, 3)
    print(json.dumps({
        "metric": "total wall-clock of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").split("sf")[-1], "events": events,
        "events_per_second_full_detection": round(events / seconds["detection_alert_summary"], 1),
    }))


if __name__ == "__main__":
    main()
