"""Times the registered queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list or 'all'; default the headline queries),
BENCH_RUNS (default 2: the median of the runs after one warm-up).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from trawlframe import build_session  # noqa: E402
from trawlframe.plans import QUERIES  # noqa: E402

HEADLINE = (
    "link_edges link_edges_parsed url_normalized request_fingerprints request_fingerprint_presets first_seen_requests "
    "new_requests duplicate_report requests_accepted_with_ttl crawl_dedup_by_domain page_fields_css pattern_email "
    "pattern_ip cleaner_normalize_whitespace cleaner_remove_special_chars webpage_validation numeric_rules "
    "distinct_documents download_stats_by_host daily_crawl_stats adaptive_retry failure_streaks breaker_replay retry_plan "
    "frontier_ranked frontier_next politeness_plan queue_stats task_results_latest_each task_status_view task_progress "
    "task_status_distribution link_targets link_domain_counts json_log_lines crawl_job stream_metrics").split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        def run() -> float:
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - started
        run()
        seconds[name] = round(statistics.median(run() for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "median seconds per query, warm, summed", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(Path(sf_dir).name.removeprefix("sf") or 0)}))
    spark.stop()


if __name__ == "__main__":
    main()
