"""Benchmark: run the headline queries at $BENCH_SF_DIR on
local[$BENCH_CPUS] and print one JSON line.

Each query is forced to completion with the no-op sink (every row and
column computed, nothing collected to the driver).  The first query also
pays JVM warm-up, so a throw-away warm-up query runs first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "match_topk", "match_topk_wide", "skill_pairs", "skills_in_jobs", "dedup_strict", "dedup_latest",
    "classify_merge_rules", "classify_batches", "category_keywords", "html_text",
    "listing_ids", "clean_text", "nightly_run",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from jobsift.plans.catalog import queries
    from jobsift.session import get_session

    extra = {"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g")}
    eventlog = os.environ.get("BENCH_EVENTLOG_DIR")  # opt-in: per-stage times for tools/stage_times.py
    if eventlog:
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": eventlog})
    spark = get_session(f"local[{cpus}]", app="jobsift-bench",
                        shuffle_partitions=int(cpus) * 2, extra=extra)
    qs = queries()
    # warm-up: JIT and Python workers
    qs["scan_jobs"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        try:  # label the stages in the event log with the query name
            spark.sparkContext.setJobDescription(name)
        except Exception:
            pass
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
