"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed fully (noop sink, no driver collect). Every query is first run once
untimed (JVM and plan warm-up), then $BENCH_REPS timed rounds run all queries in turn and
each query's median is reported. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "frontier",
    "daily_runout",
    "filter_runout",
    "weekly_counts",
    "monthly_counts",
    "count_kpis",
    "frp_summary",
    "frp_cumulative",
    "frame_counts",
    "assign_projects",
    "merge_detections",
    "scan_detections",
    "write_archive",
    "report_kpis",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    keys = sys.argv[1:] or HEADLINE

    from hotspot.plans import all_queries
    from hotspot.session import get_session

    spark = get_session(f"local[{cpus}]", partitions=max(8, cpus))
    spark.sparkContext.setLogLevel("ERROR")
    q = all_queries()
    def run(k: str) -> float:
        t0 = time.perf_counter()
        q[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    failed: dict[str, str] = {}
    for k in keys:  # warm-up round
        try:
            run(k)
        except Exception as e:  # keep benchmarking the others; report the failure
            failed[k] = f"{type(e).__name__}: {str(e)[:200]}"
    ok = [k for k in keys if k not in failed]
    samples: dict[str, list[float]] = {k: [] for k in ok}
    for _ in range(reps):
        for k in ok:
            samples[k].append(run(k))
    times = {k: round(statistics.median(v), 3) for k, v in samples.items()}
    for k, v in times.items():
        print(f"# {k}: {v} s", file=sys.stderr, flush=True)
    sf = sf_dir.rsplit("sf", 1)[-1] if "sf" in os.path.basename(sf_dir) else sf_dir
    out = {
        "metric": "sum_median_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf,
        "cpus": cpus,
        "reps": reps,
    }
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
