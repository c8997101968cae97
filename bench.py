"""Benchmark: run the registered queries on ``$BENCH_SF_DIR`` with
``local[$BENCH_CPUS]`` and print ONE JSON line.

Each query is executed to completion into Spark's ``noop`` sink (every row is
computed, nothing is pulled to the driver).  The session is warmed first by
one pass of every query over the smallest test scale (``$BENCH_WARMUP_DIR``,
run ``$BENCH_REPEAT`` times (median), the rest once.  ``value`` is the sum of
the per-query seconds.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["enqueue_resolve", "claim_interleaved", "job_state_fold", "deps_closure",
            "dedup_generations", "claim_fifo", "apply_finishes", "run_jobs"]


def _timed(fn) -> float:
    t = time.perf_counter()
    fn()
    return time.perf_counter() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    event_dir = tempfile.mkdtemp(prefix="jobtables-bench-events-", dir="/tmp")
    from jobtables.session import local_session
    spark = local_session(
        cores=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)),
        driver_memory=os.environ.get("BENCH_DRIVER_MEMORY", "16g"), app="jobtables-bench",
        extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": event_dir,
               **({"spark.driver.extraJavaOptions": os.environ["BENCH_JAVA_OPTS"]}
                  if "BENCH_JAVA_OPTS" in os.environ else {})})
    from jobtables.plans.catalog import QUERIES
    from jobtables.plans.streams import QUERIES as STREAMS
    from jobtables.scratch import scratch_scope

    def run(name, where=sf_dir):
        with scratch_scope(spark):
            QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()

    # streams start and stop three times each, which is most of their time
    names = only or [q for q in QUERIES if q not in STREAMS]
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir) and os.environ.get("BENCH_WARMUP", "1") == "1":
        for name in names:
            run(name, warm_dir)
    else:
        run("pending_jobs")
    out = {}
    for name in names:
        n = repeat if name in HEADLINE else 1
        times = [_timed(lambda: run(name)) for _ in range(n)]
        out[name] = round(statistics.median(times), 3)
        print(f"# {name}: {out[name]}s ({n} runs)", file=sys.stderr, flush=True)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "sum_of_query_seconds",
        "value": round(sum(out.values()), 3),
        "unit": "sec",
        "queries": out,
        "headline": {k: out[k] for k in HEADLINE if k in out},
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "events_rows": rows,
        "cpus": int(cpus),
        "event_log_dir": event_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
