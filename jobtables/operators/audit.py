"""Audits of the job table's invariants and bookkeeping.

All are hash aggregations with partial aggregation before the shuffle, so a
hot key or worker costs one partial row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtables.functions.status import ts_ntz
from jobtables.operators.ordered import join_on_keys
from jobtables.operators.quantiles import exact_quantiles
from jobtables.schema import (
    KEY,
    STATUS_FAILED,
    STATUS_PENDING,
    STATUS_RUNNING,
    STATUS_SUCCEEDED,
    STATUSES,
)

PERCENTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def audit_live_key(jobs: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """A1: KEYs holding more than one live (non-failed) job."""
    return (jobs.where(F.col("status") != STATUS_FAILED).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n_live"), F.min("id").alias("min_id"),
                 F.max("id").alias("max_id"))
            .where(F.col("n_live") > 1))


def audit_job_id(jobs: DataFrame) -> DataFrame:
    """A2: ids occurring more than once (the primary key is not enforced by
    Parquet)."""
    return (jobs.groupBy("id").agg(F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_rows") > 1))


def audit_workers(jobs: DataFrame) -> DataFrame:
    """A3: jobs per worker and status."""
    s = F.col("status")
    return (jobs.where(F.col("worker").isNotNull()).groupBy("worker").agg(
        F.count(F.lit(1)).alias("n_jobs"),
        F.count_if(s == STATUS_RUNNING).alias("n_running"),
        F.count_if(s == STATUS_SUCCEEDED).alias("n_succeeded"),
        F.count_if(s == STATUS_FAILED).alias("n_failed"),
        F.min("start_time").alias("first_start"),
        F.max("start_time").alias("last_start")))


def audit_stuck(jobs: DataFrame, now, limit_s: int) -> DataFrame:
    """A4: running jobs started more than ``limit_s`` seconds before ``now``."""
    now_c = ts_ntz(now)
    cutoff = now_c - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(limit_s))
    return (jobs.where((F.col("status") == STATUS_RUNNING) & (F.col("start_time") < cutoff))
            .select("id", "worker", "repository", "start_time",
                    F.timestamp_diff("SECOND", F.col("start_time"), now_c).alias("running_s")))


# Column rules per status (fixed): which optional columns must be set (True)
# or empty (False).
COLUMN_RULES = {
    STATUS_PENDING: {"worker": False, "start_time": False, "finish_time": False,
                     "result_url": False, "result_error": False},
    STATUS_RUNNING: {"worker": True, "start_time": True, "finish_time": False,
                     "result_url": False, "result_error": False},
    STATUS_SUCCEEDED: {"worker": True, "start_time": True, "finish_time": True,
                       "result_url": True, "result_error": False},
    STATUS_FAILED: {"worker": True, "start_time": True, "finish_time": True,
                    "result_url": False, "result_error": True},
}


def column_violations(jobs: DataFrame) -> DataFrame:
    """A5 rows: (id, status, rule) for every broken state/column rule."""
    rules = []
    for status, cols in COLUMN_RULES.items():
        for c, must in cols.items():
            bad = F.col(c).isNull() if must else F.col(c).isNotNull()
            name = f"{status}: {c} {'missing' if must else 'set'}"
            rules.append(F.when((F.col("status") == status) & bad, F.lit(name)))
    rules.append(F.when(~F.col("status").isin(*STATUSES) | F.col("status").isNull(),
                        F.lit("unknown status")))
    arr = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return jobs.select("id", "status", F.explode(arr).alias("rule"))


def audit_columns(jobs: DataFrame) -> DataFrame:
    """A5: number of jobs breaking each state/column rule."""
    return (column_violations(jobs).groupBy("rule")
            .agg(F.count(F.lit(1)).alias("n_jobs")))


def _micros(a: str, b: str) -> F.Column:
    return F.timestamp_diff("MICROSECOND", F.col(a), F.col(b))


def _secs(a: str, b: str) -> F.Column:
    return _micros(a, b) / 1_000_000


def wait_run_times(jobs: DataFrame, by: Sequence[str] = ("repository",)) -> DataFrame:
    """Queue wait (queue -> start) and run time (start -> finish), seconds."""
    w, r = _secs("queue_time", "start_time"), _secs("start_time", "finish_time")
    return jobs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_jobs"),
        F.count(w).alias("n_started"),
        F.count(r).alias("n_finished"),
        F.avg(w).alias("avg_wait_s"),
        F.max(w).alias("max_wait_s"),
        F.avg(r).alias("avg_run_s"),
        F.max(r).alias("max_run_s"))


def wait_run_percentiles(jobs: DataFrame, by: Sequence[str] = ("repository",),
                         q: dict[str, float] = PERCENTILES) -> DataFrame:
    """A6, percentiles: exact ones of the wait and run times per group, in
    seconds (null: no job of the group has started, or finished)."""
    by = list(by)
    names = [f"{n}_{kind}_s" for kind in ("wait", "run") for n in q]
    times = jobs.select(*by, _micros("queue_time", "start_time").alias("wait"),
                        _micros("start_time", "finish_time").alias("run"))
    out = jobs.select(*by).distinct()
    for kind in ("wait", "run"):
        found = exact_quantiles(times, by, kind, {f"{n}_{kind}_s": f for n, f in q.items()})
        out = join_on_keys(out, found, by, "left")
    return out.select(*by, *[(F.col(n) / 1_000_000).alias(n) for n in names])


def reuse_rate(resolved: DataFrame) -> DataFrame:
    """Share of requests answered by an existing job, from J1's output."""
    return resolved.agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.count_if(F.col("created")).alias("n_created"),
        F.count_if(~F.col("created")).alias("n_reused"),
        F.countDistinct("job_id").alias("n_jobs"),
    ).withColumn("reuse_rate", F.try_divide(F.col("n_reused"), F.col("n_requests")))
