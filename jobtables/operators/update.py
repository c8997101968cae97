"""Finishes and life-cycle folds.

Plain Parquet has no row update: the job table is a snapshot, and an update
is a new snapshot (copy-on-write), or an append to a life-cycle event log that
is folded to the current state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtables.functions.status import finish_result, finish_status
from jobtables.schema import (
    ERR_JOB_NOT_FOUND,
    KEY,
    STATUS_FAILED,
    STATUS_PENDING,
    STATUS_RUNNING,
    STATUS_SUCCEEDED,
)

# Event kinds and the status each leaves (fixed values), in life-cycle order:
# on equal times the later kind wins.
KIND_STATUS = [("request", STATUS_PENDING), ("start", STATUS_RUNNING),
               ("succeed", STATUS_SUCCEEDED), ("fail", STATUS_FAILED)]


def _kind_rank(kind="kind") -> F.Column:
    e = F.lit(None).cast("int")
    for i, (k, _) in enumerate(KIND_STATUS):
        e = F.when(F.col(kind) == k, F.lit(i)).otherwise(e)
    return e


def _kind_to_status(kind: F.Column) -> F.Column:
    e = F.lit(None).cast("string")
    for k, s in KIND_STATUS:
        e = F.when(kind == k, F.lit(s)).otherwise(e)
    return e


def finish_outcomes(finishes: DataFrame) -> DataFrame:
    """one-of result -> (status, result).  Neither set: no change, still
    OK (``unset``); such rows are kept and flagged, and ignored by U1."""
    st = finish_status()
    return finishes.select(
        "finish_id", "job_id", st.alias("status"), finish_result().alias("result"),
        st.isNull().alias("unset"), "finish_ts")


def _set_finishes(finishes: DataFrame) -> DataFrame:
    return finish_outcomes(finishes).where(~F.col("unset"))


def _jobs_per_id(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy(F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"),
                                                      F.max("status").alias("_st"))


def apply_finishes(jobs: DataFrame, finishes: DataFrame, strict: bool = False) -> DataFrame:
    """U1 + U3: set status, finish time and url or error by id.

    Several finishes of one id in a batch apply in (finish_ts, finish_id)
    order, each overwriting: status and finish time come from the last; the
    url from the last success and the error from the last failure (each
    update writes only its own column), which equals applying them one by
    one.  The old state is not checked (as in the store); ``strict=True``
    applies only the first finish of a job that is running.  What is not
    applied or overwritten is what :func:`rejected_finishes` returns: an id
    that several rows hold is refused, not applied to each.

    The finishes are pre-aggregated per id (partial + final), so the join to
    the job table is one-to-one on id.
    """
    f = _set_finishes(finishes)
    order = F.struct(F.col("finish_ts"), F.col("finish_id"))
    if strict:
        agg = f.groupBy("job_id").agg(
            F.min_by(F.struct("status", "result", "finish_ts"), order).alias("_f"))
        agg = agg.select("job_id", F.col("_f.status").alias("_fs"),
                         F.col("_f.finish_ts").alias("_ft"),
                         F.when(F.col("_f.status") == STATUS_SUCCEEDED,
                                F.col("_f.result")).alias("_url"),
                         F.when(F.col("_f.status") == STATUS_FAILED,
                                F.col("_f.result")).alias("_err"))
    else:
        agg = f.groupBy("job_id").agg(
            F.max_by(F.col("status"), order).alias("_fs"),
            F.max(F.col("finish_ts")).alias("_ft"),
            F.max_by(F.col("result"),
                     F.when(F.col("status") == STATUS_SUCCEEDED, order)).alias("_url"),
            F.max_by(F.col("result"),
                     F.when(F.col("status") == STATUS_FAILED, order)).alias("_err"))
    # ids that the finishes name and several rows hold
    twice = _jobs_per_id(jobs.join(agg.select(F.col("job_id").alias("id")), "id", "left_semi")) \
        .where(F.col("_n") > 1)
    agg = agg.join(twice, F.col("job_id") == F.col("_id"), "left_anti")
    j = jobs.join(agg, jobs["id"] == agg["job_id"], "left")
    hit = F.col("job_id").isNotNull()
    if strict:
        hit = hit & (F.col("status") == STATUS_RUNNING)
    return j.withColumns({
        "status": F.when(hit, F.col("_fs")).otherwise(F.col("status")),
        "finish_time": F.when(hit, F.col("_ft")).otherwise(F.col("finish_time")),
        "result_url": F.when(hit, F.coalesce(F.col("_url"), F.col("result_url")))
                       .otherwise(F.col("result_url")),
        "result_error": F.when(hit, F.coalesce(F.col("_err"), F.col("result_error")))
                         .otherwise(F.col("result_error")),
    }).drop("job_id", "_fs", "_ft", "_url", "_err")


def rejected_finishes(jobs: DataFrame, finishes: DataFrame, strict: bool = False
                      ) -> DataFrame:
    """Finishes the store refuses (id matching no row, or more than one;
    with ``strict``, a job that is not running, or that an earlier finish of
    the batch has finished), with the reason.  A finish with neither result
    set never reaches the store and is not refused."""
    f = _set_finishes(finishes).select("finish_id", "job_id", "finish_ts")
    named = jobs.join(f.select(F.col("job_id").alias("id")).distinct(), "id", "left_semi")
    m = f.join(_jobs_per_id(named), F.col("job_id") == F.col("_id"), "left")
    reason = (F.when(F.col("_n").isNull(), F.lit(ERR_JOB_NOT_FOUND))
              .when(F.col("_n") > 1, F.lit("more than one job with this id")))
    if strict:
        first = f.groupBy(F.col("job_id").alias("_job")).agg(
            F.min_by("finish_id", F.struct("finish_ts", "finish_id")).alias("_first"))
        m = m.join(first, F.col("job_id") == F.col("_job"), "left")
        reason = (reason.when(F.col("_st") != STATUS_RUNNING, F.lit("job is not running"))
                  .when(~F.col("finish_id").eqNullSafe(F.col("_first")),
                        F.lit("job is finished already")))
    return (m.withColumn("reason", reason).where(F.col("reason").isNotNull())
            .select("finish_id", "job_id", "reason"))


def job_events(jobs: DataFrame) -> DataFrame:
    """The life-cycle log of a job table: request at queue time, start at
    start time, succeed or fail at finish time.  One narrow pass (explode of
    a per-row array), no union of several scans."""
    null_s = F.lit(None).cast("string")

    def ev(kind, ts, worker=null_s, result=null_s):
        return F.struct(F.lit(kind).alias("kind"), ts.alias("ts"), worker.alias("worker"),
                        result.alias("result"))

    st = F.col("status")
    evs = F.array(
        ev("request", F.col("queue_time")),
        F.when(F.col("start_time").isNotNull(), ev("start", F.col("start_time"), F.col("worker"))),
        F.when((st == STATUS_SUCCEEDED) & F.col("finish_time").isNotNull(),
               ev("succeed", F.col("finish_time"), result=F.col("result_url"))),
        F.when((st == STATUS_FAILED) & F.col("finish_time").isNotNull(),
               ev("fail", F.col("finish_time"), result=F.col("result_error"))),
    )
    x = jobs.select(F.col("id").alias("job_id"), *KEY, F.explode(evs).alias("e"))
    x = x.where(F.col("e").isNotNull())
    is_req = F.col("e.kind") == "request"
    return x.select(
        "job_id", F.col("e.kind").alias("kind"), F.col("e.ts").alias("ts"),
        *[F.when(is_req, F.col(k)).alias(k) for k in KEY],
        F.col("e.worker").alias("worker"), F.col("e.result").alias("result"))


def job_state_fold(events: DataFrame) -> DataFrame:
    """U4: fold a life-cycle log to one row per job.

    One hash aggregation on job_id (partial per task, then final): the last
    event by (ts, life-cycle order) sets the status; each column comes from
    the last event that writes it."""
    kind = F.col("kind")
    order = F.struct(F.col("ts"), _kind_rank())

    def last_of(value, *kinds):
        return F.max_by(value, F.when(kind.isin(*kinds), order))

    agg = events.groupBy("job_id").agg(
        F.max_by(kind, order).alias("_last"),
        *[last_of(F.col(k), "request").alias(k) for k in KEY],
        F.min(F.when(kind == "request", F.col("ts"))).alias("queue_time"),
        last_of(F.col("worker"), "start").alias("worker"),
        F.max(F.when(kind == "start", F.col("ts"))).alias("start_time"),
        F.max(F.when(kind.isin("succeed", "fail"), F.col("ts"))).alias("finish_time"),
        last_of(F.col("result"), "succeed").alias("result_url"),
        last_of(F.col("result"), "fail").alias("result_error"),
    )
    return agg.select(
        F.col("job_id").alias("id"), *KEY, _kind_to_status(F.col("_last")).alias("status"),
        "worker", "queue_time", "start_time", "finish_time", "result_url", "result_error")


def event_accumulators(events: DataFrame) -> DataFrame:
    """A life-cycle event as the accumulator of a log that holds it only (one
    row per event; merge them with :func:`merge_accumulators`)."""
    kind, ts = F.col("kind"), F.col("ts")

    def at(kinds: list[str], **values) -> F.Column:
        return F.when(kind.isin(*kinds), F.struct(ts.alias("ts"), *[
            F.col(c).alias(n) for n, c in values.items()]))
    return events.select(
        F.col("job_id"),
        F.struct(ts.alias("ts"), _kind_rank().alias("rank"), kind.alias("kind")).alias("last"),
        at(["request"], **{k: k for k in KEY}).alias("request"),
        F.when(kind == "request", ts).alias("queue_time"),
        at(["start"], worker="worker").alias("start"),
        F.when(kind.isin("succeed", "fail"), ts).alias("finish_time"),
        at(["succeed"], result="result").alias("success"),
        at(["fail"], result="result").alias("failure"))


def merge_accumulators(acc: DataFrame) -> DataFrame:
    """One accumulator per job: every field is a maximum or minimum, so logs
    can be merged in any order and any number of pieces."""
    last = [F.max(c).alias(c) for c in ("last", "request", "start", "finish_time", "success", "failure")]
    return acc.groupBy("job_id").agg(*last, F.min("queue_time").alias("queue_time"))


def accumulated_jobs(acc: DataFrame) -> DataFrame:
    """U4's job rows from merged accumulators."""
    return acc.select(
        F.col("job_id").alias("id"), *[F.col(f"request.{k}").alias(k) for k in KEY],
        _kind_to_status(F.col("last.kind")).alias("status"), F.col("start.worker").alias("worker"),
        "queue_time", F.col("start.ts").alias("start_time"), "finish_time",
        F.col("success.result").alias("result_url"), F.col("failure.result").alias("result_error"))
