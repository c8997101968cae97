"""First-in-first-out matching of pending jobs and worker polls.

The order of the queue is (queue_time, id): the id breaks ties of whole-second
queue times.  Global ranks come from :mod:`jobtables.operators.ordered`, so no
step sorts the whole queue in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtables.functions.status import next_poll_time
from jobtables.operators.ordered import global_row_number, join_on_keys, running_sums
from jobtables.schema import KEY, STATUS_PENDING, STATUS_RUNNING, WORKER_POLL_DELAY_S

QUEUE_ORDER = ["queue_time", "id"]
POLL_ORDER = ["poll_time", "poll_id"]


def pending(jobs: DataFrame) -> DataFrame:
    """pending jobs (an equality filter pushed to the scan)."""
    return jobs.where(F.col("status") == STATUS_PENDING)


def next_k_jobs(jobs: DataFrame, k: int) -> DataFrame:
    """The k oldest pending jobs (D1 applied k times).  ``orderBy`` +
    ``limit`` plans as TakeOrderedAndProject: each task keeps its own top k."""
    return pending(jobs).orderBy(*QUEUE_ORDER).limit(k)


def next_job(jobs: DataFrame) -> DataFrame:
    """The oldest pending job (empty when none: "no pending jobs")."""
    return next_k_jobs(jobs, 1)


def _claim(jobs: DataFrame, polls: DataFrame, keys: Sequence[str], delay_s: int
           ) -> DataFrame:
    """Rank the pending jobs and the polls in ONE pass: both sides go through
    one range partitioning and one checkpoint (side is the leading sort key),
    then the i-th job of a key meets the i-th poll of that key."""
    keys = list(keys)
    q = pending(jobs).select(
        *keys, F.col("id").alias("job_id"),
        *[F.col(k).alias(f"job_{k}") for k in KEY if k not in keys],
        F.col("queue_time"), F.col("queue_time").alias("_t"), F.lit(0).alias("_side"))
    p = polls.withColumns({"_t": F.col("poll_time"), "_side": F.lit(1)})
    both = q.unionByName(p, allowMissingColumns=True)
    ranked = global_row_number(both, ["_t", "job_id", "poll_id"], "rank",
                               keys=["_side", *keys])
    job_cols = ["job_id", *[f"job_{k}" for k in KEY if k not in keys], "queue_time"]
    qj = ranked.where(F.col("_side") == 0).select(*keys, "rank", *job_cols)
    pl = ranked.where(F.col("_side") == 1).drop("_side", "_t", *job_cols)
    m = join_on_keys(pl, qj, [*keys, "rank"], "left")
    return m.withColumns({
        "claimed": F.col("job_id").isNotNull(),
        "next_poll_time": next_poll_time(F.col("poll_time"), delay_s),
    })


def claim_fifo(jobs: DataFrame, polls: DataFrame, delay_s: int = WORKER_POLL_DELAY_S
               ) -> DataFrame:
    """D3: the i-th pending job goes to the i-th worker poll; surplus polls get
    no job (not an error: D6).  One row per poll."""
    return _claim(jobs, polls, [], delay_s)


def claim_by_repository(jobs: DataFrame, polls: DataFrame,
                        delay_s: int = WORKER_POLL_DELAY_S) -> DataFrame:
    """D3 inside each repository; polls carry the repository they serve."""
    return _claim(jobs, polls, ["repository"], delay_s)


def mark_running(jobs: DataFrame, claims: DataFrame) -> DataFrame:
    """set status, worker and start time of claimed jobs."""
    c = claims.where(F.col("claimed")).select(
        F.col("job_id").alias("_cid"), F.col("worker_name").alias("_w"),
        F.col("poll_time").alias("_st"))
    j = jobs.join(c, jobs["id"] == c["_cid"], "left")
    hit = F.col("_cid").isNotNull()
    return j.withColumns({
        "status": F.when(hit, F.lit(STATUS_RUNNING)).otherwise(F.col("status")),
        "worker": F.when(hit, F.col("_w")).otherwise(F.col("worker")),
        "start_time": F.when(hit, F.col("_st")).otherwise(F.col("start_time")),
    }).drop("_cid", "_w", "_st")


def claim_interleaved(log: DataFrame, t: str = "t", rid: str = "id", kind: str = "kind",
                      segments: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Enqueues and polls interleaved in time; a poll on an empty queue
    gets nothing and is not remembered.

    Closed form: d = +1 per enqueue, -1 per poll; S = running sum of d;
    M = min(0, min of S strictly before); a poll is empty iff S < M; queue
    length after a row is S - least(M, S); an enqueue has rank E (enqueues so
    far), a served poll rank E - queue length; equal ranks match.
    One row per poll: (poll_id, poll_t, job_id, job_t, rank).  With ``keys``
    (e.g. repository) there is one queue per key.
    """
    enq = F.col(kind) == "enqueue"
    keys = list(keys)
    r = running_sums(log, keys, [t, rid],
                     {"S": F.when(enq, 1).otherwise(-1).cast("bigint"),
                      "E": F.when(enq, 1).otherwise(0).cast("bigint")},
                     min_before={"_mb": "S"}, segments=segments)
    m = F.least(F.coalesce(F.col("_mb"), F.lit(0)), F.lit(0))
    qlen = F.col("S") - F.least(m, F.col("S"))
    served = ~enq & (F.col("S") >= m)
    r = r.withColumn("rank", F.when(enq, F.col("E")).when(served, F.col("E") - qlen))
    polls = r.where(~enq).select(*keys, F.col(rid).alias("poll_id"), F.col(t).alias("poll_t"),
                                 "rank")
    jobs = r.where(enq).select(*keys, F.col(rid).alias("job_id"), F.col(t).alias("job_t"), "rank")
    return polls.join(jobs, [*keys, "rank"], "left").select(
        *keys, "poll_id", "poll_t", "job_id", "job_t", "rank")
