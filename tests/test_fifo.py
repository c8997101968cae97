"""FIFO claiming (D1-D6) against a plain queue, and the dispatch cases."""

import datetime as dt
import random
from collections import defaultdict, deque

from pyspark.sql import functions as F

from jobtables.operators.fifo import (
    claim_by_repository,
    claim_fifo,
    claim_interleaved,
    mark_running,
    next_job,
    next_k_jobs,
)
from jobtables.operators.lookup import job_view
from jobtables.schema import job_schema

T0 = dt.datetime(2022, 5, 1, 20, 20, 0)   # 2022-05-01T12:20:00-08:00
POLL = "poll_id long, worker_name string, repository string, poll_time timestamp_ntz"


def _pending(i, repo, t, commit="c", query="deps(//...)"):
    return (i, repo, commit, query, "pending", None, t, None, None, None, None)


def test_dispatch_one_job(spark):
    jobs = spark.createDataFrame(
        [_pending("abcd", "https://github.com/grpc/grpc", T0, "foobar")], job_schema())
    polls = spark.createDataFrame([(1, "worker-1", "", T0)], POLL)
    r = claim_fifo(jobs, polls).first()
    assert r.job_id == "abcd" and r.claimed
    assert r.next_poll_time == T0 + dt.timedelta(seconds=10)
    v = job_view(jobs).first()
    assert (v.id, v.query, v.source.repo, v.source.committish) == \
        ("abcd", "deps(//...)", "https://github.com/grpc/grpc", "foobar")
    after = mark_running(jobs, claim_fifo(jobs, polls)).first()
    assert (after.status, after.worker, after.start_time) == ("running", "worker-1", T0)


def test_dispatch_empty_queue_is_not_an_error(spark):
    jobs = spark.createDataFrame([], job_schema())
    polls = spark.createDataFrame([(1, "worker-1", "", T0)], POLL)
    r = claim_fifo(jobs, polls).first()
    assert r.job_id is None and not r.claimed
    assert r.next_poll_time == T0 + dt.timedelta(seconds=10)
    assert next_job(jobs).count() == 0


def test_stress_1000_jobs_1001_polls(spark):
    jobs = spark.range(1000).select(
        F.col("id").cast("string").alias("id"),
        F.lit("https://github.com/grpc/grpc").alias("repository"),
        F.col("id").cast("string").alias("commit_hash"), F.lit("deps(//...)").alias("query_string"),
        F.lit("pending").alias("status"), F.lit(None).cast("string").alias("worker"),
        F.lit(T0).cast("timestamp_ntz").alias("queue_time"),   # all in one second
        F.lit(None).cast("timestamp_ntz").alias("start_time"),
        F.lit(None).cast("timestamp_ntz").alias("finish_time"),
        F.lit(None).cast("string").alias("result_url"),
        F.lit(None).cast("string").alias("result_error"))
    polls = spark.range(1001).select(
        F.col("id").alias("poll_id"), F.concat(F.lit("worker-"), (F.col("id") % 10).cast("string"))
        .alias("worker_name"), F.lit("").alias("repository"),
        (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0),
                                                               F.col("id").cast("int")))
        .alias("poll_time"))
    c = claim_fifo(jobs, polls, ).cache()
    assert c.count() == 1001
    assert c.where("claimed").select("job_id").distinct().count() == 1000
    last = c.where("poll_id = 1000").first()
    assert last.job_id is None
    # ties in queue_time are broken by id: poll 0 gets the smallest id
    assert c.where("poll_id = 0").first().job_id == "0"
    assert next_k_jobs(jobs, 3).select("id").collect() == [("0",), ("1",), ("10",)]


def queue_fold(rows):
    """rows: (id, t, kind).  Returns {poll id: job id or None}."""
    q, out = deque(), {}
    for i, t, kind in sorted(rows, key=lambda r: (r[1], r[0])):
        if kind == "enqueue":
            q.append(i)
        else:
            out[i] = q.popleft() if q else None
    return out


def test_claim_interleaved_matches_queue(spark):
    rng = random.Random(3)
    for p_enq in (0.5, 0.3, 0.7):
        rows = []
        for i in range(500):
            t = T0 + dt.timedelta(seconds=rng.randrange(150))   # many ties in time
            rows.append((i, t, "enqueue" if rng.random() < p_enq else "poll"))
        df = spark.createDataFrame(rows, "id long, t timestamp_ntz, kind string")
        got = {r.poll_id: r.job_id for r in claim_interleaved(df, segments=6).collect()}
        assert got == queue_fold(rows)


def test_claim_by_repository_matches_queue(spark):
    rng = random.Random(5)
    jobs, polls = [], []
    for i in range(300):
        repo = "hot" if rng.random() < 0.5 else f"r{rng.randrange(5)}"
        jobs.append(_pending(f"j{i:04d}", repo, T0 + dt.timedelta(seconds=rng.randrange(40))))
    for i in range(300):
        repo = "hot" if rng.random() < 0.5 else f"r{rng.randrange(5)}"
        polls.append((i, "w", repo, T0 + dt.timedelta(seconds=100 + rng.randrange(40))))
    got = {r.poll_id: r.job_id for r in claim_by_repository(
        spark.createDataFrame(jobs, job_schema()), spark.createDataFrame(polls, POLL)).collect()}
    queues = defaultdict(deque)
    for j in sorted(jobs, key=lambda r: (r[6], r[0])):
        queues[j[1]].append(j[0])
    want = {}
    for p in sorted(polls, key=lambda r: (r[3], r[0])):
        want[p[0]] = queues[p[2]].popleft() if queues[p[2]] else None
    assert got == want
