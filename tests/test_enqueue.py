"""Enqueue resolution (J1, J2, X3) and dedup (E1-E3) against plain folds."""

import datetime as dt
import random
from collections import deque

from pyspark.sql import functions as F

from jobtables.operators.dedup import (
    dedup_first,
    dedup_generations,
    dedup_strict,
    enqueue_new_jobs,
    enqueue_resolve,
)
from jobtables.operators.lookup import cached_results
from jobtables.schema import job_schema

T0 = dt.datetime(2022, 5, 1, 20, 0, 0)
REQ = "request_id long, repository string, commit_hash string, query_string string, " \
      "request_time timestamp_ntz"


def _job(i, key, status, url=None, err=None):
    return (i, *key, status, None, T0, None, None, url, err)


def test_empty_request_is_accepted(spark):
    reqs = spark.createDataFrame([(1, "", "", "", T0)], REQ)
    jobs = spark.createDataFrame([], job_schema())
    out = enqueue_resolve(reqs, jobs).collect()
    assert len(out) == 1 and out[0].created and len(out[0].job_id) == 64


def test_share_live_job_ignore_failed(spark):
    key = ("https://github.com/grpc/grpc", "foobar", "deps(//...)")
    jobs = spark.createDataFrame([_job("old", key, "failed", err="x"),
                                  _job("live", key, "running")], job_schema())
    reqs = spark.createDataFrame([(1, *key, T0), (2, *key, T0)], REQ)
    out = {r.request_id: r for r in enqueue_resolve(reqs, jobs).collect()}
    assert out[1].job_id == out[2].job_id == "live"
    assert not out[1].created and not out[2].created
    assert enqueue_new_jobs(reqs, jobs).count() == 0


def test_batch_first_request_creates(spark):
    key = ("r", "c", "q")
    jobs = spark.createDataFrame([_job("f", key, "failed", err="x")], job_schema())
    reqs = spark.createDataFrame([(5, *key, T0 + dt.timedelta(seconds=1)), (7, *key, T0),
                                  (6, *key, T0)], REQ)
    out = {r.request_id: r for r in enqueue_resolve(reqs, jobs).collect()}
    assert out[6].created and not out[7].created and not out[5].created
    assert len({r.job_id for r in out.values()}) == 1
    new = enqueue_new_jobs(reqs, jobs).collect()
    assert len(new) == 1 and new[0].id == out[6].job_id and new[0].queue_time == T0
    # deterministic: the same input gives the same id
    assert enqueue_resolve(reqs, jobs).where("created").first().job_id == out[6].job_id


def test_ids_do_not_collide_on_separators(spark):
    reqs = spark.createDataFrame([(1, "a:", "b", "q", T0), (2, "a", ":b", "q", T0)], REQ)
    jobs = spark.createDataFrame([], job_schema())
    ids = {r.job_id for r in enqueue_resolve(reqs, jobs).collect()}
    assert len(ids) == 2


def test_stress_enqueue_twice_makes_1000_jobs(spark):
    base = spark.range(1000).select(
        F.col("id").alias("request_id"), F.lit("https://github.com/grpc/grpc").alias("repository"),
        F.col("id").cast("string").alias("commit_hash"), F.lit("deps(//...)").alias("query_string"),
        F.lit(T0).cast("timestamp_ntz").alias("request_time"))
    twice = base.unionByName(base.withColumn("request_id", F.col("request_id") + 1000))
    jobs = spark.createDataFrame([], job_schema())
    out = enqueue_resolve(twice, jobs)
    assert out.select("job_id").distinct().count() == 1000
    assert out.where("created").count() == 1000
    assert enqueue_new_jobs(twice, jobs).count() == 1000


def test_cached_results(spark):
    jobs = spark.createDataFrame([_job("s", ("r", "c", "q"), "succeeded", url="gs://b/s.pb"),
                                  _job("p", ("r", "c", "q2"), "pending")], job_schema())
    reqs = spark.createDataFrame([(1, "r", "c", "q", T0), (2, "r", "c", "q2", T0)], REQ)
    out = cached_results(reqs, jobs).collect()
    assert [(r.request_id, r.job_id, r.result_url) for r in out] == [(1, "s", "gs://b/s.pb")]


def test_dedup_first(spark):
    reqs = spark.createDataFrame([(3, "r", "c", "q", T0), (1, "r", "c", "q", T0),
                                  (2, "r", "c", "q", T0 - dt.timedelta(seconds=1))], REQ)
    r = dedup_first(reqs).first()
    assert r.request_id == 2 and r.n_requests == 3


# -- E2 / E3 against a plain fold --------------------------------------------

def fold_generations(rows, strict=False):
    """rows: (id, key, t, kind, target).  Returns {request id: (job_id, created)}."""
    cur, out = {}, {}
    for i, k, t, kind, target in sorted(rows, key=lambda r: (r[2], r[0])):
        if kind == "request":
            if cur.get(k) is None:
                cur[k] = i
                out[i] = (i, True)
            else:
                out[i] = (cur[k], False)
        elif kind == "fail":
            if not strict or cur.get(k) == target:
                cur[k] = None
    return out


def _random_log(rng, n, keys, strict=False, hot=False):
    rows = []
    reqs_so_far = []
    for i in range(n):
        k = 0 if hot and rng.random() < 0.4 else rng.randrange(keys)
        t = T0 + dt.timedelta(seconds=rng.randrange(n // 2 + 1))   # time ties on purpose
        kind = rng.choice(["request", "request", "request", "fail", "succeed"])
        target = rng.choice(reqs_so_far) if (strict and reqs_so_far) else None
        rows.append((i, k, t, kind, target))
        if kind == "request":
            reqs_so_far.append(i)
    return rows


LOG = "id long, k long, t timestamp_ntz, kind string, target long"


def test_dedup_generations_matches_fold(spark):
    rng = random.Random(7)
    for trial in range(3):
        rows = _random_log(rng, 400, 6, hot=(trial == 2))
        df = spark.createDataFrame(rows, LOG)
        got = {r.id: (r.job_id, r.created)
               for r in dedup_generations(df, ["k"], segments=5).collect()}
        assert got == fold_generations(rows)


def test_dedup_strict_matches_fold(spark):
    rng = random.Random(11)
    for trial in range(2):
        rows = _random_log(rng, 300, 4, strict=True, hot=(trial == 1))
        # failures name either a request of their own key or a stale one
        df = spark.createDataFrame(rows, LOG)
        got = {r.id: (r.job_id, r.created) for r in dedup_strict(df, ["k"]).collect()}
        assert got == fold_generations(rows, strict=True)


def test_strict_equals_plain_when_failures_are_current(spark):
    # request, fail (of it), request, succeed, request -> 2 jobs
    rows = [(1, 0, T0, "request", None), (2, 0, T0 + dt.timedelta(seconds=1), "fail", 1),
            (3, 0, T0 + dt.timedelta(seconds=2), "request", None),
            (4, 0, T0 + dt.timedelta(seconds=3), "succeed", None),
            (5, 0, T0 + dt.timedelta(seconds=4), "request", None)]
    df = spark.createDataFrame(rows, LOG)
    a = {r.id: (r.job_id, r.created) for r in dedup_generations(df, ["k"]).collect()}
    b = {r.id: (r.job_id, r.created) for r in dedup_strict(df, ["k"]).collect()}
    assert a == b == {1: (1, True), 3: (3, True), 5: (3, False)}
