"""Finishes (U1-U3), the life-cycle fold (U4) and the audits."""

import datetime as dt

from jobtables.operators import audit
from jobtables.operators.update import (
    apply_finishes,
    finish_outcomes,
    job_events,
    job_state_fold,
    rejected_finishes,
)
from jobtables.schema import job_schema

T0 = dt.datetime(2022, 5, 1, 20, 0, 0)
FIN = ("finish_id long, job_id string, query_result_location string, failure_message string, "
       "finish_ts timestamp_ntz")


def _running(i, key=("r", "c", "q")):
    return (i, *key, "running", "w", T0, T0, None, None, None)


def _s(n):
    return T0 + dt.timedelta(seconds=n)


def test_finish_cases(spark):
    jobs = spark.createDataFrame([_running("a"), _running("b"), _running("c"), _running("d")],
                                 job_schema())
    fins = spark.createDataFrame([
        (1, "a", "gs://x/a.pb", None, _s(1)),             # success
        (2, "b", None, "bad", _s(1)),                     # failure
        (3, "c", None, None, _s(1)),                      # neither: no change, OK
        (4, "d", "gs://x/d.pb", None, _s(1)),             # success then failure:
        (5, "d", None, "late failure", _s(2)),            # both columns set, status failed
        (6, "zz", "gs://x/zz.pb", None, _s(1)),           # unknown id: refused
        (7, "zz", None, None, _s(1)),                     # unknown id, unset: never stored
    ], FIN)
    got = {r.id: r for r in apply_finishes(jobs, fins).collect()}
    assert (got["a"].status, got["a"].result_url, got["a"].finish_time) == \
        ("succeeded", "gs://x/a.pb", _s(1))
    assert (got["b"].status, got["b"].result_error) == ("failed", "bad")
    assert (got["c"].status, got["c"].finish_time) == ("running", None)
    assert (got["d"].status, got["d"].result_url, got["d"].result_error, got["d"].finish_time) \
        == ("failed", "gs://x/d.pb", "late failure", _s(2))
    rej = [(r.finish_id, r.reason) for r in rejected_finishes(jobs, fins).collect()]
    assert rej == [(6, "job not found")]
    out = {r.finish_id: r for r in finish_outcomes(fins).collect()}
    assert out[3].unset and out[1].status == "succeeded" and out[2].result == "bad"


def test_strict_finish(spark):
    jobs = spark.createDataFrame(
        [_running("a"), ("p", "r", "c", "q2", "pending", None, T0, None, None, None, None)],
        job_schema())
    fins = spark.createDataFrame([(1, "a", "gs://x/a.pb", None, _s(1)),
                                  (2, "a", None, "second", _s(2)),
                                  (3, "p", "gs://x/p.pb", None, _s(1))], FIN)
    got = {r.id: r for r in apply_finishes(jobs, fins, strict=True).collect()}
    assert (got["a"].status, got["a"].result_url, got["a"].result_error) == \
        ("succeeded", "gs://x/a.pb", None)
    assert got["p"].status == "pending"
    rej = {r.finish_id: r.reason for r in rejected_finishes(jobs, fins, strict=True).collect()}
    assert rej == {2: "job is finished already", 3: "job is not running"}


def test_ids_of_several_rows_are_refused_and_not_applied(spark):
    jobs = spark.createDataFrame([_running("a"), _running("a"), _running("b")], job_schema())
    fins = spark.createDataFrame([(1, "a", "gs://x/a.pb", None, _s(1)),
                                  (2, "b", "gs://x/b.pb", None, _s(1))], FIN)
    for strict in (False, True):
        got = apply_finishes(jobs, fins, strict=strict).collect()
        assert sorted((r.id, r.status) for r in got) == \
            [("a", "running"), ("a", "running"), ("b", "succeeded")]
        rej = rejected_finishes(jobs, fins, strict=strict).collect()
        assert [(r.finish_id, r.reason) for r in rej] == [(1, "more than one job with this id")]


def test_reuse_rate_of_no_requests(spark):
    empty = spark.createDataFrame([], "created boolean, job_id string")
    assert audit.reuse_rate(empty).first().reuse_rate is None


def test_fold_round_trip(spark):
    jobs = spark.createDataFrame([
        ("a", "r", "c", "q", "pending", None, T0, None, None, None, None),
        ("b", "r", "c", "q", "running", "w", T0, T0, None, None, None),    # start == queue time
        ("c", "r", "c", "q", "succeeded", "w", T0, _s(1), _s(2), "u", None),
        ("d", "r", "c", "q", "failed", "w", T0, _s(1), _s(2), None, None),
    ], job_schema())
    back = {r.id: r.asDict() for r in job_state_fold(job_events(jobs)).collect()}
    for r in jobs.collect():
        assert back[r.id] == r.asDict()


def test_audits(spark):
    jobs = spark.createDataFrame([
        ("a", "r", "c", "q", "running", "w1", T0, T0, None, None, None),
        ("b", "r", "c", "q", "succeeded", "w1", T0, T0, _s(5), None, None),   # live twice; no url
        ("a", "r", "c", "q2", "failed", "w2", T0, T0, _s(9), None, "e"),    # id twice
    ], job_schema())
    assert [(r.n_live) for r in audit.audit_live_key(jobs).collect()] == [2]
    assert [(r.id, r.n_rows) for r in audit.audit_job_id(jobs).collect()] == [("a", 2)]
    w = {r.worker: r for r in audit.audit_workers(jobs).collect()}
    assert (w["w1"].n_running, w["w1"].n_succeeded, w["w2"].n_failed) == (1, 1, 1)
    stuck = audit.audit_stuck(jobs, "2022-05-01 20:10:00", 300).collect()
    assert [(r.id, r.running_s) for r in stuck] == [("a", 600)]
    cols = {r.rule: r.n_jobs for r in audit.audit_columns(jobs).collect()}
    assert cols == {"succeeded: result_url missing": 1}
    t = audit.wait_run_times(jobs).first()
    assert (t.n_jobs, t.max_run_s) == (3, 9.0)
    q = audit.wait_run_percentiles(jobs).first()
    assert (q.p50_wait_s, q.p50_run_s, q.p99_run_s) == (0.0, 5.0, 9.0)
