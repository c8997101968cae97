"""Poll answers: the reference's five poll cases, preconditions, time text."""

import datetime as dt

from pyspark.sql import functions as F

from jobtables.functions.naming import repo_basename, result_url, workspace_error
from jobtables.functions.status import poll_columns
from jobtables.functions.timefmt import rfc3339_encode, rfc3339_parse
from jobtables.operators.lookup import poll_bulk, poll_not_found
from jobtables.schema import job_schema

NOW = "2022-05-01 20:20:00"   # 2022-05-01T12:20:00-08:00


def _jobs(spark):
    rows = [
        ("1", "", "", "", "pending", None, dt.datetime(2022, 5, 1), None, None, None, None),
        ("2", "", "", "", "running", None, dt.datetime(2022, 5, 1), None, None, None, None),
        ("3", "", "", "", "failed", None, dt.datetime(2022, 5, 1), None, None, None,
         "some query failure"),
        ("4", "", "", "", "succeeded", None, dt.datetime(2022, 5, 1), None, None,
         "gs://bucket/result.pb", None),
    ]
    return spark.createDataFrame(rows, job_schema())


def test_poll_cases(spark):
    ids = spark.createDataFrame([("1",), ("2",), ("3",), ("4",), ("5",)], "id string")
    got = {r.id: r for r in poll_bulk(ids, _jobs(spark), NOW).collect()}
    five_after = dt.datetime(2022, 5, 1, 20, 20, 5)
    assert got["1"].poll_state == "in_progress" and got["1"].next_poll_time == five_after
    assert got["2"].poll_state == "in_progress" and got["2"].next_poll_time == five_after
    assert got["3"].poll_state == "failure" and got["3"].failure_message == "some query failure"
    assert got["4"].poll_state == "success" and got["4"].results_url == "gs://bucket/result.pb"
    assert got["5"].poll_state == "error" and "job not found" in got["5"].error
    for k in "1234":
        assert got[k].error is None
    nf = [r.id for r in poll_not_found(ids, _jobs(spark)).collect()]
    assert nf == ["5"]


def test_poll_nested_answer_has_one_branch(spark):
    ids = spark.createDataFrame([("1",), ("3",), ("4",)], "id string")
    rows = poll_bulk(ids, _jobs(spark), NOW, nested=True).collect()
    for r in rows:
        a = r.answer
        assert sum(x is not None for x in (a.in_progress, a.success, a.failure)) == 1


def test_preconditions(spark):
    rows = [("a", "succeeded", None, None), ("b", "failed", None, None),
            ("c", "weird", None, None), ("d", "succeeded", "u", None)]
    df = spark.createDataFrame(rows, "id string, status string, result_url string, "
                                     "result_error string")
    got = {r.id: r for r in df.select("id", *[c.alias(n) for n, c in
                                              poll_columns(NOW).items()]).collect()}
    assert got["a"].error == "query succeeded but ResultURL is not set"
    assert got["b"].error == "query failed but ResultError is not set"
    assert got["c"].error == "can't poll job with status: \"weird\""
    assert got["a"].poll_state == got["b"].poll_state == got["c"].poll_state == "error"
    assert got["d"].error is None and got["d"].poll_state == "success"


def test_rfc3339(spark):
    texts = ["2022-05-01T12:20:00-08:00", "2022-05-01T20:20:00Z", "2022-05-01T20:20:00.5Z",
             "2022-05-01T20:20:00", "2022-02-30T00:00:00Z", "2022-05-01T20:20:60Z",
             "2022-05-01 20:20:00Z", None, "2022-05-01T20:20:00.123456789+01:30"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.p for r in df.select(rfc3339_parse("t").alias("p")).collect()]
    assert got[0] == dt.datetime(2022, 5, 1, 20, 20)
    assert got[1] == dt.datetime(2022, 5, 1, 20, 20)
    assert got[2] == dt.datetime(2022, 5, 1, 20, 20, 0, 500000)
    assert got[3:8] == [None] * 5
    assert got[8] == dt.datetime(2022, 5, 1, 18, 50, 0, 123456)
    enc = df.select(rfc3339_encode(rfc3339_parse("t")).alias("e")).collect()
    assert enc[0].e == "2022-05-01T20:20:00Z"


def test_rfc3339_independent_of_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        df = spark.createDataFrame([("2022-05-01T12:20:00-08:00",), ("2024-03-10T02:30:00Z",)],
                                   "t string")
        got = [r[0] for r in df.select(rfc3339_parse("t")).collect()]
        assert got == [dt.datetime(2022, 5, 1, 20, 20), dt.datetime(2024, 3, 10, 2, 30)]
        # 02:30 on that day does not exist in the session zone; the text must not move
        enc = [r[0] for r in df.select(rfc3339_encode(rfc3339_parse("t"))).collect()]
        assert enc == ["2022-05-01T20:20:00Z", "2024-03-10T02:30:00Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_names(spark):
    repos = ["https://github.com/grpc/grpc", "a/b///", "", "///", "x"]
    df = spark.createDataFrame([(r,) for r in repos], "repository string")
    got = [r.b for r in df.select(repo_basename().alias("b")).collect()]
    assert got == ["grpc", "b", ".", "/", "x"]
    r = df.select(workspace_error().alias("e"), result_url("bkt", F.lit("abcd")).alias("u")).first()
    assert r.e == 'workspace for repo "https://github.com/grpc/grpc" not found'
    assert r.u == "gs://bkt/abcd.pb"


def test_strict_poll_raises(spark):
    import pytest
    ids = spark.createDataFrame([("1",), ("5",)], "id string")
    with pytest.raises(Exception, match="job not found"):
        poll_bulk(ids, _jobs(spark), NOW, strict=True).collect()
    ok = spark.createDataFrame([("1",), ("4",)], "id string")
    assert poll_bulk(ok, _jobs(spark), NOW, strict=True).count() == 2
