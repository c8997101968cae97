"""Sources and sinks (S1-S6): dumps round-trip, quarantine, results table."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from jobtables import fixtures as fx
from jobtables.sources.jobs import decode_jobs, quarantine_jobs, read_jobs
from jobtables.sources.sinks import encode_jobs, result_rows, write_events, write_results
from jobtables.operators.update import job_events


def _tmp():
    return tempfile.mkdtemp(prefix="jt-io-", dir="/tmp")


def test_dump_round_trip_through_files(spark):
    jobs = fx.jobs_v(spark, SF001)
    d = _tmp()
    for fmt in ("json", "csv", "parquet"):
        opts = {"header": "true"} if fmt == "csv" else {}
        encode_jobs(jobs).write.format(fmt).options(**opts).save(f"{d}/{fmt}")
        back = read_jobs(spark, f"{d}/{fmt}", fmt=fmt, **opts)
        want = jobs.withColumn("id", F.col("id").cast("string"))
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect())), fmt


def test_strict_decode_raises_and_quarantine_splits(spark):
    rows = [("1", "r", "c", "q", "pending", None, "2022-05-01T12:20:00-08:00", None, None,
             None, None),
            ("2", "r", "c", "q", "pending", None, "2022-05-01T20:20:00", None, None,
             None, None)]
    from jobtables.schema import TEXT_DUMP_SCHEMA
    dump = spark.createDataFrame(rows, TEXT_DUMP_SCHEMA)
    with pytest.raises(Exception, match="failed to parse queue_time"):
        decode_jobs(dump).collect()
    good, bad = quarantine_jobs(dump)
    assert [(r.id, r.queue_time) for r in good.collect()] == [("1", dt.datetime(2022, 5, 1, 20, 20))]
    assert [(r.id, r.column, r.value) for r in bad.collect()] == \
        [("2", "queue_time", "2022-05-01T20:20:00")]


def test_event_log_and_results_table(spark):
    d = _tmp()
    ev = job_events(fx.jobs_v(spark, SF001))
    write_events(ev, f"{d}/events")
    back = spark.read.parquet(f"{d}/events")
    assert back.count() == ev.count()
    assert "event_date" in back.columns
    res = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "job_id long, node string")
    write_results(res, f"{d}/results", "bkt", buckets=4)
    r = spark.read.parquet(f"{d}/results")
    assert r.count() == 3
    urls = {x.job_id: x.result_url for x in r.collect()}
    assert urls == {1: "gs://bkt/1.pb", 2: "gs://bkt/2.pb"}
    # all rows of a job share one bucket folder
    assert r.groupBy("job_id").agg(F.countDistinct("bucket").alias("n")).where("n > 1").count() == 0
    assert set(result_rows(res, "bkt").columns) >= {"result_url", "bucket"}
    # another batch leaves the first one's results; the same batch replaces its own
    more = spark.createDataFrame([(3, "d")], "job_id long, node string")
    for _ in range(2):
        write_results(more, f"{d}/results", "bkt", buckets=4, batch="1")
    assert sorted(x.job_id for x in spark.read.parquet(f"{d}/results").collect()) == [1, 1, 2, 3]


def test_event_files_are_bounded_per_date(spark):
    import glob
    d = _tmp()
    ev = job_events(fx.jobs_v(spark, SF001)).repartition(16)
    write_events(ev, f"{d}/events", files_per_date=2)
    dates = glob.glob(f"{d}/events/event_date=*")
    assert dates and all(len(glob.glob(f"{x}/*.parquet")) <= 2 for x in dates)


def test_lower_case_marks_are_refused(spark):
    from jobtables.functions.timefmt import rfc3339_parse
    texts = ["2022-05-01T20:20:00Z", "2022-05-01t20:20:00Z", "2022-05-01T20:20:00z",
             "2022-05-01T20:20:00.123456789+01:30", "2022-02-30T00:00:00Z", "2022-05-01 20:20:00Z",
             "2022-05-01T20:20:00", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string") \
        .select("i", rfc3339_parse("t").alias("v")).orderBy("i").collect()
    good = dt.datetime(2022, 5, 1, 20, 20)
    part = dt.datetime(2022, 5, 1, 18, 50, 0, 123456)
    assert [r.v for r in rows] == [good, None, None, part, None, None, None, None]


def test_read_dump_names_every_defect(spark, tmp_path):
    from jobtables.sources.jobs import read_dump
    sound = ('{"id":"a","repository":"r","commit_hash":"","query_string":"q","status":"pending",'
             '"queue_time":"2022-05-01T12:20:00-08:00"}')
    lines = [sound, "", sound[:40], "not json", sound.replace('"status":"pending",', ""),
             sound.replace("-08:00", ""), '{"id":"b","queue_time":"x","start_time":"y"}', sound.replace('"a"', "null")]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{tmp_path}/j")
    good, bad = read_dump(spark, f"{tmp_path}/j")
    assert [(r.id, r.commit_hash, str(r.queue_time)) for r in good.collect()] == [("a", "", "2022-05-01 20:20:00")]
    got = sorted(((r.id, r.reason, r.column) for r in bad.collect()), key=str)
    assert got == sorted([
        (None, "malformed record", None), (None, "malformed record", None), ("a", "missing value", "status"),
        ("a", "bad time", "queue_time"), (None, "missing value", "id"),
        *[("b", "missing value", c) for c in ("repository", "commit_hash", "query_string", "status")],
        ("b", "bad time", "queue_time"), ("b", "bad time", "start_time")], key=str)
    assert {r.record for r in bad.collect()} <= set(lines)
    csv = ["a,r,c,q,pending,,2022-05-01T12:20:00Z,,,,", "b,r,c,q,pending,,2022-05-01 12:20,,,,", "c,r"]
    spark.createDataFrame([(x,) for x in csv], "value string").coalesce(1).write.text(f"{tmp_path}/c")
    good, bad = read_dump(spark, f"{tmp_path}/c", "csv")
    assert [r.id for r in good.collect()] == ["a"]
    reasons = {(r.record, r.reason) for r in bad.collect()}
    assert (csv[1], "bad time") in reasons and (csv[2], "malformed record") in reasons


def test_read_dump_parses_a_line_once(spark, tmp_path):
    """Filters and columns read what was parsed; they do not parse again."""
    from jobtables.sources.jobs import read_dump
    spark.createDataFrame([('{"id":"a"}',)], "value string").write.text(f"{tmp_path}/j")
    for side in read_dump(spark, f"{tmp_path}/j"):
        plan = side._jdf.queryExecution().executedPlan().toString()
        assert plan.count("from_json(") == 1
        assert plan.count("RLIKE(") <= 3
