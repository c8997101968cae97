"""Streaming operators: each stream equals its batch twin, over >= 2
micro-batches and a restart from the checkpoint."""

import datetime as dt
import random
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF001
from jobtables import fixtures as fx
from jobtables.operators.dedup import dedup_generations, enqueue_resolve
from jobtables.operators.fifo import claim_interleaved
from jobtables.operators.update import job_state_fold
from jobtables.sources.sinks import write_events
from jobtables.streaming.claims import ClaimRanks, match_claim_ranks, start_claim_stream
from jobtables.streaming.enqueue import enqueue_batch, start_enqueue_stream
from jobtables.streaming.job_state import JobState, start_job_stream, stream_rows
from jobtables.streaming.resent import ResentFilter, start_resent_stream
from jobtables.streaming.stateful import (
    dedup_stream,
    drop_resent,
    job_state_stream,
    stuck_alarm_stream,
)


def _tmp():
    return tempfile.mkdtemp(prefix="jt-stream-", dir="/tmp")


def _split_write(df, folder, time_col, n_files):
    """Write ``df`` as ``n_files`` parquet files, split on time so that file
    order is time order."""
    w = df.withColumn("_b", F.ntile(n_files).over(Window.orderBy(time_col)))
    for i in range(1, n_files + 1):
        w.where(F.col("_b") == i).drop("_b").coalesce(1).write.parquet(f"{folder}/part{i:03d}")
    return [f"{folder}/part{i:03d}" for i in range(1, n_files + 1)]


def _land(spark, src_parts, land, upto):
    for p in src_parts[:upto]:
        name = p.rsplit("/", 1)[1]
        spark.read.parquet(p).coalesce(1).write.mode("ignore").parquet(f"{land}/{name}")


def _run(q):
    q.processAllAvailable()
    q.stop()


def test_t1_dedup_stream_equals_batch(spark):
    log = fx.dedup_log(spark, SF001)
    d = _tmp()
    parts = _split_write(log, f"{d}/src", "t", 3)
    land, out, ck = f"{d}/land", f"{d}/out", f"{d}/ck"
    _land(spark, parts, land, 2)
    src = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1) \
        .parquet(f"{land}/*")
    q = dedup_stream(src, ["user_id"]).writeStream.format("parquet") \
        .option("path", out).option("checkpointLocation", ck).start()
    _run(q)
    # restart from the checkpoint with one more file
    _land(spark, parts, land, 3)
    src = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1) \
        .parquet(f"{land}/*")
    q = dedup_stream(src, ["user_id"]).writeStream.format("parquet") \
        .option("path", out).option("checkpointLocation", ck).start()
    _run(q)
    got = {(r.id, r.job_id, r.created) for r in spark.read.parquet(out).collect()}
    want = {(r.id, r.job_id, r.created) for r in dedup_generations(log, ["user_id"]).collect()}
    assert got == want and len(got) == log.where("kind = 'request'").count()


def test_t2_state_stream_equals_batch(spark):
    ev = fx.job_log_v(spark, SF001)
    d = _tmp()
    ev.coalesce(1).write.parquet(f"{d}/src")
    # two files: split by kind so the second batch updates the first's jobs
    e = spark.read.parquet(f"{d}/src")
    e.where("kind IN ('request', 'start')").write.parquet(f"{d}/land/a")
    e.where("kind NOT IN ('request', 'start')").write.parquet(f"{d}/land/b")
    src = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/land/*")
    q = job_state_stream(src).writeStream.outputMode("update").foreachBatch(
        lambda df, i: df.write.mode("overwrite").parquet(f"{d}/out/batch={i}")).start()
    _run(q)
    out = spark.read.parquet(f"{d}/out")
    assert out.where("batch = 1").count() < out.where("batch = 0").count()  # only what changed
    cols = [c for c in out.columns if c != "batch"]
    got = {tuple(r.s) for r in out.groupBy("id").agg(F.max_by(F.struct(*cols), "batch").alias("s")).collect()}
    want = {tuple(r) for r in job_state_fold(ev).collect()}
    assert got == want


def test_t3_drop_resent(spark):
    d = _tmp()
    t0 = dt.datetime(2024, 1, 1)
    sch = "event_id long, ts timestamp_ntz, v string"
    batches = [
        [(1, t0, "a"), (2, t0, "b"), (3, t0 + dt.timedelta(minutes=1), "c")],
        [(3, t0 + dt.timedelta(minutes=1), "c"), (4, t0 + dt.timedelta(minutes=2), "d")],
        [(9, t0 + dt.timedelta(hours=3), "late-mark")],
        [(1, t0, "a")],   # re-sent long after the watermark passed: late, dropped
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, sch).coalesce(1).write.parquet(f"{d}/land/p{i}")
    src = spark.readStream.schema(sch).option("maxFilesPerTrigger", 1).parquet(f"{d}/land/*")
    q = drop_resent(src, "event_id", "ts", "10 minutes").writeStream.format("memory") \
        .queryName("t3_out").start()
    _run(q)
    ids = sorted(r.event_id for r in spark.table("t3_out").collect())
    assert ids == [1, 2, 3, 4, 9]


def test_t4_enqueue_stream_and_replay(spark):
    reqs = fx.requests_v(spark, SF001)
    d = _tmp()
    fx.jobs_v(spark, SF001).write.parquet(f"{d}/jobs_base")
    parts = _split_write(reqs, f"{d}/src", "request_time", 2)
    _land(spark, parts, f"{d}/land", 2)
    src = spark.readStream.schema(reqs.schema).option("maxFilesPerTrigger", 1) \
        .parquet(f"{d}/land/*")
    q = start_enqueue_stream(src, f"{d}/jobs_base", f"{d}/out", f"{d}/ck")
    _run(q)
    got = spark.read.parquet(f"{d}/out/resolved")
    assert got.select("batch").distinct().count() == 2
    # the snapshot holds ids as text (the model's type), so "lowest live id"
    # compares text on both sides
    want = enqueue_resolve(reqs, fx.jobs_v(spark, SF001).withColumn("id", F.col("id").cast("string")))
    cols = ["request_id", "job_id", "created"]
    first = [tuple(r) for r in got.select(*cols).collect()]
    assert set(first) == {tuple(r) for r in want.select(*cols).collect()}
    assert len(first) == reqs.count()
    # replaying batch 1 rewrites the same rows, nothing twice
    b1 = spark.read.parquet(parts[1])
    enqueue_batch(b1, 1, f"{d}/jobs_base", f"{d}/out")
    again = [tuple(r) for r in spark.read.parquet(f"{d}/out/resolved").select(*cols).collect()]
    assert sorted(again) == sorted(first)


def test_t5_stuck_alarm_fires_once(spark):
    d = _tmp()
    t0 = dt.datetime(2024, 1, 1)
    sch = "job_id long, kind string, ts timestamp_ntz, worker string"
    batches = [
        [(1, "start", t0, "w1"), (2, "start", t0, "w2")],
        [(2, "succeed", t0 + dt.timedelta(minutes=1), None)],
        [(3, "request", t0 + dt.timedelta(hours=1), None)],
        [(4, "request", t0 + dt.timedelta(hours=2), None)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, sch).coalesce(1).write.parquet(f"{d}/land/p{i}")
    src = spark.readStream.schema(sch).option("maxFilesPerTrigger", 1).parquet(f"{d}/land/*")
    q = stuck_alarm_stream(src, 5 * 60 * 1000, "0 seconds").writeStream.format("memory") \
        .queryName("t5_out").start()
    _run(q)
    rows = spark.table("t5_out").collect()
    assert [(r.job_id, r.worker, r.start_time) for r in rows] == [(1, "w1", t0)]


def test_t6_claim_ranks_stream_equals_batch(spark):
    """Half of the log is one repository; stopped and started again, and the
    last batch replayed."""
    e = fx.table(spark, SF001, "events").where(
        F.col("event_type").isin("click", "view", "purchase", "error"))
    log = e.select(F.when(F.col("event_id") % 2 == 0, "hot").otherwise(
                       F.concat(F.lit("repo/"), (F.col("user_id") % 5).cast("string")))
                   .alias("repository"), F.col("event_id").alias("id"), F.col("ts").alias("t"),
                   F.when(F.col("event_type").isin("click", "view"), "enqueue")
                   .otherwise("poll").alias("kind"))
    d = _tmp()
    parts = _split_write(log, f"{d}/src", "t", 3)
    ranks = ClaimRanks(spark, f"{d}/state")
    for upto in (2, 3):
        _land(spark, parts, f"{d}/land", upto)
        src = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1) \
            .parquet(f"{d}/land/*")
        start_claim_stream(src, ranks, f"{d}/out", f"{d}/ck", available_now=True).awaitTermination()
    ranks.apply(spark.read.parquet(parts[2]), 2, f"{d}/out/ranks/batch=2")
    got = {(r.poll_id, r.job_id)
           for r in match_claim_ranks(spark.read.parquet(f"{d}/out/ranks")).collect()}
    want = {(r.poll_id, r.job_id)
            for r in claim_interleaved(log, keys=["repository"]).collect()}
    assert got == want


def test_t1_state_ttl(spark):
    """A TTL longer than the log changes nothing; a short one re-opens jobs
    for keys that went quiet (documented: it changes results)."""
    t0 = dt.datetime(2024, 1, 1)
    sch = "id long, user_id long, t timestamp_ntz, kind string"
    batches = [[(1, 7, t0, "request"), (2, 8, t0, "request")],
               [(3, 8, t0 + dt.timedelta(hours=5), "request")],
               [(4, 7, t0 + dt.timedelta(hours=10), "request")]]
    for ttl_h, want in ((100, {1: 1, 2: 2, 3: 2, 4: 1}), (2, {1: 1, 2: 2, 3: 3, 4: 4})):
        d = _tmp()
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, sch).coalesce(1).write.parquet(f"{d}/land/p{i}")
        src = spark.readStream.schema(sch).option("maxFilesPerTrigger", 1) \
            .parquet(f"{d}/land/*")
        q = dedup_stream(src, ["user_id"], state_ttl_ms=ttl_h * 3600 * 1000,
                         delay="0 seconds").writeStream \
            .format("memory").queryName(f"t1_ttl_{ttl_h}").start()
        _run(q)
        got = {r.id: r.job_id for r in spark.table(f"t1_ttl_{ttl_h}").collect()}
        assert got == want, (ttl_h, got)


def _batches(spark, rows_by_batch, schema):
    """A file stream with one micro-batch per list of rows."""
    d = _tmp()
    for i, rows in enumerate(rows_by_batch):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/land/p{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/land/*")


def test_t1_ttl_answers_late_rows_within_the_delay(spark):
    t0 = dt.datetime(2024, 1, 1)
    src = _batches(spark, [[(1, 7, t0, "request")], [(2, 8, t0 + dt.timedelta(hours=4), "request")],
                           [(3, 9, t0 + dt.timedelta(hours=2), "request")]],
                   "id long, user_id long, t timestamp_ntz, kind string")
    with pytest.raises(ValueError, match="delay"):
        dedup_stream(src, ["user_id"], state_ttl_ms=1000)
    q = dedup_stream(src, ["user_id"], state_ttl_ms=11 * 86400 * 1000, delay="3 hours").writeStream \
        .format("memory").queryName("t1_late").start()
    _run(q)
    assert {r.id: r.job_id for r in spark.table("t1_late").collect()} == {1: 1, 2: 2, 3: 3}


EVENTS = "job_id long, kind string, ts timestamp_ntz, worker string"


def _alarms(spark, name, batches, delay):
    src = _batches(spark, batches, EVENTS)
    q = stuck_alarm_stream(src, 5 * 60 * 1000, delay).writeStream.format("memory") \
        .queryName(name).start()
    _run(q)
    return sorted((r.job_id, r.worker, r.start_time) for r in spark.table(name).collect())


def test_t5_resent_event_past_the_limit(spark):
    t0, h = dt.datetime(2024, 1, 1), dt.timedelta(hours=1)
    got = _alarms(spark, "t5_resent", [
        [(1, "start", t0, "w1")], [(2, "start", t0 + h, "w2")], [(1, "start", t0, "w1")],
        [(3, "request", t0 + 3 * h, None)], [(4, "start", t0 + 4 * h, "w")],
        [(5, "start", t0 + 5 * h, "w")]], "0 seconds")
    assert [g for g in got if g[0] < 4] == [(1, "w1", t0), (2, "w2", t0 + h)]


def test_t5_finish_before_its_start_and_late_finish(spark):
    t0, m = dt.datetime(2024, 1, 1), dt.timedelta(minutes=1)
    got = _alarms(spark, "t5_order", [
        [(1, "succeed", t0 + 2 * m, None), (9, "start", t0 + 30 * m, "w")],
        [(1, "start", t0, "w1"), (2, "start", t0, "w2"), (2, "start", t0 + 3 * m, "w9")],
        [(2, "fail", t0 + 6 * m, None), (9, "succeed", t0 + 31 * m, None)],
        [(8, "start", t0 + 300 * m, "w")], [(8, "succeed", t0 + 301 * m, None)]], "60 minutes")
    assert got == [(2, "w2", t0)]


def test_t5_holds_many_jobs_in_few_states(spark):
    """Jobs are handled by buckets: no state, timer or call of its own per job."""
    rng, t0, m = random.Random(5), dt.datetime(2024, 1, 1), dt.timedelta(minutes=1)
    events = [(j, kind, t0 + rng.randrange(100) * m, f"w{rng.randrange(3)}" if kind == "start" else None)
              for j in [None, *range(600)] for kind in rng.choices(["request", "start", "succeed", "fail"], k=3)]
    rng.shuffle(events)
    batches = [events[:700], events[700:1400], events[1400:], [(9999, "start", t0 + 120 * m, "w")],
               [(9998, "request", t0 + 300 * m, None)]]
    src = _batches(spark, batches, EVENTS)
    q = stuck_alarm_stream(src, 5 * 60 * 1000, "120 minutes", buckets=4).writeStream.format("memory") \
        .queryName("t5_many").start()
    q.processAllAvailable()
    held = max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"])
    q.stop()
    assert held <= 4 * 4
    want = []
    for j in {e[0] for e in events}:
        starts = [(ts, w) for i, kind, ts, w in events if i == j and kind == "start"]
        ends = [ts for i, kind, ts, _ in events if i == j and kind in ("succeed", "fail")]
        if starts and (not ends or min(ends) > min(starts)[0] + 5 * m):
            want.append((j, min(starts)[0]))
    got = [(r.job_id, r.start_time) for r in spark.table("t5_many").collect()]
    assert sorted(got, key=str) == sorted([*want, (9999, t0 + 120 * m)], key=str)


JOB = ("id string, repository string, commit_hash string, query_string string, status string, "
       "worker string, queue_time timestamp_ntz, start_time timestamp_ntz, "
       "finish_time timestamp_ntz, result_url string, result_error string, priority string")
REQ = ("request_id long, repository string, commit_hash string, query_string string, "
       "request_time timestamp_ntz")


def test_t4_failed_job_reopens_after_a_restart_and_extra_columns(spark):
    """request, request | fail | request over one checkpoint, the base with a
    column that new jobs do not have."""
    t0, d = dt.datetime(2024, 1, 1), _tmp()
    spark.createDataFrame([], JOB).write.parquet(f"{d}/base")
    land = f"{d}/land"

    def send(i):
        row = (i, "r", "c", "q", t0 + dt.timedelta(minutes=i))
        spark.createDataFrame([row], REQ).coalesce(1).write.parquet(f"{land}/p{i}")

    def run():
        src = spark.readStream.schema(REQ).option("maxFilesPerTrigger", 1).parquet(f"{land}/*")
        q = start_enqueue_stream(src, f"{d}/base", f"{d}/out", f"{d}/ck", available_now=True,
                                 events_dir=f"{d}/events")
        q.awaitTermination()
        return {r.request_id: (r.job_id, r.created)
                for r in spark.read.parquet(f"{d}/out/resolved").collect()}

    send(0)
    send(1)
    first = run()
    assert first[0][1] and first[1] == (first[0][0], False)
    failed = spark.createDataFrame(
        [(first[0][0], "fail", t0 + dt.timedelta(minutes=2), "r", "c", "q", None, "bad")],
        "job_id string, kind string, ts timestamp_ntz, repository string, commit_hash string, "
        "query_string string, worker string, result string")
    write_events(failed, f"{d}/events")
    send(3)
    second = run()
    assert second[3][1] and second[3][0] != first[0][0]
    assert {k: v for k, v in second.items() if k != 3} == first


def test_t3_late_rows_are_kept_aside(spark):
    """A row sent twice, a late row and a copy after a restart: each id is
    answered once, the late row lies in the side table."""
    t0, m, d = dt.datetime(2024, 1, 1), dt.timedelta(minutes=1), _tmp()
    sch = "event_id long, ts timestamp_ntz, v string"
    batches = [[(1, t0, "a"), (1, t0, "a"), (2, t0 + 9 * m, "b")], [(3, t0 + 60 * m, "c"), (2, t0 + 9 * m, "b")],
               [(4, t0 + 5 * m, "late"), (3, t0 + 60 * m, "c"), (5, t0 + 58 * m, "e"), (None, None, "n")]]
    resent = ResentFilter(spark, f"{d}/state", spark.createDataFrame([], sch).schema["event_id"], "event_id",
                          "ts", 600)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, sch).coalesce(1).write.parquet(f"{d}/land/p{i}")
        src = spark.readStream.schema(sch).parquet(f"{d}/land/*")
        start_resent_stream(src, resent, f"{d}/out", f"{d}/ck", available_now=True).awaitTermination()
    for _ in range(2):
        kept = [r.event_id for r in spark.read.parquet(f"{d}/out/kept").collect()]
        assert sorted(kept, key=str) == [1, 2, 3, 5, None]
        assert [r.v for r in spark.read.parquet(f"{d}/out/late").collect()] == ["late"]
        # the last batch again
        resent.apply(spark.read.parquet(f"{d}/land/p2"), 2, f"{d}/out/kept/batch=2", f"{d}/out/late/batch=2")


def test_t4_by_increments_reads_no_old_events(spark):
    """request, fail, request over three runs: the KEY is opened again, and a
    batch reads the buckets of its own jobs only."""
    t0, m, d = dt.datetime(2024, 1, 1), dt.timedelta(minutes=1), _tmp()
    base = spark.createDataFrame(
        [("b1", "r", "c", "old", "succeeded", "w", t0, t0, t0, "u", None, None),
         ("b2", "r", "c", "bad", "failed", "w", t0, t0, t0, None, "e", None)], JOB)
    state = JobState(spark, f"{d}/state", buckets=8)
    state.load(base)
    def send(i, rows=None, events=None):
        out = stream_rows(spark.createDataFrame(rows or [], REQ), kind=F.lit("enqueue"), ts=F.col("request_time"))
        if events:
            out = out.unionByName(stream_rows(spark.createDataFrame(
                events, "job_id string, kind string, ts timestamp_ntz, worker string, result string")))
        out.coalesce(1).write.parquet(f"{d}/land/p{i}")
        src = spark.readStream.schema(out.schema).parquet(f"{d}/land/*")
        start_job_stream(src, state, f"{d}/out", f"{d}/ck", available_now=True).awaitTermination()
        return {r.request_id: (r.job_id, r.created)
                for r in spark.read.schema(spark.read.parquet(f"{d}/out/resolved").schema)
                .parquet(f"{d}/out/resolved").collect()}
    first = send(0, [(1, "r", "c", "q", t0 + m), (2, "r", "c", "q", t0 + 2 * m), (3, "r", "c", "old", t0),
                     (4, "r", "c", "bad", t0)])
    assert first[1][1] and first[2] == (first[1][0], False) and first[3] == ("b1", False) and first[4][1]
    second = send(1, events=[(first[1][0], "start", t0 + 3 * m, "w9", None),
                             (first[1][0], "fail", t0 + 4 * m, None, "broken")])
    assert second == first
    third = send(2, [(5, "r", "c", "q", t0 + 5 * m), (6, "r", "c", "old", t0 + 5 * m)])
    assert third[5][1] and third[5][0] != first[1][0] and third[6] == ("b1", False)
    jobs = {r.id: r for r in state.jobs().collect()}
    assert len(jobs) == 5
    failed = jobs[first[1][0]]
    assert (failed.status, failed.worker, failed.result_error) == ("failed", "w9", "broken")
    assert jobs[third[5][0]].status == "pending" and jobs["b1"].result_url == "u"
    one = state.by_id.read(buckets=state.by_id.touched(spark.createDataFrame([("b1",)], "job_id string")))
    files = one.inputFiles()
    assert files and len({f.rsplit("/bucket=", 1)[1].split("/")[0] for f in files}) == 1


def test_accumulators_equal_the_fold(spark):
    from jobtables.operators.update import accumulated_jobs, event_accumulators, merge_accumulators
    log = fx.job_log_v(spark, SF001)
    a, b = (merge_accumulators(event_accumulators(log.where(c))) for c in ("kind = 'start'", "kind <> 'start'"))
    got = accumulated_jobs(merge_accumulators(a.unionByName(b)))
    want = job_state_fold(log)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
