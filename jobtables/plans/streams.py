"""Registered queries of the streaming operators and of the sinks.

Each runs its stream over a test table: the table is written as slices of time
below the checkpoint folder, and after every slice the stream is started again
on one checkpoint and ends when it has read what is there (``availableNow``).
What the stream has written is read back, so the batch SQL is its twin.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobtables import fixtures as fx
from jobtables.functions.naming import result_url
from jobtables.operators.ordered import Segments
from jobtables.operators.update import job_state_fold
from jobtables.scratch import Scratch
from jobtables.sources.jobs import read_requests_stream
from jobtables.sources.sinks import write_events, write_results
from jobtables.streaming.claims import ClaimRanks, match_claim_ranks, start_claim_stream
from jobtables.streaming.enqueue import start_enqueue_stream
from jobtables.streaming.job_state import JobState, start_job_stream, stream_rows
from jobtables.streaming.resent import ResentFilter, start_resent_stream
from jobtables.streaming.stateful import dedup_stream, job_state_stream, stuck_alarm_stream

SLICES = 3
RESULT_BUCKET = "bucket"
STUCK_STREAM_LIMIT_S = 2 * 24 * 3600
RESENT_DELAY_S = 24 * 3600
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _rocksdb(spark: SparkSession):
    """Stateful processors need the RocksDB state store."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def _sliced(spark: SparkSession, rows: DataFrame, order: Sequence[str], scratch: Scratch,
            start: Callable[[DataFrame, str], StreamingQuery], slices: int = SLICES) -> None:
    """Land ``rows`` in slices of ``order``; run the stream to its end after each."""
    land, checkpoint = scratch.path("land"), scratch.path("checkpoint")
    whole = scratch.table(rows, "rows")
    cut = Segments(whole, [], list(order), slices)
    for i in range(cut.count):
        whole.where(cut.of(whole) == i).write.parquet(f"{land}/slice={i}")
        source = spark.readStream.schema(whole.schema).parquet(f"{land}/slice=*")
        with _rocksdb(spark):
            start(source, checkpoint).awaitTermination()


def _appended(stream: Callable[[DataFrame], DataFrame], out: str):
    def start(source: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream(source).writeStream.format("parquet").option("path", out) \
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return start


def stream_dedup(s: SparkSession, d: str) -> DataFrame:
    """T1 over three runs."""
    scratch = Scratch(s, "stream-t1")
    out = scratch.path("out")
    _sliced(s, fx.dedup_log(s, d), ["t", "id"], scratch,
            _appended(lambda src: dedup_stream(src, ["user_id"]), out))
    return s.read.parquet(out).select("id", "user_id", "job_id", "created")


def stream_job_state(s: SparkSession, d: str) -> DataFrame:
    """T2 in update mode: of a job the row of the last batch that changed it."""
    scratch = Scratch(s, "stream-t2")
    out = scratch.path("out")

    def start(source, checkpoint):
        return job_state_stream(source).writeStream.outputMode("update").foreachBatch(
            lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")) \
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    _sliced(s, fx.job_log_v(s, d), ["ts", "job_id", "kind"], scratch, start)
    rows = s.read.parquet(out)
    cols = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(F.col("id").alias("_id")).agg(F.max_by(F.struct(*cols), "batch").alias("r")) \
        .select("r.*")


def stream_job_increments(s: SparkSession, d: str) -> DataFrame:
    """U4 by increments: the job table that the state tables hold in the end."""
    scratch = Scratch(s, "stream-u4")
    state = JobState(s, scratch.path("state"), buckets=8)
    out = scratch.path("out")
    rows = stream_rows(fx.job_log_v(s, d))
    _sliced(s, rows, ["ts", "job_id", "kind"], scratch,
            lambda src, ck: start_job_stream(src, state, out, ck, available_now=True))
    return state.jobs().withColumn("id", F.col("id").cast("long"))


def stream_drop_resent(s: SparkSession, d: str) -> DataFrame:
    """Every seventh event is sent again with the next slice, and every
    eleventh only long after its time: the first are answered once, the others
    lie in the side table (``late``)."""
    scratch = Scratch(s, "stream-t3")
    out, state = scratch.path("out"), scratch.path("state")
    e = fx.table(s, d, "events").select("event_id", "user_id", "event_type", "ts")
    span = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    half = span["a"] + (span["b"] - span["a"]) / 2
    delayed = (F.col("event_id") % 11 == 0) & (F.col("ts") < F.lit(str(half)).cast("timestamp_ntz"))
    sent = e.withColumn("sent", F.when(delayed, F.lit(2)).otherwise(
        F.when(F.col("ts") < F.lit(str(half)).cast("timestamp_ntz"), 0).otherwise(1)))
    again = e.where(~delayed & (F.col("event_id") % 7 == 0)).withColumn("sent", F.lit(1)) \
        .where(F.col("ts") >= F.lit(str(half)).cast("timestamp_ntz"))
    rows = sent.unionByName(again)
    resent = ResentFilter(s, state, e.schema["event_id"], "event_id", "ts", RESENT_DELAY_S, buckets=8)
    land, checkpoint = scratch.path("land"), scratch.path("checkpoint")
    for i in range(3):
        rows.where(F.col("sent") == i).drop("sent").write.parquet(f"{land}/slice={i}")
        source = s.readStream.schema(e.schema).parquet(f"{land}/slice=*")
        start_resent_stream(source, resent, out, checkpoint, available_now=True).awaitTermination()

    def read(kind: str, late: bool) -> DataFrame:
        return s.read.schema(e.schema).parquet(f"{out}/{kind}").select(*e.columns, F.lit(late).alias("late"))
    return read("kept", False).unionByName(read("late", True))


def stream_enqueue(s: SparkSession, d: str) -> DataFrame:
    """S3, T4: requests against the job table, three runs."""
    scratch = Scratch(s, "stream-t4")
    base, out, land = scratch.path("base"), scratch.path("out"), scratch.path("requests")
    fx.jobs_v(s, d).write.parquet(base)
    whole = scratch.table(fx.requests_v(s, d), "rows")
    cut = Segments(whole, [], ["request_time", "request_id"], SLICES)
    for i in range(cut.count):
        whole.where(cut.of(whole) == i).write.parquet(f"{land}/slice={i}")
        start_enqueue_stream(read_requests_stream(s, f"{land}/slice=*"), base, out, f"{out}-checkpoint",
                             available_now=True).awaitTermination()
    return s.read.parquet(f"{out}/resolved").drop("batch")


def stream_stuck(s: SparkSession, d: str) -> DataFrame:
    """T5 by event time, up to the last watermark."""
    scratch = Scratch(s, "stream-t5")
    out = scratch.path("out")
    _sliced(s, fx.job_log_v(s, d).select("job_id", "kind", "ts", "worker"), ["ts", "job_id", "kind"], scratch,
            _appended(lambda src: stuck_alarm_stream(src, STUCK_STREAM_LIMIT_S * 1000, "1 day"), out))
    return s.read.parquet(out).select("job_id", "worker", "start_time")


def stream_claims(s: SparkSession, d: str) -> DataFrame:
    """Claims per repository, half of the log in one."""
    scratch = Scratch(s, "stream-t6")
    out = scratch.path("out")
    ranks = ClaimRanks(s, scratch.path("state"), buckets=4)
    _sliced(s, fx.repository_claim_log(s, d), ["t", "id"], scratch,
            lambda src, ck: start_claim_stream(src, ranks, out, ck, available_now=True))
    return match_claim_ranks(s.read.parquet(f"{out}/ranks"))


def event_log_round_trip(s: SparkSession, d: str) -> DataFrame:
    """The log written in two batches, the second of them twice; the fold
    of what is read back."""
    path = Scratch(s, "events").path("log")
    log = fx.user_log_v(s, d)
    early = F.col("kind").isin("request", "start")
    write_events(log.where(early), path, batch="0")
    for _ in range(2):
        write_events(log.where(~early), path, batch="1")
    return job_state_fold(s.read.parquet(path).select(*log.columns))


def results_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Results of two batches, one of them written twice, read back."""
    path = Scratch(s, "results").path("results")
    done = fx.jobs_v(s, d).where(F.col("status") == "succeeded")
    rows = done.select(F.col("id").alias("job_id"), fx.query_root("query_string").alias("node"))
    for batch in (0, 1, 0):
        write_results(rows.where(F.col("job_id") % 2 == batch), path, RESULT_BUCKET, batch=str(batch))
    back = s.read.parquet(path)
    return back.select("job_id", "node", "result_url", F.col("batch").cast("int").alias("batch"),
                       (F.col("result_url") == result_url(RESULT_BUCKET, "job_id")).alias("url_ok"))


QUERIES = {
    "stream_dedup": stream_dedup,
    "stream_job_state": stream_job_state,
    "stream_job_increments": stream_job_increments,
    "stream_drop_resent": stream_drop_resent,
    "stream_enqueue": stream_enqueue,
    "stream_stuck": stream_stuck,
    "stream_claims": stream_claims,
    "event_log_round_trip": event_log_round_trip,
    "results_round_trip": results_round_trip,
}
