"""The job table kept up to date by increments (U4, T4).

Per job an accumulator that two sets of events can be merged into, and per KEY
an index of its live jobs, each a :class:`StateTable`.  A micro-batch of
life-cycle events and enqueue requests folds its own rows only: it reads the
accumulators of the jobs it names and the index of the KEYs it asks for, never
the event log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from jobtables.operators.dedup import enqueue_new_jobs, enqueue_resolve
from jobtables.operators.update import (
    accumulated_jobs,
    event_accumulators,
    job_events,
    merge_accumulators,
)
from jobtables.schema import KEY, STATUS_FAILED
from jobtables.streaming.state_table import StateTable

ENQUEUE = "enqueue"
_STRING, _TIME = T.StringType(), T.TimestampNTZType()
#: Rows of the stream: enqueue requests (``request_id``) and life-cycle events.
STREAM_SCHEMA = T.StructType([
    T.StructField("kind", _STRING), T.StructField("request_id", T.LongType()),
    T.StructField("job_id", _STRING), T.StructField("ts", _TIME),
    *[T.StructField(k, _STRING) for k in KEY],
    T.StructField("worker", _STRING), T.StructField("result", _STRING)])
_INDEX = T.StructType([*[T.StructField(k, _STRING) for k in KEY], T.StructField("id", _STRING),
                       T.StructField("status", _STRING), T.StructField("version", T.LongType())])


def _latest_live(rows: DataFrame) -> DataFrame:
    """The last status of each job; failed jobs leave the index."""
    last = F.max_by("status", "version").alias("status")
    return rows.groupBy(*KEY, "id").agg(last, F.max("version").alias("version")) \
        .where(F.col("status") != STATUS_FAILED)


class JobState:
    """Accumulators by job id and the index of live jobs by KEY."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        empty = spark.createDataFrame([], STREAM_SCHEMA)
        schema = merge_accumulators(event_accumulators(empty)).schema
        self.by_id = StateTable(spark, f"{root}/by_id", schema, ["job_id"], merge_accumulators, buckets)
        self.by_key = StateTable(spark, f"{root}/by_key", _INDEX, KEY, _latest_live, buckets)

    def load(self, jobs: DataFrame) -> None:
        """Start from a job table (before the first batch of a stream)."""
        text = jobs.withColumn("id", F.col("id").cast("string"))
        acc = merge_accumulators(event_accumulators(job_events(text)))
        self.by_id.merge(acc, -1)
        self.by_key.merge(_index_rows(acc, -1), -1)

    def jobs(self) -> DataFrame:
        """The job table as the last batch has left it (U4)."""
        return accumulated_jobs(self.by_id.read())

    def apply(self, batch: DataFrame, batch_id: int, resolved_path: str | None = None) -> None:
        """One micro-batch of rows of ``STREAM_SCHEMA``.  Its events take
        effect before its requests are resolved (J1, J2); what they resolve to
        goes to ``resolved_path``."""
        batch = batch.persist()
        try:
            events = event_accumulators(batch.where(F.col("kind") != ENQUEUE))
            requests = batch.where(F.col("kind") == ENQUEUE).select(
                "request_id", *KEY, F.col("ts").alias("request_time"))
            ids = events.select("job_id").distinct()
            changed = _index_rows(
                self.by_id.merged(events, batch_id).join(ids, "job_id", "left_semi"), batch_id).persist()
            asked = requests.select(*KEY).distinct()
            known = self.by_key.read(batch_id, self.by_key.touched(asked))
            live = _latest_live(known.unionByName(changed)).join(asked, KEY, "left_semi")
            fresh = enqueue_new_jobs(requests, live).persist()
            if resolved_path is not None:
                enqueue_resolve(requests, live).write.mode("overwrite").parquet(resolved_path)
            opened = fresh.select(
                F.lit("request").alias("kind"), F.col("id").alias("job_id"),
                F.col("queue_time").alias("ts"), *KEY, F.lit(None).cast("string").alias("worker"),
                F.lit(None).cast("string").alias("result"))
            pending = fresh.select(*KEY, "id", "status", F.lit(batch_id).cast("long").alias("version"))
            self.by_id.merge(events.unionByName(event_accumulators(opened)), batch_id)
            self.by_key.merge(changed.unionByName(pending), batch_id)
            changed.unpersist()
            fresh.unpersist()
        finally:
            batch.unpersist()


def _index_rows(acc: DataFrame, version: int) -> DataFrame:
    """Index rows of accumulators; a job whose request is unknown has no KEY."""
    return accumulated_jobs(acc).where(F.col("repository").isNotNull()).select(
        *KEY, "id", "status", F.lit(version).cast("long").alias("version"))


def stream_rows(rows: DataFrame, **given) -> DataFrame:
    """Requests or events in the columns of ``STREAM_SCHEMA`` (``given``:
    expressions of columns the rows lack; others become null)."""
    have = set(rows.columns)
    return rows.select(*[
        (given[f.name] if f.name in given else F.col(f.name) if f.name in have else F.lit(None))
        .cast(f.dataType).alias(f.name) for f in STREAM_SCHEMA])


def start_job_stream(rows: DataFrame, state: JobState, out_dir: str, checkpoint: str,
                     available_now: bool = False) -> StreamingQuery:
    """T4 with U4 by increments: ``rows`` is a stream of requests and events in
    ``STREAM_SCHEMA``; resolved requests go to ``out_dir/resolved/batch=<id>``."""
    w = rows.writeStream.foreachBatch(
        lambda df, bid: state.apply(df, bid, f"{out_dir}/resolved/batch={bid}")) \
        .option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
