"""T4: stream-static enqueue with idempotent micro-batch writes.

Each micro-batch of requests is resolved (J1) against the current job table
and the new jobs (J2) are appended to it.  The current table is the base, plus
the new jobs of earlier batches, with the status that the life-cycle event log
(S4) gives: a job that failed there no longer answers its KEY.  Only jobs
whose KEY the batch asks for are aggregated.

Writes go to folders keyed by the batch id in overwrite mode, so a micro-batch
replayed after a failure rewrites the same folders instead of adding rows
twice, and new-job ids are deterministic (a hash of the KEY and the first
request), so the replay writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from jobtables.operators.dedup import enqueue_new_jobs, enqueue_resolve
from jobtables.operators.update import job_state_fold
from jobtables.schema import KEY


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_job_table(spark: SparkSession, base: str, new_jobs_dir: str, before_batch: int,
                   events: DataFrame | None = None, keys: DataFrame | None = None) -> DataFrame:
    """The job snapshot a micro-batch resolves against: the base table plus
    the new jobs of every earlier batch (ids as text, the model's type).  A
    replayed batch does not see its own earlier output.

    Columns that only the base has are null in the new jobs.  ``keys``: only
    jobs of these KEYs are read.  ``events`` is a life-cycle log; a job's last
    event there sets its status, and only events of the jobs read are folded.
    """
    base_df = spark.read.parquet(base).withColumn("id", F.col("id").cast("string"))
    jobs = base_df
    if _exists(spark, new_jobs_dir):
        schema = T.StructType([f for f in base_df.schema.fields if f.name != "batch"]
                              + [T.StructField("batch", T.LongType())])
        extra = spark.read.schema(schema).parquet(new_jobs_dir) \
            .where(F.col("batch") < before_batch).drop("batch")
        jobs = base_df.unionByName(extra, allowMissingColumns=True)
    if keys is not None:
        jobs = jobs.join(keys, KEY, "left_semi")
    if events is not None:
        events = events.withColumn("job_id", F.col("job_id").cast("string"))
        if keys is not None:
            events = events.join(jobs.select(F.col("id").alias("job_id")), "job_id", "left_semi")
        last = job_state_fold(events) \
            .select("id", F.col("status").alias("_status"))
        jobs = jobs.join(last, "id", "left") \
            .withColumn("status", F.coalesce("_status", "status")).drop("_status")
    return jobs


def enqueue_batch(batch: DataFrame, batch_id: int, jobs_base: str, out_dir: str,
                  events_dir: str | None = None) -> None:
    """One micro-batch of T4 (also callable directly): resolve against the
    snapshot, write resolved rows and new jobs under ``batch=<batch_id>``."""
    spark = batch.sparkSession
    batch = batch.persist()
    try:
        events = None
        if events_dir is not None and _exists(spark, events_dir):
            events = spark.read.parquet(events_dir)
        jobs = read_job_table(spark, jobs_base, f"{out_dir}/jobs", batch_id, events,
                              batch.select(*KEY).distinct())
        res = enqueue_resolve(batch, jobs)
        new = enqueue_new_jobs(batch, jobs).drop("first_request_id")
        res.write.mode("overwrite").parquet(f"{out_dir}/resolved/batch={batch_id}")
        new.write.mode("overwrite").parquet(f"{out_dir}/jobs/batch={batch_id}")
    finally:
        batch.unpersist()


def start_enqueue_stream(requests: DataFrame, jobs_base: str, out_dir: str, checkpoint: str,
                         available_now: bool = False, events_dir: str | None = None
                         ) -> StreamingQuery:
    """Run T4: ``requests`` is a streaming DataFrame of enqueue requests;
    results go to ``out_dir/resolved/batch=<id>`` and ``out_dir/jobs/batch=<id>``.
    ``events_dir``: the life-cycle log that ``write_events`` appends to."""
    w = (requests.writeStream
         .foreachBatch(lambda df, bid: enqueue_batch(df, bid, jobs_base, out_dir, events_dir))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
