"""Sinks (S4-S6): life-cycle events, result tables, time text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtables.functions.naming import result_url
from jobtables.functions.timefmt import rfc3339_encode
from jobtables.schema import JOB_COLUMNS, DUMP_RENAMES


def write_events(events: DataFrame, path: str, mode: str = "append",
                 files_per_date: int = 8, batch: str | None = None) -> None:
    """Append life-cycle facts, partitioned by event date so a reader of
    recent days prunes the rest.  A date's rows go to at most
    ``files_per_date`` files of a call.  With ``batch`` the rows lie in
    folders of that batch, and writing the batch again replaces its own rows,
    so a repeated call adds nothing twice."""
    salt = F.pmod(F.xxhash64(F.col("job_id").cast("string")), F.lit(files_per_date))
    dated = events.withColumn("event_date", F.to_date("ts")).repartition("event_date", salt)
    if batch is None:
        dated.write.mode(mode).partitionBy("event_date").parquet(path)
    else:
        dated.withColumn("batch", F.lit(batch)).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch", "event_date").parquet(path)


def result_rows(results: DataFrame, bucket: str, job_id: str = "job_id",
                buckets: int = 64) -> DataFrame:
    """Result rows with the URL that addresses their job's result and the
    hash bucket they are stored under."""
    return results.withColumns({
        "result_url": result_url(bucket, job_id),
        "bucket": F.pmod(F.xxhash64(F.col(job_id).cast("string")), F.lit(buckets)),
    })


def write_results(results: DataFrame, path: str, bucket: str, job_id: str = "job_id",
                  buckets: int = 64, batch: str = "0", partitions: int | None = None) -> None:
    """One results table (not one object per job), partitioned on the
    batch that wrote it and a hash bucket of the job id: a reader of one job's
    result prunes to one bucket folder per batch.  Writing a batch again
    replaces its own rows only; other batches stay.  Rows are dealt by ranges
    of (bucket, job), so all tasks write, and lie together by job."""
    spark = results.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = result_rows(results, bucket, job_id, buckets).withColumn("batch", F.lit(batch))
    (rows.repartitionByRange(n, "bucket", job_id).sortWithinPartitions("bucket", job_id)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch", "bucket").parquet(path))


def encode_jobs(jobs: DataFrame) -> DataFrame:
    """Job rows -> the SQL store's text dump (UTC, whole-second RFC 3339;
    SQL column names)."""
    inv = {v: k for k, v in DUMP_RENAMES.items()}
    cols = []
    for c in JOB_COLUMNS:
        e = rfc3339_encode(c) if c.endswith("_time") else F.col(c)
        if c == "id":
            e = F.col(c).cast("string")
        cols.append(e.alias(inv.get(c, c)))
    return jobs.select(*cols)
