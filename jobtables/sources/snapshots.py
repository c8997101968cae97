"""Snapshots of the job table laid out for the joins and lookups that read them.

``write_live_snapshot``: one live job per KEY, bucketed and sorted on KEY, so
that resolving requests against it (J1, J2, X3) shuffles the requests only.
``write_id_snapshot``: all jobs in ranges of the id, sorted, with a Parquet
Bloom filter on the id, so that lookups by id (F4, J3) skip the row groups that
cannot hold it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobtables.operators.dedup import live_rows
from jobtables.schema import KEY


def write_live_snapshot(jobs: DataFrame, name: str, path: str, buckets: int) -> None:
    """The table ``name`` of ``(KEY, live_id, live_url, live_status)`` under
    ``path``, in ``buckets`` buckets of KEY; written again it is replaced."""
    rows = live_rows(jobs)
    rows.repartition(buckets, *KEY).write.format("parquet").mode("overwrite") \
        .bucketBy(buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)


def write_id_snapshot(jobs: DataFrame, path: str, files: int, rows_per_file: int | None = None,
                      expected_ids: int = 1_000_000) -> None:
    """Jobs in ``files`` ranges of the id, sorted inside.  ``expected_ids`` per
    file sizes the Bloom filters."""
    w = jobs.repartitionByRange(files, "id").sortWithinPartitions("id").write.mode("overwrite") \
        .option("parquet.bloom.filter.enabled#id", "true") \
        .option("parquet.bloom.filter.expected.ndv#id", str(expected_ids))
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    w.parquet(path)


def read_id_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
