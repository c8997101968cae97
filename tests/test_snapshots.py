"""Snapshots laid out for J1 and for lookups by id."""

import re
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from jobtables import fixtures as fx
from jobtables.operators.dedup import _key_map, enqueue_new_jobs, enqueue_resolve
from jobtables.operators.lookup import cached_results, job_by_id
from jobtables.schema import KEY
from jobtables.sources.snapshots import read_id_snapshot, write_id_snapshot, write_live_snapshot


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_requests_meet_a_bucketed_snapshot_in_place(spark):
    d = tempfile.mkdtemp(prefix="jt-snap-", dir="/tmp")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    requests, jobs = fx.requests_v(spark, SF001), fx.jobs_v(spark, SF001)
    write_live_snapshot(jobs, "jt_live_test", f"{d}/live", n)
    live = spark.table("jt_live_test")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(_key_map(requests, None, live, KEY))
        # one exchange, of the requests' map; the snapshot side has none
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        # and a plain job table costs one more, its own
        assert _plan(_key_map(requests, jobs, None, KEY)).count("Exchange hashpartitioning") == 2
        got = sorted(map(str, enqueue_resolve(requests, live=live).collect()))
        assert got == sorted(map(str, enqueue_resolve(requests, jobs).collect()))
        got = sorted(map(str, enqueue_new_jobs(requests, live=live).collect()))
        assert got == sorted(map(str, enqueue_new_jobs(requests, jobs).collect()))
        got = cached_results(requests, live=live)
        assert "Bucketed: true" in _plan(got)
        assert sorted(map(str, got.collect())) == sorted(map(str, cached_results(requests, jobs).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE jt_live_test")


def _scanned(df) -> int:
    """Rows that left the scan: whole row groups are skipped or read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    out = 0
    for i in range(leaves.size()):
        metric = leaves.apply(i).metrics().get("numOutputRows")
        out += metric.get().value() if metric.isDefined() else 0
    return out


def test_lookup_by_id_reads_few_row_groups(spark):
    d = tempfile.mkdtemp(prefix="jt-snap-", dir="/tmp")
    jobs = spark.range(40_000).select(
        F.sha2((F.col("id") * 2).cast("string"), 256).alias("id"), F.lit("pending").alias("status"))
    write_id_snapshot(jobs, f"{d}/jobs", files=8, rows_per_file=500, expected_ids=500)
    back = read_id_snapshot(spark, f"{d}/jobs")
    here = back.where(F.col("id") == back.limit(1).first()["id"])
    assert here.count() == 1 and _scanned(here) <= 500
    # absent ids: the ranges of one file may hold them, its Bloom filter does not
    missing = [spark.range(1).select(F.sha2(F.lit(str(2 * i + 1)), 256)).first()[0] for i in range(5)]
    assert sum(_scanned(job_by_id(back, m)) for m in missing) <= 500
    import pyarrow.parquet as pq
    files = [re.sub("^file:(//)?", "", f) for f in back.inputFiles()]
    meta = [pq.ParquetFile(f).metadata.row_group(0).column(0).statistics for f in files]
    spans = sorted((m.min, m.max) for m in meta)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))  # files do not overlap
