"""Plan shape: pushdown, top-k, bounded broadcasts, and no step that sends the
whole log (or a whole key) to one task."""

import re
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from jobtables import fixtures as fx
from jobtables.operators.dedup import dedup_generations
from jobtables.operators.fifo import claim_fifo, claim_interleaved, next_k_jobs, pending
from jobtables.operators.lookup import route_jobs


def _plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()   # final adaptive plan
    return df._jdf.queryExecution().executedPlan().toString()


def _written_jobs(spark):
    d = tempfile.mkdtemp(prefix="jt-plan-", dir="/tmp")
    fx.jobs_v(spark, SF001).write.parquet(f"{d}/jobs")
    return spark.read.parquet(f"{d}/jobs")


def test_status_filter_and_columns_reach_the_scan(spark):
    jobs = _written_jobs(spark)
    p = pending(jobs).select("id", "queue_time")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,pending)]" in p
    assert re.search(r"ReadSchema: struct<id:bigint,status:string,queue_time:timestamp_ntz>", p)


def test_top_k_is_take_ordered(spark):
    p = next_k_jobs(_written_jobs(spark), 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in p


def test_repository_dimension_is_broadcast(spark):
    p = _plan(route_jobs(fx.jobs_v(spark, SF001), fx.repos_v(spark, SF001)))
    assert "BroadcastHashJoin" in p


def _single_partition_inputs(p: str):
    """Lines right below each 'Exchange SinglePartition'."""
    lines = p.splitlines()
    return [lines[i + 1] for i, l in enumerate(lines) if "Exchange SinglePartition" in l]


def _windows(p: str):
    return [l for l in p.splitlines() if re.search(r"\bWindow \[", l)]


def test_fifo_sorts_no_world_in_one_task(spark):
    for df in (claim_fifo(fx.jobs_v(spark, SF001), fx.polls_v(spark, SF001)),
               claim_interleaved(fx.claim_log(spark, SF001))):
        p = _plan(df)
        # a single-partition step may only gather the per-segment summary
        assert all("HashAggregate(keys=[_seg" in b for b in _single_partition_inputs(p))
        # every window is either split by segment (rows) or ordered by segment
        # (the summary): none sorts the raw log by time alone
        wins = _windows(p)
        assert wins and all("_seg" in w for w in wins), wins
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_generations_window_is_split_by_segment(spark):
    p = _plan(dedup_generations(fx.dedup_log(spark, SF001), ["user_id"]))
    wins = _windows(p)
    assert wins and all("_seg" in w for w in wins), wins


def test_hot_key_spans_many_segments(spark):
    """A key holding a third of the rows is split over several tasks."""
    from pyspark.sql import functions as F
    from jobtables.operators.ordered import SEG, Segments
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 1000).alias("k"),
        F.col("id").alias("t"))
    cut = Segments(df, ["k"], ["t"], 8)
    seg = cut.deal(df)
    parts = seg.groupBy(F.spark_partition_id().alias("p")).agg(F.min(SEG), F.max(SEG)).collect()
    assert all(tuple(r) == (r["p"],) * 3 for r in parts)  # one segment per task
    n = seg.where("k = 0").select("_seg").distinct().count()
    assert n >= 3, n
    biggest = seg.groupBy("_seg").count().agg(F.max("count")).first()[0]
    assert biggest < 30000 / 3   # no task holds the whole hot key


def test_a_hot_key_of_requests_is_not_one_task(spark):
    """Half of all requests share one KEY and broadcasts are off (but for the
    bounded ones): no task of the last join holds much more than its share."""
    from jobtables.operators.dedup import enqueue_resolve
    req = spark.range(40_000).select(
        F.col("id").alias("request_id"), F.lit("r").alias("repository"), F.lit("c").alias("commit_hash"),
        F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("q"), F.col("id")))
        .alias("query_string"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
        .alias("request_time")).repartition(16)
    jobs = fx.jobs_v(spark, SF001)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = enqueue_resolve(req, jobs).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    sizes = [r["count"] for r in rows]
    assert sum(sizes) == 40_000
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)
