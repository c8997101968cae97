"""FIFO claims per repository, one micro-batch at a time.

State per repository: enqueues so far (E) and claims so far (C), two numbers
however long the queue.  A micro-batch's rows get their ranks from segmented
running sums, so a repository with most of a batch's rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from jobtables.operators.ordered import running_sums
from jobtables.scratch import Scratch
from jobtables.streaming.state_table import StateTable


def _newest(rows: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("E", "C"), "version")
    return rows.groupBy("key").agg(last.alias("s"), F.max("version").alias("version")) \
        .select("key", "s.E", "s.C", "version")


class ClaimRanks:
    """Ranks of a log's rows per ``key``, continued over micro-batches."""

    def __init__(self, spark: SparkSession, root: str, key: str = "repository", t: str = "t",
                 rid: str = "id", kind: str = "kind", buckets: int = 16):
        self.key, self.t, self.rid, self.kind = key, t, rid, kind
        schema = T.StructType([T.StructField("key", T.StringType())] + [
            T.StructField(c, T.LongType()) for c in ("E", "C", "version")])
        self.state = StateTable(spark, f"{root}/claims", schema, ["key"], _newest, buckets)

    def apply(self, batch: DataFrame, batch_id: int, path: str) -> None:
        """Write ``(key, id, t, kind, rank)`` of the batch: an enqueue gets the
        number of enqueues so far, a poll that number of claims if a job is
        waiting, else null (an empty poll is not remembered)."""
        scratch = Scratch(batch.sparkSession, "claims")
        enqueue = F.col(self.kind) == "enqueue"
        rows = scratch.table(batch.select(F.col(self.key).alias("key"), F.col(self.rid).alias("id"),
                                          F.col(self.t).alias("t"), F.col(self.kind).alias("kind"),
                                          enqueue.alias("enqueue")), "batch")
        keys = rows.select("key").distinct()
        start = self.state.read(batch_id, self.state.touched(keys)).select("key", "E", "C")
        start = keys.join(start, "key", "left").select(
            "key", F.coalesce("E", F.lit(0)).alias("E0"), F.coalesce("C", F.lit(0)).alias("C0"))
        one = F.when(F.col("enqueue"), 1).otherwise(-1).cast("bigint")
        sums = running_sums(rows, ["key"], ["t", "id"], {
            "_s": one, "_e": F.col("enqueue").cast("bigint")}, min_before={"_mb": "_s"})
        # the queue starts with E0 - C0 jobs; the sum is reflected where it would fall below 0
        waiting = F.col("E0") - F.col("C0")
        s = waiting + F.col("_s")
        low = F.least(F.coalesce(waiting + F.col("_mb"), F.lit(0)), F.lit(0))
        length = s - F.least(low, s)
        enqueues = F.col("E0") + F.col("_e")
        rank = F.when(F.col("enqueue"), enqueues).when(s >= low, enqueues - length)
        out = sums.join(start, "key").select(
            "key", "id", "t", "kind", rank.alias("rank"), enqueues.alias("e"), length.alias("length"))
        out = scratch.table(out, "ranks")
        out.select(F.col("key").alias(self.key), F.col("id").alias(self.rid), F.col("t").alias(self.t),
                   F.col("kind").alias(self.kind), "rank").write.mode("overwrite").parquet(path)
        last = out.groupBy("key").agg(F.max("e").alias("E"),
                                      F.max_by("length", F.struct("t", "id")).alias("waiting"))
        self.state.merge(last.select("key", "E", (F.col("E") - F.col("waiting")).alias("C"),
                                     F.lit(batch_id).cast("long").alias("version")), batch_id)
        scratch.close()


def start_claim_stream(log: DataFrame, ranks: ClaimRanks, out_dir: str, checkpoint: str,
                       available_now: bool = False) -> StreamingQuery:
    """Ranks of a streaming log, to ``out_dir/ranks/batch=<id>``."""
    w = log.writeStream.foreachBatch(
        lambda df, bid: ranks.apply(df, bid, f"{out_dir}/ranks/batch={bid}")) \
        .option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def match_claim_ranks(ranks: DataFrame, key: str = "repository", rid: str = "id",
                      kind: str = "kind") -> DataFrame:
    """Join T6's rows: one row per poll with the job it claimed."""
    polls = ranks.where(F.col(kind) == "poll").select(key, F.col(rid).alias("poll_id"), "rank")
    jobs = ranks.where(F.col(kind) == "enqueue").select(key, F.col(rid).alias("job_id"), "rank")
    return polls.join(jobs, [key, "rank"], "left").select(key, "poll_id", "job_id", "rank")
