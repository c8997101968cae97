"""One batch of the worker pool as a single distributed plan.

claim (D3) -> route (X1) -> dependency closure of each routable job's query
(G1) -> result rows and outcome per job -> mark running (F14) and finish (U1)
in one join with the job table.  No per-job loop: the closure's rounds are the only driver loop,
and the closure is computed once per distinct root, not once per job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtables.functions.naming import result_url
from jobtables.operators.closure import deps_closure
from jobtables.operators.fifo import claim_fifo
from jobtables.operators.lookup import route_jobs
from jobtables.schema import STATUS_FAILED, STATUS_SUCCEEDED


@dataclass
class RunOutput:
    jobs: DataFrame       # the job table after the batch
    results: DataFrame    # (job_id, node): one row per dependency of a succeeded job
    outcomes: DataFrame   # (job_id, worker, status, result_url, result_error, n_deps)


def run_jobs(jobs: DataFrame, polls: DataFrame, repos: DataFrame, edges: DataFrame,
             root: F.Column, bucket: str = "results", scope: Sequence[str] = ()) -> RunOutput:
    """``root``: the node a claimed job's query asks about, as an expression
    of ``query_string``.  ``scope``: the columns of ``repository`` and
    ``commit_hash`` that ``edges`` has too, so that every snapshot has a graph
    of its own.
    """
    scope = list(scope)
    claims = claim_fifo(jobs, polls)
    claimed = claims.where(F.col("claimed")).select(
        F.col("job_id").alias("id"), F.col("job_repository").alias("repository"),
        F.col("job_commit_hash").alias("commit_hash"), "worker_name", "poll_time",
        F.col("job_query_string").alias("query_string"))
    routed = route_jobs(claimed, repos)
    ok = routed.where(F.col("route_error").isNull()).withColumn("root", root)
    closure = deps_closure(edges, ok.select(*scope, "root").distinct(), scope)
    # result rows per job (lazy: written by the caller, e.g. sinks.write_results)
    results = ok.select(F.col("id").alias("job_id"), *scope, "root") \
        .join(closure, [*scope, "root"]).select("job_id", "node")
    # counts per root, not per (job, node): jobs asking the same query share
    # them; jobs that were not routed have no root and take no part in the join
    per_root = closure.groupBy(*scope, "root").agg(F.count(F.lit(1)).alias("n_deps"))
    counted = ok.join(per_root, [*scope, "root"], "left").drop("root").unionByName(
        routed.where(F.col("route_error").isNotNull())
        .withColumn("n_deps", F.lit(None).cast("bigint")))
    outcomes = counted.select(
        F.col("id").alias("job_id"), "repository", F.col("worker_name").alias("worker"),
        F.when(F.col("route_error").isNull(), F.lit(STATUS_SUCCEEDED))
         .otherwise(F.lit(STATUS_FAILED)).alias("status"),
        F.col("poll_time").alias("start_time"), F.col("poll_time").alias("finish_time"),
        F.when(F.col("route_error").isNull(), result_url(bucket, "id")).alias("result_url"),
        F.col("route_error").alias("result_error"),
        F.coalesce(F.col("n_deps"), F.lit(0)).cast("bigint").alias("n_deps"))
    # claim (F14) and finish (U1) of the claimed jobs applied in ONE join of the
    # job table with the per-job outcomes (claimed jobs were pending, so their
    # result columns were empty)
    upd = outcomes.select(*[F.col(c).alias(f"_u_{c}") for c in
                            ("job_id", "worker", "status", "start_time", "finish_time",
                             "result_url", "result_error")])
    j = jobs.join(upd, jobs["id"] == upd["_u_job_id"], "left")
    hit = F.col("_u_job_id").isNotNull()
    after = j.withColumns({c: F.when(hit, F.col(f"_u_{c}")).otherwise(F.col(c))
                           for c in ("worker", "status", "start_time", "finish_time",
                                     "result_url", "result_error")}).drop(*upd.columns)
    return RunOutput(after, results, outcomes)
