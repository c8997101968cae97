"""Lookups, polls, routing and the worker's view of a job (F2, F4, F8, J3,
J4, X1-X3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtables.functions.naming import workspace_error
from jobtables.functions.status import poll_columns, poll_struct
from jobtables.operators.dedup import live_rows
from jobtables.schema import (
    CLIENT_POLL_DELAY_S,
    ERR_JOB_NOT_FOUND,
    KEY,
    STATUS_FAILED,
    STATUS_RUNNING,
    STATUS_SUCCEEDED,
)


def live(jobs: DataFrame) -> DataFrame:
    """non-failed jobs."""
    return jobs.where(F.col("status") != STATUS_FAILED)


def job_by_id(jobs: DataFrame, job_id) -> DataFrame:
    """point lookup; pushed to the Parquet scan as an equality filter."""
    return jobs.where(F.col("id") == F.lit(job_id))


def job_view(jobs: DataFrame, nested: bool = True) -> DataFrame:
    """F8: what a worker receives: {id, query, source{repo, committish}}."""
    if nested:
        return jobs.select(
            "id", F.col("query_string").alias("query"),
            F.struct(F.col("repository").alias("repo"),
                     F.col("commit_hash").alias("committish")).alias("source"))
    return jobs.select("id", F.col("query_string").alias("query"),
                       F.col("repository").alias("source_repo"),
                       F.col("commit_hash").alias("source_committish"))


def poll_bulk(ids: DataFrame, jobs: DataFrame, now, delay_s: int = CLIENT_POLL_DELAY_S,
              nested: bool = False, strict: bool = False) -> DataFrame:
    """Answer many polls at once.  ``ids`` has a column ``id``; unknown
    ids answer ``job not found``.  One row per poll id.  With ``strict`` the
    first precondition error (F6) fails the query instead of being a row.

    If ids repeat in ``jobs`` (a broken primary key, see audit A2) each copy
    answers; audit_job_id reports such ids."""
    j = jobs.select("id", "status", "result_url", "result_error").withColumn("_hit", F.lit(True))
    m = ids.join(j, "id", "left")
    found = F.col("_hit").isNotNull()
    cols = poll_columns(now, delay_s)
    out = m.withColumns({
        "poll_state": F.when(found, cols["poll_state"]).otherwise(F.lit("error")),
        "next_poll_time": F.when(found, cols["next_poll_time"]),
        "results_url": F.when(found, cols["results_url"]),
        "failure_message": F.when(found, cols["failure_message"]),
        "error": F.when(found, cols["error"]).otherwise(F.lit(ERR_JOB_NOT_FOUND)),
    })
    if nested:
        out = out.withColumn("answer", F.when(found, poll_struct(now, delay_s)))
    if strict:
        out = out.withColumn("error", F.when(
            F.col("error").isNotNull(),
            F.raise_error(F.concat(F.lit("poll of job "), F.col("id").cast("string"),
                                   F.lit(": "), F.col("error"))).cast("string")))
    return out.drop("_hit", "status", "result_url", "result_error")


def poll_not_found(ids: DataFrame, jobs: DataFrame) -> DataFrame:
    """Polled ids with no job."""
    return ids.join(jobs.select("id"), "id", "left_anti")


def route_jobs(jobs: DataFrame, repos: DataFrame) -> DataFrame:
    """Exact lookup of each job's repository in the workspace map; an
    unknown repository makes the job fail with ``workspace for repo "<r>" not
    found`` (a null one too, named by an empty text).  The map is a dimension
    (one row per configured repository; of several workspaces the smallest
    counts); the planner broadcasts it where its measured bytes allow."""
    r = repos.groupBy("repository").agg(F.min("workspace").alias("workspace"))
    m = jobs.join(r, "repository", "left")
    return m.withColumn("route_error", F.when(F.col("workspace").isNull(), _unknown()))


def _unknown():
    return workspace_error(F.coalesce(F.col("repository"), F.lit("")))


def unroutable_jobs(jobs: DataFrame, repos: DataFrame) -> DataFrame:
    """Jobs whose repository has no workspace."""
    known = repos.where(F.col("workspace").isNotNull()).select("repository")
    return (jobs.join(known, "repository", "left_anti")
            .withColumn("route_error", _unknown()))


def cached_results(requests: DataFrame, jobs: DataFrame | None = None, keys: Sequence[str] = KEY,
                   live: DataFrame | None = None) -> DataFrame:
    """Requests whose KEY resolves to a job that already succeeded get
    its result at once (the job the enqueue would return: lowest live id).
    ``live``: a snapshot of live jobs in place of the job table."""
    if live is None:
        live = live_rows(jobs, keys)
    hit = live.where(F.col("live_status") == STATUS_SUCCEEDED) \
        .select(*keys, F.col("live_id").alias("job_id"), F.col("live_url").alias("result_url"))
    return requests.join(hit, list(keys)).select("request_id", *keys, "job_id", "result_url")


def running(jobs: DataFrame) -> DataFrame:
    """Jobs a worker holds (the input of routing, X1/X2)."""
    return jobs.where(F.col("status") == STATUS_RUNNING)
