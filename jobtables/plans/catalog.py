"""The registered queries: one per operator of the inventory, each over the
views of :mod:`jobtables.fixtures` (so each grows with the test tables).

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names equal those of the matching SQL in :mod:`jobtables.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtables import fixtures as fx
from jobtables.functions.naming import repo_basename, result_url
from jobtables.functions.status import poll_columns, poll_error
from jobtables.functions.timefmt import rfc3339_encode
from jobtables.operators import audit, dedup, fifo, lookup, update
from jobtables.operators.closure import deps_closure, deps_reach
from jobtables.plans import streams
from jobtables.scratch import Scratch
from jobtables.sources.jobs import decode_jobs, quarantine_jobs, read_dump

# Parameters of the registered queries (fixed values shared with the SQL).
NOW = "2022-05-01 20:20:00"          # 2022-05-01T12:20:00-08:00, the tests' clock
STUCK_NOW = "2001-06-01 00:00:00"    # inside the range of the order dates
STUCK_LIMIT_S = 30 * 24 * 3600
LOOKUP_ID = 7
NEXT_K = 1000
RESULT_BUCKET = "bucket"

Query = Callable[[SparkSession, str], DataFrame]


def _jobs(s, d):
    return fx.jobs_v(s, d)


def scan_jobs(s, d):
    return decode_jobs(fx.jobs_text_v(s, d))


def quarantine(s, d):
    _, bad = quarantine_jobs(fx.jobs_text_v(s, d, corrupt=True))
    return bad


def _dump(s, d):
    path = Scratch(s, "dump").path("jobs")
    fx.dump_lines_v(s, d).write.text(path)
    return read_dump(s, path)


def result_manifest(s, d):
    j = _jobs(s, d).where(F.col("status") == "succeeded")
    exp = result_url(RESULT_BUCKET, "id")
    return j.select(F.col("id").alias("job_id"), F.col("result_url"),
                    exp.alias("expected_url"),
                    F.coalesce(F.col("result_url") == exp, F.lit(False)).alias("url_ok"))


def encode_times(s, d):
    return _jobs(s, d).select(
        "id", rfc3339_encode("queue_time").alias("queue_time_text"),
        rfc3339_encode("start_time").alias("start_time_text"),
        rfc3339_encode("finish_time").alias("finish_time_text"))


def poll_status(s, d):
    return _jobs(s, d).select("id", "status", *[c.alias(n) for n, c in poll_columns(NOW).items()])


def poll_precondition_errors(s, d):
    return (_jobs(s, d).select("id", "status", poll_error().alias("error"))
            .where(F.col("error").isNotNull()))


def finish_outcomes(s, d):
    return update.finish_outcomes(fx.finish_v(s, d))


def basenames(s, d):
    repos = _jobs(s, d).select("repository").unionByName(
        fx.requests_v(s, d).select("repository")).distinct()
    return repos.select("repository", repo_basename("repository").alias("basename"))


def _poll_ids(s, d):
    return fx.finish_v(s, d).select(F.col("job_id").alias("id")).distinct()


def poll_bulk(s, d):
    return lookup.poll_bulk(_poll_ids(s, d), _jobs(s, d), NOW)


def poll_not_found(s, d):
    return lookup.poll_not_found(_poll_ids(s, d), _jobs(s, d))


def _running(s, d):
    return lookup.running(_jobs(s, d))


def route(s, d):
    return lookup.route_jobs(_running(s, d), fx.repos_v(s, d)).select(
        "id", "repository", "workspace", "route_error")


def unroutable(s, d):
    return lookup.unroutable_jobs(_running(s, d), fx.repos_v(s, d)).select(
        "id", "repository", "route_error")


def claim_fifo(s, d, surplus=False):
    c = fifo.claim_fifo(_jobs(s, d), fx.polls_v(s, d, surplus))
    return c.select("poll_id", "worker_name", "poll_time", "rank", "job_id",
                    F.col("job_repository").alias("repository"), "queue_time",
                    "next_poll_time", "claimed")


def claim_by_repo(s, d):
    c = fifo.claim_by_repository(_jobs(s, d), fx.polls_v(s, d))
    return c.select("poll_id", "repository", "worker_name", "poll_time", "rank", "job_id",
                    "queue_time", "claimed")


def apply_finishes(s, d):
    return update.apply_finishes(_jobs(s, d), fx.finish_v(s, d))


def rejected(s, d):
    return update.rejected_finishes(_jobs(s, d), fx.finish_v(s, d))


def fold(s, d):
    return update.job_state_fold(fx.job_log_v(s, d))


def closure(s, d):
    return deps_closure(fx.edges_v(s, d), fx.roots_v(s, d))


def reach(s, d):
    return deps_reach(fx.edges_v(s, d), fx.roots_v(s, d))


def _run_jobs(s, d):
    from jobtables.plans.run_jobs import run_jobs
    return run_jobs(_jobs(s, d), fx.polls_v(s, d), fx.repos_v(s, d), fx.edges_v(s, d),
                    root=fx.query_root("query_string"))


def run_jobs_scoped(s, d):
    """G3 where every snapshot (repository, commit) has a graph of its own."""
    from jobtables.plans.run_jobs import run_jobs
    return run_jobs(_jobs(s, d), fx.polls_v(s, d), fx.repos_v(s, d), fx.scoped_edges_v(s, d),
                    root=fx.query_root("query_string"),
                    scope=("repository", "commit_hash")).outcomes


def odd_basenames(s, d):
    repos = fx.odd_repositories_v(s, d).distinct()
    return repos.select("repository", repo_basename("repository").alias("basename"))


def run_jobs_outcomes(s, d):
    return _run_jobs(s, d).outcomes


def run_jobs_state(s, d):
    return _run_jobs(s, d).jobs


def run_jobs_results(s, d):
    return _run_jobs(s, d).results


QUERIES: dict[str, Query] = {
    # sources / sinks
    "scan_jobs": scan_jobs,
    "quarantine_jobs": quarantine,
    "dump_defects": lambda s, d: _dump(s, d)[1],
    "dump_jobs": lambda s, d: _dump(s, d)[0],
    "result_manifest": result_manifest,
    "rfc3339_encode": encode_times,
    # projections / filters
    "pending_jobs": lambda s, d: fifo.pending(_jobs(s, d)),
    "live_jobs": lambda s, d: lookup.live(_jobs(s, d)),
    "job_by_id": lambda s, d: lookup.job_by_id(_jobs(s, d), LOOKUP_ID),
    "poll_status": poll_status,
    "poll_precondition_errors": poll_precondition_errors,
    "job_view": lambda s, d: lookup.job_view(fifo.pending(_jobs(s, d)), nested=False),
    "finish_outcomes": finish_outcomes,
    "repo_basename": basenames,
    "repo_basename_odd": odd_basenames,
    # joins
    "enqueue_resolve": lambda s, d: dedup.enqueue_resolve(fx.requests_v(s, d), _jobs(s, d)),
    "enqueue_new_jobs": lambda s, d: dedup.enqueue_new_jobs(fx.requests_v(s, d), _jobs(s, d)),
    "poll_bulk": poll_bulk,
    "poll_not_found": poll_not_found,
    "route_jobs": route,
    "unroutable_jobs": unroutable,
    "cached_results": lambda s, d: lookup.cached_results(fx.requests_v(s, d), _jobs(s, d)),
    # dedup
    "dedup_first": lambda s, d: dedup.dedup_first(fx.requests_v(s, d)),
    "dedup_generations": lambda s, d: dedup.dedup_generations(fx.dedup_log(s, d), ["user_id"]),
    "dedup_strict": lambda s, d: dedup.dedup_strict(fx.strict_log(s, d), ["user_id"]),
    # fifo
    "next_job": lambda s, d: fifo.next_job(_jobs(s, d)),
    "next_k_jobs": lambda s, d: fifo.next_k_jobs(_jobs(s, d), NEXT_K),
    "claim_fifo": claim_fifo,
    "claim_fifo_surplus": lambda s, d: claim_fifo(s, d, surplus=True),
    "claim_interleaved": lambda s, d: fifo.claim_interleaved(fx.claim_log(s, d)),
    "claim_interleaved_starved":
        lambda s, d: fifo.claim_interleaved(fx.claim_log(s, d, starved=True)),
    "claim_by_repository": claim_by_repo,
    # updates
    "apply_finishes": apply_finishes,
    "rejected_finishes": rejected,
    "apply_finishes_strict":
        lambda s, d: update.apply_finishes(_jobs(s, d), fx.finish_v(s, d), strict=True),
    "rejected_finishes_strict":
        lambda s, d: update.rejected_finishes(_jobs(s, d), fx.finish_v(s, d), strict=True),
    "job_state_fold": fold,
    # audits
    "audit_live_key": lambda s, d: audit.audit_live_key(_jobs(s, d)),
    "audit_job_id": lambda s, d: audit.audit_job_id(_jobs(s, d)),
    "audit_line_id": lambda s, d: audit.audit_job_id(fx.line_ids_v(s, d)),
    "audit_workers": lambda s, d: audit.audit_workers(_jobs(s, d)),
    "audit_stuck": lambda s, d: audit.audit_stuck(_jobs(s, d), STUCK_NOW, STUCK_LIMIT_S),
    "audit_columns": lambda s, d: audit.audit_columns(_jobs(s, d)),
    "wait_run_times": lambda s, d: audit.wait_run_times(_jobs(s, d)),
    "wait_run_percentiles": lambda s, d: audit.wait_run_percentiles(_jobs(s, d)),
    "reuse_rate": lambda s, d: audit.reuse_rate(
        dedup.enqueue_resolve(fx.requests_v(s, d), _jobs(s, d))),
    # dependency closure
    "deps_closure": closure,
    "deps_reach": reach,
    "run_jobs": run_jobs_outcomes,
    "run_jobs_state": run_jobs_state,
    "run_jobs_results": run_jobs_results,
    "run_jobs_scoped": run_jobs_scoped,
    # streams and sinks
    **streams.QUERIES,
}
