"""Enqueue resolution and deduplication.

Contract: at most one non-failed job per KEY; any number of failed ones.  An
enqueue of a KEY with a live job returns that job; otherwise the first request
of the batch creates a job and later equal requests share it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtables.functions.naming import keyed_id
from jobtables.operators.chains import chain_members
from jobtables.operators.ordered import join_on_keys, running_sums
from jobtables.schema import KEY, STATUS_FAILED, STATUS_PENDING
from jobtables.scratch import Scratch


# A KEY is heavy if it has more than one in so many of a batch's requests.
HEAVY_SHARE = 200


def live_job_per_key(jobs: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """One live (non-failed) job per KEY: the lowest id.  Partial aggregation
    before the shuffle, so a hot KEY costs one row per task, not its history."""
    return (jobs.where(F.col("status") != STATUS_FAILED)
            .groupBy(*keys).agg(F.min("id").alias("live_id")))


def live_rows(jobs: DataFrame, keys: Sequence[str] = KEY) -> DataFrame:
    """``keys, live_id, live_status, live_url``: the live job per KEY with its
    state, from one aggregation."""
    first = F.min_by(F.struct("id", "status", "result_url"), F.col("id"))
    return jobs.where(F.col("status") != STATUS_FAILED).groupBy(*keys).agg(first.alias("f")).select(
        *keys, F.col("f.id").alias("live_id"), F.col("f.status").alias("live_status"),
        F.col("f.result_url").alias("live_url"))


def dedup_first(requests: DataFrame, keys: Sequence[str] = KEY, t: str = "request_time",
                rid: str = "request_id") -> DataFrame:
    """The first request per KEY by (time, id), with the request count.

    ``min_by`` over a struct is a partial+final hash aggregate: deterministic
    (unlike ``dropDuplicates``) and safe for hot keys.
    """
    first = F.min_by(F.struct(F.col(rid).alias("rid"), F.col(t).alias("t")),
                     F.struct(F.col(t), F.col(rid)))
    return (requests.groupBy(*keys)
            .agg(first.alias("_f"), F.count(F.lit(1)).alias("n_requests"))
            .select(*keys, F.col("_f.rid").alias(rid), F.col("_f.t").alias(t), "n_requests"))


def _with_live(firsts: DataFrame, jobs: DataFrame | None, live: DataFrame | None,
               keys: Sequence[str], how: str) -> DataFrame:
    """Firsts joined to the live jobs.  Both sides are grouped by KEY, whose
    columns are never null, so a plain join reuses their partitioning; a
    snapshot bucketed on KEY (``live``) is read in place."""
    if live is None:
        live = live_job_per_key(jobs, keys)
    return firsts.join(live, list(keys), how)


def _key_map(requests: DataFrame, jobs: DataFrame | None, live: DataFrame | None,
             keys: Sequence[str]) -> DataFrame:
    """Per KEY of the batch: the job every request of that KEY resolves to."""
    firsts = dedup_first(requests, keys).select(
        *keys, F.col("request_id").alias("first_request_id"),
        F.col("request_time").alias("first_request_time"), "n_requests")
    m = _with_live(firsts, jobs, live, keys, "left")
    return m.select(
        *keys, "first_request_id", "n_requests", F.col("live_id").isNull().alias("new_job"),
        F.coalesce(F.col("live_id").cast("string"), keyed_id(*keys, "first_request_id")).alias("job_id"))


def enqueue_resolve(requests: DataFrame, jobs: DataFrame | None = None, keys: Sequence[str] = KEY,
                    live: DataFrame | None = None) -> DataFrame:
    """Each request -> (request_id, KEY, job_id, created).  ``live``: a
    snapshot of live jobs (``sources.snapshots``) in place of the job table.

    The KEY map has one row per KEY and is written once; joining it back to
    the requests is a many-to-one join.  A KEY with more than one in
    ``HEAVY_SHARE`` of all requests is heavy; there are fewer than
    ``HEAVY_SHARE`` such KEYs whatever the data, so their map rows are
    broadcast and their requests are never shuffled.  All other KEYs join by a
    shuffle in which none is hot.  A request with a null in its KEY, which the
    schema does not allow, has no job.
    """
    scratch, keys = Scratch(requests.sparkSession, "enqueue"), list(keys)
    m = scratch.table(_key_map(requests, jobs, live, keys), "map")
    total = m.agg(F.sum("n_requests").alias("n")).first()["n"] or 0
    is_heavy = F.col("n_requests") * HEAVY_SHARE > total
    answer = [*keys, "job_id", "new_job", "first_request_id"]
    heavy, light = (m.where(c).select(*answer) for c in (is_heavy, ~is_heavy))
    if heavy.first() is None:
        r = requests.join(m.select(*answer), keys, "left")
    else:
        heavy = F.broadcast(heavy)
        r = requests.join(heavy, keys).unionByName(
            requests.join(heavy.select(*keys), keys, "left_anti").join(light, keys, "left"))
    return r.select(
        "request_id", *keys, "job_id",
        (F.col("new_job") & (F.col("request_id") == F.col("first_request_id"))).alias("created"),
    )


def enqueue_new_jobs(requests: DataFrame, jobs: DataFrame | None = None, keys: Sequence[str] = KEY,
                     live: DataFrame | None = None) -> DataFrame:
    """The job rows to insert: one pending job per KEY without a live job,
    queued at its first request's time, with a deterministic id."""
    fresh = _with_live(dedup_first(requests, keys), jobs, live, keys, "left_anti")
    return fresh.select(
        keyed_id(*keys, "request_id").alias("id"), *keys,
        F.lit(STATUS_PENDING).alias("status"),
        F.lit(None).cast("string").alias("worker"),
        F.col("request_time").alias("queue_time"),
        F.lit(None).cast("timestamp_ntz").alias("start_time"),
        F.lit(None).cast("timestamp_ntz").alias("finish_time"),
        F.lit(None).cast("string").alias("result_url"),
        F.lit(None).cast("string").alias("result_error"),
        F.col("request_id").alias("first_request_id"),
    )


def dedup_generations(log: DataFrame, keys: Sequence[str], t: str = "t", rid: str = "id",
                      kind: str = "kind", segments: int | None = None) -> DataFrame:
    """Replay interleaved requests and failures per KEY in closed form.

    A failure closes the KEY's current job, so the next request opens a new
    one; a success changes nothing.  ``gen`` = failures so far (current row
    included) per KEY in (t, id) order; the job of a request is the first
    request of its (KEY, gen).  Valid when every failure is about the KEY's
    current job (see :func:`dedup_strict` otherwise).

    Output per request: id, KEY, gen, job_id (the creating request's id),
    created.
    """
    g = running_sums(log, keys, [t, rid],
                     {"gen": F.when(F.col(kind) == "fail", 1).otherwise(0).cast("bigint")},
                     segments=segments)
    req = g.where(F.col(kind) == "request")
    first = (req.groupBy(*keys, "gen")
             .agg(F.min_by(F.col(rid), F.struct(F.col(t), F.col(rid))).alias("job_id")))
    out = join_on_keys(req, first, [*keys, "gen"])
    return out.select(rid, *keys, t, "gen", "job_id",
                      (F.col(rid) == F.col("job_id")).alias("created"))


def dedup_strict(log: DataFrame, keys: Sequence[str], t: str = "t", rid: str = "id",
                 kind: str = "kind", target: str = "target", max_rounds: int = 64
                 ) -> DataFrame:
    """Replay where each failure names the job (creating request id) it is
    about; a failure of a job that is not the KEY's current one is stale and
    changes nothing.

    A job j is closed by the first failure naming j after j's creation; no
    other failure can close it.  So the jobs of a KEY form a chain: from a
    creating request r, the next job is the first request after r's closing
    failure.  ``next`` is computed for every request with joins on ranks, and
    the chain from each KEY's first request is followed by pointer doubling
    (log2 of the chain length rounds of joins), so no KEY's history is ever
    gathered into one task or one group.  Returns E2's columns.
    """
    scratch = Scratch(log.sparkSession, "strict")
    ordered = scratch.table(running_sums(
        log.select(rid, *keys, t, kind, target), keys, [t, rid],
        {"n_req": F.when(F.col(kind) == "request", 1).otherwise(0).cast("bigint")}), "ordered")
    req = ordered.where(F.col(kind) == "request").select(rid, *keys, t, F.col("n_req").alias("rank"))
    fails = ordered.where(F.col(kind) == "fail").select(
        *keys, F.col(target).alias("named"), F.col("n_req").alias("reqs_before"))
    # the first failure naming request r that comes after r in r's own KEY (a
    # failure naming a request of another KEY can never be about the current job)
    named = req.select(*keys, F.col(rid).alias("named"), F.col("rank").alias("named_rank"))
    cand = join_on_keys(fails, named, [*keys, "named"])
    cand = cand.where(F.col("reqs_before") >= F.col("named_rank"))
    close = cand.groupBy(*keys, "named").agg(F.min("reqs_before").alias("reqs_before"))
    # next job = request of rank reqs_before + 1 in the same KEY
    nxt = close.select(F.col("named").alias(rid), *keys,
                       (F.col("reqs_before") + 1).alias("next_rank"))
    by_rank = req.select(*keys, F.col("rank").alias("next_rank"), F.col(rid).alias("next"))
    succ = join_on_keys(nxt, by_rank, [*keys, "next_rank"]).select(rid, "next")
    starts = req.where(F.col("rank") == 1).select(rid)
    # a creating request's position in its chain is its generation
    members = chain_members(succ, starts, scratch, node=rid, max_rounds=max_rounds)
    jobs = scratch.table(members.join(req, rid).select(
        *keys, F.col("rank").alias("job_rank"), F.col(rid).alias("job_id"),
        F.col("pos").alias("gen")), "jobs")
    # a request belongs to the latest job created at or before it: the running
    # count of jobs, a job being counted before the request that created it
    marks = req.select(rid, *keys, t, "rank", F.lit(0).cast("bigint").alias("is_job"))
    jm = jobs.select(*keys, F.col("job_rank").alias("rank"), F.lit(1).cast("bigint").alias("is_job"))
    both = marks.unionByName(jm, allowMissingColumns=True).withColumn("after", 1 - F.col("is_job"))
    numbered = running_sums(both, keys, ["rank", "after"], {"n_jobs": F.col("is_job")})
    mine = numbered.where(F.col("is_job") == 0).withColumn("gen", F.col("n_jobs") - 1)
    out = join_on_keys(mine, jobs.select(*keys, "gen", "job_id"), [*keys, "gen"], "left")
    return out.select(rid, *keys, t, "gen", "job_id",
                      (F.col(rid) == F.col("job_id")).alias("created"))
