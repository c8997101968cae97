"""Streaming operators (T1-T3, T5) over Structured Streaming.

Each keeps bounded state per key in the state store: a current job id (T1), an
aggregation buffer (T2), the watermark-bounded seen-set (T3), a start time with
an event-time timer (T5).  T1 and T5 are stateful processors with typed state
variables and timers (``transformWithStateInPandas``), which need the RocksDB
state store.  Rows of one key inside one micro-batch take effect in (t, id)
order; order across micro-batches is arrival order, as in the reference's
service.  T4, T6 and T3's side table of late rows run per micro-batch over
:class:`~jobtables.streaming.state_table.StateTable`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from jobtables.functions.timefmt import ntz_to_instant

STUCK_BUCKETS = 256


def _field(df: DataFrame, name: str) -> T.StructField:
    return next(f for f in df.schema.fields if f.name == name)


def _micros(times: pd.Series) -> np.ndarray:
    return times.astype("datetime64[us]").astype("int64").to_numpy()


def _only_timer(handle: StatefulProcessorHandle, at_ms: int) -> None:
    """Let ``at_ms`` be the key's one timer."""
    for old in list(handle.listTimers()):
        if old != at_ms:
            handle.deleteTimer(old)
    handle.registerTimer(at_ms)


# -- T1: streaming dedup with failure reset -----------------------------------

class _Dedup(StatefulProcessor):
    """State per KEY: the live job's id (none after a failure), and the latest
    time seen where a TTL is set."""

    def __init__(self, keys, t, rid, kind, id_type, ttl_ms, out_columns):
        self.keys, self.t, self.rid, self.kind = keys, t, rid, kind
        self.id_type, self.ttl_us, self.out_columns = id_type, (ttl_ms or 0) * 1000, out_columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", T.StructType([
            T.StructField("job_id", self.id_type, True), T.StructField("last_us", T.LongType(), True)]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # chunks are streamed; of a row only its time, id and kind are held
        held = [(_micros(c[self.t]), c[self.rid].to_numpy(), (c[self.kind] == "request").to_numpy(),
                 (c[self.kind] == "fail").to_numpy()) for c in rows]
        us, ids, request, fail = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((ids, us))
        us, ids, request, fail = us[order], ids[order], request[order], fail[order]
        live, last = self.current.get() if self.current.exists() else (None, None)
        quiet = np.zeros(len(us), bool)
        if self.ttl_us:  # the KEY went quiet for longer than the TTL
            before = np.maximum.accumulate(np.concatenate([[us[0] if last is None else last], us]))
            quiet = us - before[:-1] > self.ttl_us
            last = int(before[-1])
        # a failure, or a quiet time before a row, ends a generation
        upto = np.cumsum(quiet) + np.cumsum(fail)
        gen = (upto - fail)[request]
        found, first = np.unique(gen, return_index=True)
        asked = ids[request]
        opened = dict(zip(found.tolist(), asked[first].tolist()))
        if live is not None and 0 in opened:
            opened[0] = live
        end = int(upto[-1])
        live = opened.get(end, live if end == 0 else None)
        self.current.update((live, last))
        if self.ttl_us:
            _only_timer(self.handle, max((last + self.ttl_us) // 1000,
                                         timerValues.getCurrentWatermarkInMs() + 1))
        if len(asked):
            jobs = [opened[g] for g in gen.tolist()]
            out = {self.rid: asked, "job_id": jobs, "created": [a == j for a, j in zip(asked.tolist(), jobs)]}
            out |= {k: [key[i]] * len(asked) for i, k in enumerate(self.keys)}
            yield pd.DataFrame(out)[self.out_columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.current.clear()  # quiet for longer than the TTL
        return iter(())

    def close(self) -> None:
        pass


def dedup_stream(log: DataFrame, keys: Sequence[str], t: str = "t", rid: str = "id",
                 kind: str = "kind", state_ttl_ms: int | None = None,
                 delay: str | None = None) -> DataFrame:
    """E2 online.  State per KEY: the id of the KEY's live job (none after
    a failure).  Output per request: id, KEY, job_id, created (append mode).

    ``state_ttl_ms``: a KEY quiet for longer than that (event time) forgets its
    job, and its state is purged once the watermark passes; this *changes*
    results (a later equal request then opens a new job), so it is off by
    default: by contract a success is reused for ever.  With a TTL the
    watermark ``delay`` must be given: rows later than that are not answered,
    and Spark counts them (``numRowsDroppedByWatermark`` of the query's state
    operator progress); choose it above the lateness of the source.
    """
    if state_ttl_ms and delay is None:
        raise ValueError("a state TTL needs a watermark delay: later rows are dropped")
    keys = list(keys)
    id_type = _field(log, rid).dataType
    out_schema = T.StructType([_field(log, rid), *[_field(log, k) for k in keys],
                               T.StructField("job_id", id_type, True),
                               T.StructField("created", T.BooleanType(), False)])
    cols = [rid, *keys, t, kind]
    if state_ttl_ms:
        log = (log.withColumn("_event_time", ntz_to_instant(t))
               .withWatermark("_event_time", delay))
        cols.append("_event_time")
    processor = _Dedup(keys, t, rid, kind, id_type, state_ttl_ms, out_schema.names)
    return log.select(*cols).groupBy(*keys).transformWithStateInPandas(
        processor, out_schema, "Append", "EventTime" if state_ttl_ms else "None")


# -- T2: streaming current state ----------------------------------------------

def job_state_stream(events: DataFrame) -> DataFrame:
    """U4 online, as a streaming aggregation (update mode): the state
    store keeps one aggregation buffer per job id."""
    from jobtables.operators.update import job_state_fold
    return job_state_fold(events)


# -- T3: exact-duplicate drop with bounded state -------------------------------

def drop_resent(stream: DataFrame, id_col: str, ts_col: str, delay: str) -> DataFrame:
    """Drop re-sent copies of a row (same ``id_col``) that arrive within
    ``delay`` of event time; state is purged as the watermark passes, and a
    copy older than the watermark is dropped as late
    (:func:`~jobtables.streaming.resent.start_resent_stream` keeps late rows)."""
    return (stream.withColumn("_event_time", ntz_to_instant(ts_col))
            .withWatermark("_event_time", delay)
            .dropDuplicatesWithinWatermark([id_col]).drop("_event_time"))


# -- T5: stuck-job alarm -------------------------------------------------------

_NONE = np.iinfo(np.int64).max  # of a start or finish: not seen yet


def _firsts(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per job: its earliest start with that start's worker, its earliest
    finish.  Of equal starts the one held already counts, then the first worker."""
    finish = rows.groupby("job", dropna=False, sort=False)["finish"].transform("min")
    return rows.assign(finish=finish).sort_values(["start", "new", "worker"]).drop_duplicates("job")


class _StuckAlarm(StatefulProcessor):
    """State per bucket of jobs, as arrays: of every job its first start and that
    start's worker, its first finish, whether the alarm is decided, and when the
    job is due; one timer, at the earliest of these times.  A call handles all
    jobs of its bucket at once, so the cost of a call is not one of a job."""

    FIELDS = {"job": T.StringType(), "worker": T.StringType(), "start": T.LongType(),
              "finish": T.LongType(), "decided": T.BooleanType(), "due": T.LongType()}

    def __init__(self, limit_us: int):
        self.limit_us = limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getValueState("jobs", T.StructType([
            T.StructField(n, T.ArrayType(t), False) for n, t in self.FIELDS.items()]))

    def _held(self) -> pd.DataFrame:
        values = self.jobs.get() if self.jobs.exists() else [[]] * len(self.FIELDS)
        return pd.DataFrame({n: np.array(v, {"decided": bool, "job": object, "worker": object}.get(n, np.int64))
                             for n, v in zip(self.FIELDS, values)})

    def _hold(self, jobs: pd.DataFrame) -> None:
        if len(jobs):
            self.jobs.update(tuple(jobs[n].tolist() for n in self.FIELDS))
        else:
            self.jobs.clear()

    def _alarms(self, jobs: pd.DataFrame) -> Iterator[pd.DataFrame]:
        begun = jobs[jobs["start"] != _NONE]
        late = begun[begun["finish"] > begun["start"] + self.limit_us]  # or none
        if len(late):
            yield pd.DataFrame({"job_id": late["job"], "worker": late["worker"],
                                "start_time": late["start"].to_numpy().astype("datetime64[us]")})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        parts = []
        for chunk in rows:  # a row per job is held of each
            begins = (chunk["kind"] == "start").to_numpy()
            ends = chunk["kind"].isin(["succeed", "fail"]).to_numpy()
            us = _micros(chunk["ts"])
            seen = pd.DataFrame({
                "job": chunk["job"].to_numpy(object), "worker": np.where(begins, chunk["worker"], None),
                "start": np.where(begins, us, _NONE), "finish": np.where(ends, us, _NONE),
                "decided": False, "due": 0, "new": True})[begins | ends]
            if len(seen):
                parts.append(_firsts(seen))
        if not parts:
            return  # requests only: no state
        held = self._held().assign(new=False)
        jobs = pd.concat([held, *parts] if len(held) else parts, ignore_index=True)
        by_job = jobs.groupby("job", dropna=False, sort=False)
        jobs = jobs.assign(**{n: by_job[n].transform("max") for n in ("decided", "due")},
                           touched=by_job["new"].transform("max"))
        jobs = _firsts(jobs)
        now = timerValues.getCurrentWatermarkInMs()
        begun = jobs["start"] != _NONE
        until = jobs["start"].where(begun, jobs["finish"]) // 1000
        until = ((jobs["start"].where(begun, 0) + self.limit_us) // 1000).where(begun, until)
        # the watermark is past the limit already
        decide = jobs["touched"] & begun & (until <= now) & ~jobs["decided"]
        yield from self._alarms(jobs[decide])
        jobs = jobs.assign(decided=jobs["decided"] | decide,
                           due=jobs["due"].where(~jobs["touched"], until.clip(lower=now) + 1))
        self._hold(jobs)
        _only_timer(self.handle, int(jobs["due"].min()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        jobs = self._held()
        due = jobs["due"] <= max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        yield from self._alarms(jobs[due & ~jobs["decided"]])
        jobs = jobs[~due]
        self._hold(jobs)
        if len(jobs):
            self.handle.registerTimer(int(jobs["due"].min()))

    def close(self) -> None:
        pass


def stuck_alarm_stream(events: DataFrame, limit_ms: int, delay: str,
                       buckets: int = STUCK_BUCKETS) -> DataFrame:
    """T5: A4 online.  One alarm row (job_id, worker, start_time) per job whose
    first start has no succeed or fail within ``limit_ms`` of event time.

    The decision is by event time: it falls when the watermark passes start +
    limit, so neither the order of arrival nor the batches change it.  Of a
    job's starts the earliest counts, and a finish that arrives before its
    start is kept for it.  ``delay`` is how late a row may be; later ones are
    dropped and counted by Spark (``numRowsDroppedByWatermark``).  A decided
    job is remembered until the watermark has passed it.  ``request`` rows
    keep no state.  The state lies in
    ``buckets`` arrays by a hash of the job id: a bucket's open jobs and its rows of
    a micro-batch are handled together, in one task.
    """
    id_type = _field(events, "job_id").dataType
    out_schema = T.StructType([T.StructField("job_id", T.StringType(), True),
                               T.StructField("worker", T.StringType(), True),
                               T.StructField("start_time", T.TimestampNTZType(), True)])
    # requests move the watermark, so they are skipped in the processor, not here
    return (events.withColumn("_event_time", ntz_to_instant("ts"))
            .withWatermark("_event_time", delay)
            .select(F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int").alias("bucket"),
                    F.col("job_id").cast("string").alias("job"), "kind", "ts", "worker", "_event_time")
            .groupBy("bucket")
            .transformWithStateInPandas(_StuckAlarm(limit_ms * 1000), out_schema, "Append", "EventTime")
            .withColumn("job_id", F.col("job_id").cast(id_type)))
