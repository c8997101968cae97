"""DuckDB SQL twins of the registered queries (the correctness oracle).

The views of FIXTURES.md §3 are inlined as CTEs over the driver's base tables.
Ranks and running sums use plain global windows here (the oracle may sort in
one thread); the Spark side computes the same numbers without one task.
Parameters are those of :mod:`jobtables.plans.catalog`.
"""

from __future__ import annotations

from jobtables.plans.streams import STUCK_STREAM_LIMIT_S
from jobtables.plans.catalog import (
    LOOKUP_ID,
    NEXT_K,
    NOW,
    RESULT_BUCKET,
    STUCK_LIMIT_S,
    STUCK_NOW,
)

KEYS = "repository, commit_hash, query_string"

JOBS_V = """jobs_v AS (SELECT o_orderkey AS id,
 'repo/' || CAST(o_custkey % 30 AS VARCHAR) AS repository,
 'c' || CAST(o_orderkey % 5 AS VARCHAR) AS commit_hash,
 'q' || CAST(o_custkey % 997 AS VARCHAR) AS query_string,
 CASE WHEN o_orderstatus='O' THEN 'pending' WHEN o_orderstatus='P' THEN 'running'
      WHEN o_totalprice<250000 THEN 'failed' ELSE 'succeeded' END AS status,
 CASE WHEN o_orderstatus<>'O' THEN 'worker-' || CAST(o_custkey % 10 AS VARCHAR) END AS worker,
 o_orderdate AS queue_time,
 CASE WHEN o_orderstatus<>'O' THEN o_orderdate + (o_orderkey % 7) * INTERVAL '1' DAY END AS start_time,
 CASE WHEN o_orderstatus='F' THEN o_orderdate + (o_orderkey % 7 + o_orderkey % 3 + 1) * INTERVAL '1' DAY END AS finish_time,
 CASE WHEN o_orderstatus='F' AND o_totalprice>=250000 AND o_orderkey % 50 <> 0
      THEN 'gs://bucket/' || CAST(o_orderkey AS VARCHAR) || '.pb' END AS result_url,
 CASE WHEN o_orderstatus='F' AND o_totalprice<250000 AND o_orderkey % 50 <> 0
      THEN 'some query failure' END AS result_error
FROM orders)"""

JOB_COLS = ("id, repository, commit_hash, query_string, status, worker, queue_time, "
            "start_time, finish_time, result_url, result_error")

REQUESTS_V = """requests_v AS (SELECT event_id AS request_id,
 'repo/' || CAST((event_id % 1500) % 30 AS VARCHAR) AS repository,
 'c' || CAST(event_id % 5 AS VARCHAR) AS commit_hash,
 'q' || CAST((event_id % 1500) % 997 AS VARCHAR) AS query_string,
 ts AS request_time FROM events WHERE event_type IN ('click','view'))"""

FINISH_V = """finish_v AS (SELECT event_id AS finish_id, CAST((event_id - event_id % 3) * 2 AS BIGINT) AS job_id,
 CASE WHEN event_type='purchase' THEN 'gs://bucket/' || CAST(event_id*2 AS VARCHAR) || '.pb' END
   AS query_result_location,
 CASE WHEN event_type='error' THEN 'query failed' END AS failure_message,
 ts AS finish_ts FROM events WHERE event_type IN ('purchase','error','signup'))"""

REPOS_V = """repos_v AS (SELECT 'repo/' || CAST(n_nationkey AS VARCHAR) AS repository,
 n_name AS workspace FROM nation)"""

POLLS_V = """polls_v AS (SELECT event_id AS poll_id,
 'worker-' || CAST(user_id % 10 AS VARCHAR) AS worker_name,
 'repo/' || CAST(user_id % 30 AS VARCHAR) AS repository,
 ts AS poll_time FROM events WHERE event_type IN ('purchase','error'))"""

DEDUP_LOG = """dlog AS (SELECT event_id AS id, user_id, ts AS t,
 CASE WHEN event_type='error' THEN 'fail' ELSE 'request' END AS kind
 FROM events WHERE event_type IN ('click','view','error'))"""

CLAIM_LOG = """clog AS (SELECT event_id AS id, ts AS t,
 CASE WHEN event_type IN ('click','view') THEN 'enqueue' ELSE 'poll' END AS kind
 FROM events WHERE event_type IN ('click','view','purchase','error'))"""

CLAIM_LOG_STARVED = """clog AS (SELECT event_id AS id, ts AS t,
 CASE WHEN event_type = 'click' THEN 'enqueue' ELSE 'poll' END AS kind FROM events)"""

EDGES_V = """edges_v AS (
 SELECT DISTINCT src, dst FROM (
  SELECT 'o' || CAST(l_orderkey AS VARCHAR) AS src, 'p' || CAST(l_partkey AS VARCHAR) AS dst FROM lineitem
  UNION ALL SELECT 'o' || CAST(l_orderkey AS VARCHAR), 's' || CAST(l_suppkey AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'o' || CAST(o_orderkey AS VARCHAR), 'c' || CAST(o_custkey AS VARCHAR) FROM orders
  UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'n' || CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), 'n' || CAST(s_nationkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR) FROM nation))"""

ROOTS_V = """roots_v AS (SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS root FROM orders
 WHERE o_orderpriority = '1-URGENT')"""

NOW_SQL = f"TIMESTAMP '{NOW}'"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _keyed(*cols: str) -> str:
    """SQL twin of functions.naming.keyed_id."""
    parts = []
    for c in cols:
        v = f"CAST({c} AS VARCHAR)"
        parts.append(f"CAST(length({v}) AS VARCHAR) || ':' || {v}")
    return "sha256(" + " || ".join(parts) + ")"


# -- RFC 3339 text ----------------------------------------------------------

def _enc_z(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%SZ')"


def _enc_local(c: str) -> str:
    return f"strftime({c} - INTERVAL 8 HOUR, '%Y-%m-%dT%H:%M:%S') || '-08:00'"


def _dump(corrupt: bool) -> str:
    def enc(c):
        return f"CASE WHEN priority = '1-URGENT' THEN {_enc_local(c)} ELSE {_enc_z(c)} END"
    q = enc("queue_time")
    if corrupt:
        q = f"CASE WHEN priority = '5-LOW' THEN strftime(queue_time, '%Y-%m-%dT%H:%M:%S') ELSE {q} END"
    jv = JOBS_V.replace("FROM orders)", ", o_orderpriority AS priority FROM orders)")
    return (jv + ",\n dump AS (SELECT CAST(id AS VARCHAR) AS id, repository, commit_hash, "
            f"query_string, status, worker, {q} AS queue_time, {enc('start_time')} AS start_time, "
            f"{enc('finish_time')} AS finish_time, result_url AS query_result_url, "
            "result_error AS query_error FROM jobs_v)")


def _parse(c: str) -> str:
    return (f"timezone('UTC', try_strptime(regexp_replace({c}, 'Z$', '+00:00'), "
            "'%Y-%m-%dT%H:%M:%S%z'))")


SQL: dict[str, str] = {}

SQL["scan_jobs"] = _with(_dump(False)) + (
    "SELECT id, repository, commit_hash, query_string, status, worker, "
    f"{_parse('queue_time')} AS queue_time, {_parse('start_time')} AS start_time, "
    f"{_parse('finish_time')} AS finish_time, query_result_url AS result_url, "
    "query_error AS result_error FROM dump")

SQL["quarantine_jobs"] = _with(_dump(True)) + " UNION ALL ".join(
    f"SELECT id, '{c}' AS \"column\", {c} AS value FROM dump "
    f"WHERE {c} IS NOT NULL AND {_parse(c)} IS NULL"
    for c in ("queue_time", "start_time", "finish_time"))

SQL["result_manifest"] = _with(JOBS_V) + (
    f"SELECT id AS job_id, result_url, 'gs://{RESULT_BUCKET}/' || CAST(id AS VARCHAR) || '.pb' "
    f"AS expected_url, COALESCE(result_url = 'gs://{RESULT_BUCKET}/' || CAST(id AS VARCHAR) "
    "|| '.pb', false) AS url_ok FROM jobs_v WHERE status = 'succeeded'")

def _json(c: str, value: str) -> str:
    return f"CASE WHEN {value} IS NOT NULL THEN ',\"{c}\":\"' || {value} || '\"' ELSE '' END"


_LINES = _dump(True) + """, lines AS (SELECT *, CAST(id AS BIGINT) AS k,
 CASE WHEN CAST(id AS BIGINT) % 83 = 0 THEN '' ELSE query_string END AS q,
 CASE WHEN CAST(id AS BIGINT) % 89 <> 0 THEN status END AS s FROM dump),
 whole AS (SELECT *, '{"id":"' || id || '"' || """ + " || ".join(
    [_json("repository", "repository"), _json("commit_hash", "commit_hash"),
     _json("query_string", "q"), _json("status", "s")]
    + [_json(c, c) for c in ("worker", "queue_time", "start_time", "finish_time", "query_result_url",
                             "query_error")]) + """ || '}' AS record FROM lines)"""

SQL["dump_defects"] = _with(_LINES) + (
    "SELECT CAST(NULL AS VARCHAR) AS id, 'malformed record' AS reason, CAST(NULL AS VARCHAR) "
    "AS \"column\", substr(record, 1, 60) AS record FROM whole WHERE k % 97 = 0 "
    "UNION ALL SELECT id, 'missing value', 'status', record FROM whole WHERE k % 97 <> 0 AND s IS NULL "
    + "".join(f"UNION ALL SELECT id, 'bad time', '{c}', record FROM whole WHERE k % 97 <> 0 "
              f"AND {c} IS NOT NULL AND {_parse(c)} IS NULL "
              for c in ("queue_time", "start_time", "finish_time")))

SQL["dump_jobs"] = _with(_LINES) + (
    f"SELECT id, repository, commit_hash, q AS query_string, s AS status, worker, "
    f"{_parse('queue_time')} AS queue_time, {_parse('start_time')} AS start_time, "
    f"{_parse('finish_time')} AS finish_time, query_result_url AS result_url, query_error AS result_error "
    f"FROM whole WHERE k % 97 <> 0 AND s IS NOT NULL AND {_parse('queue_time')} IS NOT NULL")

SQL["rfc3339_encode"] = _with(JOBS_V) + (
    f"SELECT id, {_enc_z('queue_time')} AS queue_time_text, "
    f"{_enc_z('start_time')} AS start_time_text, {_enc_z('finish_time')} AS finish_time_text "
    "FROM jobs_v")

# -- projections / filters -----------------------------------------------------

SQL["pending_jobs"] = _with(JOBS_V) + f"SELECT {JOB_COLS} FROM jobs_v WHERE status = 'pending'"
SQL["live_jobs"] = _with(JOBS_V) + f"SELECT {JOB_COLS} FROM jobs_v WHERE status <> 'failed'"
SQL["job_by_id"] = _with(JOBS_V) + f"SELECT {JOB_COLS} FROM jobs_v WHERE id = {LOOKUP_ID}"

POLL_ERROR = """CASE WHEN status IN ('pending','running') THEN NULL
 WHEN status = 'succeeded' THEN CASE WHEN result_url IS NULL
      THEN 'query succeeded but ResultURL is not set' END
 WHEN status = 'failed' THEN CASE WHEN result_error IS NULL
      THEN 'query failed but ResultError is not set' END
 ELSE 'can''t poll job with status: "' || COALESCE(status, '') || '"' END"""

POLL_STATE = f"""CASE WHEN ({POLL_ERROR}) IS NOT NULL THEN 'error'
 WHEN status IN ('pending','running') THEN 'in_progress'
 WHEN status = 'succeeded' THEN 'success' ELSE 'failure' END"""


def _poll_cols(delay: int = 5) -> str:
    return f"""({POLL_STATE}) AS poll_state,
 CASE WHEN ({POLL_STATE}) = 'in_progress' THEN {NOW_SQL} + INTERVAL {delay} SECOND END
   AS next_poll_time,
 CASE WHEN ({POLL_STATE}) = 'success' THEN result_url END AS results_url,
 CASE WHEN ({POLL_STATE}) = 'failure' THEN result_error END AS failure_message,
 ({POLL_ERROR}) AS error"""


SQL["poll_status"] = _with(JOBS_V) + f"SELECT id, status, {_poll_cols()} FROM jobs_v"

SQL["poll_precondition_errors"] = _with(JOBS_V) + (
    f"SELECT * FROM (SELECT id, status, ({POLL_ERROR}) AS error FROM jobs_v) "
    "WHERE error IS NOT NULL")

SQL["job_view"] = _with(JOBS_V) + (
    "SELECT id, query_string AS query, repository AS source_repo, "
    "commit_hash AS source_committish FROM jobs_v WHERE status = 'pending'")

SQL["finish_outcomes"] = _with(FINISH_V) + """SELECT finish_id, job_id,
 CASE WHEN query_result_location IS NOT NULL THEN 'succeeded'
      WHEN failure_message IS NOT NULL THEN 'failed' END AS status,
 CASE WHEN query_result_location IS NOT NULL THEN query_result_location
      ELSE failure_message END AS result,
 (query_result_location IS NULL AND failure_message IS NULL) AS unset, finish_ts
FROM finish_v"""

SQL["repo_basename"] = _with(JOBS_V, REQUESTS_V) + """SELECT repository,
 CASE WHEN repository = '' THEN '.' WHEN rtrim(repository, '/') = '' THEN '/'
      ELSE regexp_extract(rtrim(repository, '/'), '[^/]*$') END AS basename
FROM (SELECT repository FROM jobs_v UNION SELECT repository FROM requests_v)"""

SQL["repo_basename_odd"] = """SELECT repository,
 CASE WHEN repository = '' THEN '.' WHEN rtrim(repository, '/') = '' THEN '/'
      ELSE regexp_extract(rtrim(repository, '/'), '[^/]*$') END AS basename
FROM (SELECT DISTINCT CASE event_id % 12 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN '//'
 WHEN 3 THEN '///' WHEN 4 THEN r WHEN 5 THEN r || '/' WHEN 6 THEN '/' || r
 WHEN 7 THEN 'a//' || r || '//' WHEN 8 THEN 'https://host/x/' || r || '/' WHEN 9 THEN r || '.git'
 WHEN 10 THEN './' || r ELSE r || '/..' END AS repository
 FROM (SELECT event_id, 'r' || CAST(event_id % 11 AS VARCHAR) AS r FROM events))"""

# -- joins ---------------------------------------------------------------------

LIVE = (f"live AS (SELECT {KEYS}, MIN(id) AS live_id FROM jobs_v WHERE status <> 'failed' "
        f"GROUP BY {KEYS})")
FIRSTS = (f"firsts AS (SELECT {KEYS}, request_id AS first_request_id, request_time AS "
          f"first_request_time, n_requests FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {KEYS} "
          f"ORDER BY request_time, request_id) AS rn, COUNT(*) OVER (PARTITION BY {KEYS}) "
          "AS n_requests FROM requests_v) WHERE rn = 1)")
KEYMAP = (f"km AS (SELECT f.*, l.live_id FROM firsts f LEFT JOIN live l USING ({KEYS}))")
RESOLVED = (f"resolved AS (SELECT r.request_id, r.repository, r.commit_hash, r.query_string, "
            f"COALESCE(CAST(km.live_id AS VARCHAR), "
            f"{_keyed('km.repository', 'km.commit_hash', 'km.query_string', 'km.first_request_id')})"
            " AS job_id, (km.live_id IS NULL AND r.request_id = km.first_request_id) AS created "
            f"FROM requests_v r JOIN km USING ({KEYS}))")

SQL["enqueue_resolve"] = _with(JOBS_V, REQUESTS_V, LIVE, FIRSTS, KEYMAP, RESOLVED) + \
    "SELECT * FROM resolved"

SQL["enqueue_new_jobs"] = _with(JOBS_V, REQUESTS_V, LIVE, FIRSTS) + (
    f"SELECT {_keyed('f.repository', 'f.commit_hash', 'f.query_string', 'f.first_request_id')} "
    "AS id, f.repository, f.commit_hash, f.query_string, 'pending' AS status, "
    "CAST(NULL AS VARCHAR) AS worker, f.first_request_time AS queue_time, "
    "CAST(NULL AS TIMESTAMP) AS start_time, CAST(NULL AS TIMESTAMP) AS finish_time, "
    "CAST(NULL AS VARCHAR) AS result_url, CAST(NULL AS VARCHAR) AS result_error, "
    "f.first_request_id FROM firsts f LEFT JOIN live l USING "
    f"({KEYS}) WHERE l.live_id IS NULL")

POLL_IDS = "ids AS (SELECT DISTINCT job_id AS id FROM finish_v)"

SQL["poll_bulk"] = _with(JOBS_V, FINISH_V, POLL_IDS) + f"""SELECT ids.id,
 CASE WHEN j.id IS NULL THEN 'error' ELSE {POLL_STATE} END AS poll_state,
 CASE WHEN j.id IS NOT NULL AND ({POLL_STATE}) = 'in_progress'
      THEN {NOW_SQL} + INTERVAL 5 SECOND END AS next_poll_time,
 CASE WHEN j.id IS NOT NULL AND ({POLL_STATE}) = 'success' THEN result_url END AS results_url,
 CASE WHEN j.id IS NOT NULL AND ({POLL_STATE}) = 'failure' THEN result_error END
   AS failure_message,
 CASE WHEN j.id IS NULL THEN 'job not found' ELSE {POLL_ERROR} END AS error
FROM ids LEFT JOIN jobs_v j ON ids.id = j.id"""

SQL["poll_not_found"] = _with(JOBS_V, FINISH_V, POLL_IDS) + (
    "SELECT id FROM ids WHERE id NOT IN (SELECT id FROM jobs_v)")

WS_ERR = "'workspace for repo \"' || repository || '\" not found'"

SQL["route_jobs"] = _with(JOBS_V, REPOS_V) + (
    f"SELECT j.id, j.repository, r.workspace, CASE WHEN r.workspace IS NULL THEN "
    f"'workspace for repo \"' || j.repository || '\" not found' END AS route_error "
    "FROM jobs_v j LEFT JOIN repos_v r USING (repository) WHERE j.status = 'running'")

SQL["unroutable_jobs"] = _with(JOBS_V, REPOS_V) + (
    f"SELECT id, repository, {WS_ERR} AS route_error FROM jobs_v WHERE status = 'running' "
    "AND repository NOT IN (SELECT repository FROM repos_v)")

SQL["cached_results"] = _with(JOBS_V, REQUESTS_V, LIVE) + (
    "SELECT r.request_id, r.repository, r.commit_hash, r.query_string, l.live_id AS job_id, "
    f"j.result_url FROM requests_v r JOIN live l USING ({KEYS}) JOIN jobs_v j "
    "ON j.id = l.live_id WHERE j.status = 'succeeded'")

# -- dedup ---------------------------------------------------------------------

SQL["dedup_first"] = _with(REQUESTS_V, FIRSTS) + (
    f"SELECT {KEYS}, first_request_id AS request_id, first_request_time AS request_time, "
    "n_requests FROM firsts")

SQL["dedup_generations"] = _with(DEDUP_LOG) + """, g AS (SELECT *, CAST(SUM(CASE WHEN kind='fail'
 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING
 AND CURRENT ROW) AS BIGINT) AS gen FROM dlog),
 r AS (SELECT * FROM g WHERE kind = 'request')
SELECT id, user_id, t, gen, FIRST_VALUE(id) OVER w AS job_id, id = FIRST_VALUE(id) OVER w AS created
FROM r WINDOW w AS (PARTITION BY user_id, gen ORDER BY t, id)"""

SQL["dedup_strict"] = "WITH RECURSIVE " + DEDUP_LOG + """,
 slog AS (SELECT *, CASE WHEN kind = 'fail' THEN CASE WHEN id % 5 = 0
   THEN first_value(CASE WHEN kind = 'request' THEN id END IGNORE NULLS) OVER (PARTITION BY user_id
     ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
   ELSE last_value(CASE WHEN kind = 'request' THEN id END IGNORE NULLS) OVER (PARTITION BY user_id
     ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END END AS target FROM dlog),
 o AS (SELECT *, CAST(SUM(CASE WHEN kind = 'request' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id
   ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS n_req FROM slog),
 req AS (SELECT id, user_id, t, n_req AS rank FROM o WHERE kind = 'request'),
 close AS (SELECT f.target AS named, MIN(f.n_req) AS reqs_before
   FROM o f JOIN req r ON r.id = f.target AND r.user_id = f.user_id
   WHERE f.kind = 'fail' AND f.n_req >= r.rank GROUP BY f.target),
 chain(user_id, job_id, rank) AS (SELECT user_id, id, rank FROM req WHERE rank = 1
   UNION ALL SELECT c.user_id, r.id, r.rank FROM chain c JOIN close cl ON cl.named = c.job_id
   JOIN req r ON r.user_id = c.user_id AND r.rank = cl.reqs_before + 1),
 mine AS (SELECT r.id, r.user_id, r.t, arg_max(c.job_id, c.rank) AS job_id,
   CAST(COUNT(*) - 1 AS BIGINT) AS gen
   FROM req r JOIN chain c ON c.user_id = r.user_id AND c.rank <= r.rank
   GROUP BY r.id, r.user_id, r.t)
SELECT id, user_id, t, gen, job_id, id = job_id AS created FROM mine"""

# -- fifo ----------------------------------------------------------------------

SQL["next_job"] = _with(JOBS_V) + (
    f"SELECT {JOB_COLS} FROM jobs_v WHERE status = 'pending' ORDER BY queue_time, id LIMIT 1")
SQL["next_k_jobs"] = _with(JOBS_V) + (
    f"SELECT {JOB_COLS} FROM jobs_v WHERE status = 'pending' ORDER BY queue_time, id "
    f"LIMIT {NEXT_K}")

SQL["claim_fifo"] = _with(JOBS_V, POLLS_V) + """, q AS (SELECT id, repository, queue_time,
 ROW_NUMBER() OVER (ORDER BY queue_time, id) AS rank FROM jobs_v WHERE status = 'pending'),
 p AS (SELECT *, ROW_NUMBER() OVER (ORDER BY poll_time, poll_id) AS rank FROM polls_v)
SELECT p.poll_id, p.worker_name, p.poll_time, p.rank, q.id AS job_id, q.repository,
 q.queue_time, p.poll_time + INTERVAL 10 SECOND AS next_poll_time, q.id IS NOT NULL AS claimed
FROM p LEFT JOIN q USING (rank)"""

_ALL_POLLS = POLLS_V.replace(" WHERE event_type IN ('purchase','error')", "")
SQL["claim_fifo_surplus"] = SQL["claim_fifo"].replace(POLLS_V, _ALL_POLLS)

SQL["claim_by_repository"] = _with(JOBS_V, POLLS_V) + """, q AS (SELECT id, repository,
 queue_time, ROW_NUMBER() OVER (PARTITION BY repository ORDER BY queue_time, id) AS rank
 FROM jobs_v WHERE status = 'pending'),
 p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY repository ORDER BY poll_time, poll_id) AS rank
 FROM polls_v)
SELECT p.poll_id, p.repository, p.worker_name, p.poll_time, p.rank, q.id AS job_id,
 q.queue_time, q.id IS NOT NULL AS claimed
FROM p LEFT JOIN q USING (repository, rank)"""

_INTERLEAVED = """, s AS (SELECT *, CAST(SUM(CASE WHEN kind='enqueue' THEN 1 ELSE -1 END)
 OVER (ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS S,
 CAST(SUM(CASE WHEN kind='enqueue' THEN 1 ELSE 0 END)
 OVER (ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS E FROM clog),
 m AS (SELECT *, LEAST(COALESCE(MIN(S) OVER (ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING
 AND 1 PRECEDING), 0), 0) AS M FROM s),
 r AS (SELECT *, CASE WHEN kind = 'enqueue' THEN E WHEN S >= M THEN E - (S - LEAST(M, S))
 END AS rank FROM m)
SELECT p.id AS poll_id, p.t AS poll_t, j.id AS job_id, j.t AS job_t, p.rank
FROM (SELECT * FROM r WHERE kind = 'poll') p
LEFT JOIN (SELECT * FROM r WHERE kind = 'enqueue') j ON p.rank = j.rank"""

SQL["claim_interleaved"] = _with(CLAIM_LOG) + _INTERLEAVED
SQL["claim_interleaved_starved"] = _with(CLAIM_LOG_STARVED) + _INTERLEAVED

# -- updates -------------------------------------------------------------------

_FSET = """fset AS (SELECT finish_id, job_id, finish_ts,
 CASE WHEN query_result_location IS NOT NULL THEN 'succeeded'
      WHEN failure_message IS NOT NULL THEN 'failed' END AS st,
 COALESCE(query_result_location, failure_message) AS res FROM finish_v
 WHERE query_result_location IS NOT NULL OR failure_message IS NOT NULL)"""


def _last(name: str, where: str) -> str:
    return (f"{name} AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY job_id "
            f"ORDER BY finish_ts DESC, finish_id DESC) AS rn FROM fset WHERE {where}) "
            "WHERE rn = 1)")


SQL["apply_finishes"] = _with(JOBS_V, FINISH_V, _FSET, _last("lastf", "true"),
                              _last("lasts", "st = 'succeeded'"),
                              _last("lastx", "st = 'failed'")) + """SELECT j.id, j.repository,
 j.commit_hash, j.query_string, COALESCE(lf.st, j.status) AS status, j.worker, j.queue_time,
 j.start_time, CASE WHEN lf.job_id IS NOT NULL THEN lf.finish_ts ELSE j.finish_time END
   AS finish_time,
 COALESCE(ls.res, j.result_url) AS result_url, COALESCE(lx.res, j.result_error) AS result_error
FROM jobs_v j LEFT JOIN lastf lf ON lf.job_id = j.id LEFT JOIN lasts ls ON ls.job_id = j.id
 LEFT JOIN lastx lx ON lx.job_id = j.id"""

SQL["rejected_finishes"] = _with(JOBS_V, FINISH_V, _FSET) + """, per_id AS (SELECT id,
 COUNT(*) AS n FROM jobs_v GROUP BY id)
SELECT f.finish_id, f.job_id, CASE WHEN p.n IS NULL THEN 'job not found'
 ELSE 'more than one job with this id' END AS reason
FROM fset f LEFT JOIN per_id p ON p.id = f.job_id WHERE p.n IS NULL OR p.n > 1"""

_STRICT = """firstf AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY job_id
 ORDER BY finish_ts, finish_id) AS rn FROM fset) WHERE rn = 1)"""
SQL["apply_finishes_strict"] = _with(JOBS_V, FINISH_V, _FSET, _STRICT) + """SELECT j.id,
 j.repository, j.commit_hash, j.query_string, COALESCE(f.st, j.status) AS status, j.worker,
 j.queue_time, j.start_time, COALESCE(f.finish_ts, j.finish_time) AS finish_time,
 COALESCE(CASE WHEN f.st = 'succeeded' THEN f.res END, j.result_url) AS result_url,
 COALESCE(CASE WHEN f.st = 'failed' THEN f.res END, j.result_error) AS result_error
FROM jobs_v j LEFT JOIN firstf f ON f.job_id = j.id AND j.status = 'running'"""
SQL["rejected_finishes_strict"] = _with(JOBS_V, FINISH_V, _FSET, _STRICT) + """, per_id AS (
 SELECT id, COUNT(*) AS n, MAX(status) AS st FROM jobs_v GROUP BY id),
 x AS (SELECT f.finish_id, f.job_id, CASE WHEN p.n IS NULL THEN 'job not found'
 WHEN p.n > 1 THEN 'more than one job with this id'
 WHEN p.st <> 'running' THEN 'job is not running'
 WHEN f.finish_id <> s.finish_id THEN 'job is finished already' END AS reason
FROM fset f LEFT JOIN per_id p ON p.id = f.job_id LEFT JOIN firstf s ON s.job_id = f.job_id)
SELECT finish_id, job_id, reason FROM x WHERE reason IS NOT NULL"""

_JOB_LOG = """jlog AS (
 SELECT id AS job_id, 'request' AS kind, 0 AS kr, queue_time AS ts, repository, commit_hash,
   query_string, CAST(NULL AS VARCHAR) AS worker, CAST(NULL AS VARCHAR) AS result FROM jobs_v
 UNION ALL SELECT id, 'start', 1, start_time, NULL, NULL, NULL, worker, NULL FROM jobs_v
   WHERE start_time IS NOT NULL
 UNION ALL SELECT id, 'succeed', 2, finish_time, NULL, NULL, NULL, NULL, result_url FROM jobs_v
   WHERE status = 'succeeded' AND finish_time IS NOT NULL
 UNION ALL SELECT id, 'fail', 3, finish_time, NULL, NULL, NULL, NULL, result_error FROM jobs_v
   WHERE status = 'failed' AND finish_time IS NOT NULL)"""

SQL["job_state_fold"] = _with(JOBS_V, _JOB_LOG) + """SELECT job_id AS id,
 arg_max_null(repository, ts) FILTER (WHERE kind = 'request') AS repository,
 arg_max_null(commit_hash, ts) FILTER (WHERE kind = 'request') AS commit_hash,
 arg_max_null(query_string, ts) FILTER (WHERE kind = 'request') AS query_string,
 CASE arg_max(kind, (ts, kr)) WHEN 'request' THEN 'pending' WHEN 'start' THEN 'running'
   WHEN 'succeed' THEN 'succeeded' WHEN 'fail' THEN 'failed' END AS status,
 arg_max_null(worker, ts) FILTER (WHERE kind = 'start') AS worker,
 MIN(ts) FILTER (WHERE kind = 'request') AS queue_time,
 MAX(ts) FILTER (WHERE kind = 'start') AS start_time,
 MAX(ts) FILTER (WHERE kind IN ('succeed', 'fail')) AS finish_time,
 arg_max_null(result, ts) FILTER (WHERE kind = 'succeed') AS result_url,
 arg_max_null(result, ts) FILTER (WHERE kind = 'fail') AS result_error
FROM jlog GROUP BY job_id"""

# -- audits --------------------------------------------------------------------

SQL["audit_live_key"] = _with(JOBS_V) + (
    f"SELECT {KEYS}, COUNT(*) AS n_live, MIN(id) AS min_id, MAX(id) AS max_id FROM jobs_v "
    f"WHERE status <> 'failed' GROUP BY {KEYS} HAVING COUNT(*) > 1")

SQL["audit_job_id"] = _with(JOBS_V) + (
    "SELECT id, COUNT(*) AS n_rows FROM jobs_v GROUP BY id HAVING COUNT(*) > 1")

SQL["audit_line_id"] = ("SELECT CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) "
                        "AS id, COUNT(*) AS n_rows FROM lineitem GROUP BY 1 HAVING COUNT(*) > 1")

SQL["audit_workers"] = _with(JOBS_V) + """SELECT worker, COUNT(*) AS n_jobs,
 COUNT(*) FILTER (WHERE status = 'running') AS n_running,
 COUNT(*) FILTER (WHERE status = 'succeeded') AS n_succeeded,
 COUNT(*) FILTER (WHERE status = 'failed') AS n_failed,
 MIN(start_time) AS first_start, MAX(start_time) AS last_start
FROM jobs_v WHERE worker IS NOT NULL GROUP BY worker"""

SQL["audit_stuck"] = _with(JOBS_V) + (
    f"SELECT id, worker, repository, start_time, date_diff('second', start_time, "
    f"TIMESTAMP '{STUCK_NOW}') AS running_s FROM jobs_v WHERE status = 'running' AND "
    f"start_time < TIMESTAMP '{STUCK_NOW}' - INTERVAL {STUCK_LIMIT_S} SECOND")

_RULES = []
for _st, _cols in (("pending", {"worker": 0, "start_time": 0, "finish_time": 0,
                                "result_url": 0, "result_error": 0}),
                   ("running", {"worker": 1, "start_time": 1, "finish_time": 0,
                                "result_url": 0, "result_error": 0}),
                   ("succeeded", {"worker": 1, "start_time": 1, "finish_time": 1,
                                  "result_url": 1, "result_error": 0}),
                   ("failed", {"worker": 1, "start_time": 1, "finish_time": 1,
                               "result_url": 0, "result_error": 1})):
    for _c, _must in _cols.items():
        _RULES.append(
            f"SELECT id, '{_st}: {_c} {'missing' if _must else 'set'}' AS rule FROM jobs_v "
            f"WHERE status = '{_st}' AND {_c} IS {'NULL' if _must else 'NOT NULL'}")
_RULES.append("SELECT id, 'unknown status' AS rule FROM jobs_v WHERE status IS NULL OR "
              "status NOT IN ('pending', 'running', 'succeeded', 'failed')")

SQL["audit_columns"] = _with(JOBS_V) + (
    "SELECT rule, COUNT(*) AS n_jobs FROM (" + " UNION ALL ".join(_RULES) + ") GROUP BY rule")

_W = "date_diff('microsecond', queue_time, start_time) / 1000000"
_R = "date_diff('microsecond', start_time, finish_time) / 1000000"
SQL["wait_run_times"] = _with(JOBS_V) + f"""SELECT repository, COUNT(*) AS n_jobs,
 COUNT({_W}) AS n_started, COUNT({_R}) AS n_finished, AVG({_W}) AS avg_wait_s,
 MAX({_W}) AS max_wait_s, AVG({_R}) AS avg_run_s, MAX({_R}) AS max_run_s
FROM jobs_v GROUP BY repository"""

SQL["wait_run_percentiles"] = _with(JOBS_V) + "SELECT repository, " + ", ".join(
    f"quantile_disc(date_diff('microsecond', {a}, {b}), {q}) / 1000000 AS {n}_{kind}_s"
    for kind, a, b in (("wait", "queue_time", "start_time"), ("run", "start_time", "finish_time"))
    for n, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))) + " FROM jobs_v GROUP BY repository"

SQL["reuse_rate"] = _with(JOBS_V, REQUESTS_V, LIVE, FIRSTS, KEYMAP, RESOLVED) + """SELECT
 COUNT(*) AS n_requests, COUNT(*) FILTER (WHERE created) AS n_created,
 COUNT(*) FILTER (WHERE NOT created) AS n_reused, COUNT(DISTINCT job_id) AS n_jobs,
 (COUNT(*) FILTER (WHERE NOT created)) / COUNT(*) AS reuse_rate FROM resolved"""

# -- closure -------------------------------------------------------------------

SQL["deps_closure"] = "WITH RECURSIVE " + EDGES_V[:] + ",\n" + ROOTS_V + """,
 c(root, node) AS (SELECT root, root FROM roots_v
   UNION SELECT c.root, e.dst FROM c JOIN edges_v e ON c.node = e.src)
SELECT root, node FROM c"""

SQL["deps_reach"] = "WITH RECURSIVE " + EDGES_V + ",\n" + ROOTS_V + """,
 c(node) AS (SELECT root FROM roots_v UNION SELECT e.dst FROM c JOIN edges_v e ON c.node = e.src)
SELECT node FROM c"""

_RUN = "WITH RECURSIVE " + ",\n".join([JOBS_V, POLLS_V, REPOS_V, EDGES_V]) + """,
 q AS (SELECT id, repository, query_string, ROW_NUMBER() OVER (ORDER BY queue_time, id) AS rank
   FROM jobs_v WHERE status = 'pending'),
 p AS (SELECT *, ROW_NUMBER() OVER (ORDER BY poll_time, poll_id) AS rank FROM polls_v),
 claimed AS (SELECT q.id, q.repository, q.query_string, p.worker_name, p.poll_time,
   r.workspace FROM p JOIN q USING (rank) LEFT JOIN repos_v r ON r.repository = q.repository),
 roots AS (SELECT DISTINCT 'o' || substr(query_string, 2) AS root FROM claimed
   WHERE workspace IS NOT NULL),
 c(root, node) AS (SELECT root, root FROM roots
   UNION SELECT c.root, e.dst FROM c JOIN edges_v e ON c.node = e.src),
 n AS (SELECT root, COUNT(*) AS n FROM c GROUP BY root),
 outcomes AS (SELECT cl.id AS job_id, cl.repository, cl.worker_name AS worker,
 CASE WHEN cl.workspace IS NULL THEN 'failed' ELSE 'succeeded' END AS status,
 cl.poll_time AS start_time, cl.poll_time AS finish_time,
 CASE WHEN cl.workspace IS NOT NULL THEN 'gs://results/' || CAST(cl.id AS VARCHAR) || '.pb' END
   AS result_url,
 CASE WHEN cl.workspace IS NULL THEN 'workspace for repo "' || cl.repository || '" not found' END
   AS result_error,
 CAST(CASE WHEN cl.workspace IS NULL THEN 0 ELSE COALESCE(n.n, 0) END AS BIGINT) AS n_deps
FROM claimed cl LEFT JOIN n ON n.root = 'o' || substr(cl.query_string, 2))
"""
SQL["run_jobs"] = _RUN + "SELECT * FROM outcomes"
SQL["run_jobs_state"] = _RUN + """SELECT j.id, j.repository, j.commit_hash, j.query_string,
 COALESCE(o.status, j.status) AS status, COALESCE(o.worker, j.worker) AS worker, j.queue_time,
 COALESCE(o.start_time, j.start_time) AS start_time,
 COALESCE(o.finish_time, j.finish_time) AS finish_time,
 CASE WHEN o.job_id IS NOT NULL THEN o.result_url ELSE j.result_url END AS result_url,
 CASE WHEN o.job_id IS NOT NULL THEN o.result_error ELSE j.result_error END AS result_error
FROM jobs_v j LEFT JOIN outcomes o ON o.job_id = j.id"""
SQL["run_jobs_results"] = _RUN + """SELECT cl.id AS job_id, c.node FROM claimed cl
 JOIN c ON c.root = 'o' || substr(cl.query_string, 2) WHERE cl.workspace IS NOT NULL"""

_SCOPED_EDGES = """edges_s AS (SELECT DISTINCT 'repo/' || CAST(k % 30 AS VARCHAR) AS repository,
  'c' || CAST(c AS VARCHAR) AS commit_hash, src, dst FROM (
  SELECT l_orderkey AS k, c, 'o' || CAST(l_orderkey AS VARCHAR) AS src,
    unnest(['p' || CAST(l_partkey AS VARCHAR), 's' || CAST(l_suppkey AS VARCHAR)]) AS dst
    FROM lineitem, range(2) t(c) WHERE (l_linenumber + c) % 3 <> 0
  UNION ALL SELECT o_orderkey, c, 'o' || CAST(o_orderkey AS VARCHAR), 'c' || CAST(o_custkey AS VARCHAR)
    FROM orders, range(2) t(c)
  UNION ALL SELECT c_custkey, c_custkey % 2, 'c' || CAST(c_custkey AS VARCHAR),
    'n' || CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL SELECT s_suppkey, s_suppkey % 2, 's' || CAST(s_suppkey AS VARCHAR),
    'n' || CAST(s_nationkey AS VARCHAR) FROM supplier
  UNION ALL SELECT n_nationkey, c, 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR)
    FROM nation, range(2) t(c)))"""
SQL["run_jobs_scoped"] = "WITH RECURSIVE " + ",\n".join(
    [JOBS_V, POLLS_V, REPOS_V, _SCOPED_EDGES]) + """,
 q AS (SELECT id, repository, commit_hash, 'o' || substr(query_string, 2) AS root,
   ROW_NUMBER() OVER (ORDER BY queue_time, id) AS rank FROM jobs_v WHERE status = 'pending'),
 p AS (SELECT *, ROW_NUMBER() OVER (ORDER BY poll_time, poll_id) AS rank FROM polls_v),
 cl AS (SELECT q.*, p.worker_name, p.poll_time, r.workspace
   FROM p JOIN q USING (rank) LEFT JOIN repos_v r ON r.repository = q.repository),
 c(repository, commit_hash, root, node) AS (
   SELECT repository, commit_hash, root, root FROM cl WHERE workspace IS NOT NULL
   UNION SELECT c.repository, c.commit_hash, c.root, e.dst FROM c JOIN edges_s e
     ON c.node = e.src AND c.repository = e.repository AND c.commit_hash = e.commit_hash),
 n AS (SELECT repository, commit_hash, root, COUNT(*) AS n FROM c GROUP BY ALL)
SELECT cl.id AS job_id, cl.repository, cl.worker_name AS worker,
 CASE WHEN workspace IS NULL THEN 'failed' ELSE 'succeeded' END AS status,
 poll_time AS start_time, poll_time AS finish_time,
 CASE WHEN workspace IS NOT NULL THEN 'gs://results/' || CAST(cl.id AS VARCHAR) || '.pb' END AS result_url,
 CASE WHEN workspace IS NULL THEN 'workspace for repo "' || cl.repository || '" not found' END
   AS result_error,
 CAST(CASE WHEN workspace IS NULL THEN 0 ELSE n.n END AS BIGINT) AS n_deps
FROM cl LEFT JOIN n USING (repository, commit_hash, root)"""

# -- streams and sinks: the batch results -----------------------------------------

SQL["stream_dedup"] = "SELECT id, user_id, job_id, created FROM (" + SQL["dedup_generations"] + ")"
for _name in ("stream_job_state", "stream_job_increments"):
    SQL[_name] = SQL["job_state_fold"]
_USER_LOG = """jlog AS (SELECT user_id AS job_id, ts,
 CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'succeed' WHEN 'error' THEN 'fail'
   ELSE 'request' END AS kind,
 CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 ELSE 0 END AS kr,
 CASE WHEN event_type IN ('click', 'view') THEN 'repo/' || CAST(user_id % 30 AS VARCHAR) END AS repository,
 CASE WHEN event_type IN ('click', 'view') THEN 'c' || CAST(user_id % 5 AS VARCHAR) END AS commit_hash,
 CASE WHEN event_type IN ('click', 'view') THEN 'q' || CAST(user_id AS VARCHAR) END AS query_string,
 CASE WHEN event_type = 'signup' THEN 'worker-' || CAST(event_id % 10 AS VARCHAR) END AS worker,
 CASE WHEN event_type IN ('purchase', 'error') THEN 'r' || CAST(event_id AS VARCHAR) END AS result
 FROM events)"""
SQL["event_log_round_trip"] = SQL["job_state_fold"].replace(JOBS_V + ",\n", "").replace(
    _JOB_LOG, _USER_LOG)
# the stream's job ids are texts, and the lowest live id of a KEY is the lowest text
SQL["stream_enqueue"] = SQL["enqueue_resolve"].replace(
    "MIN(id) AS live_id", "MIN(CAST(id AS VARCHAR)) AS live_id")

SQL["stream_drop_resent"] = """WITH m AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS half FROM events)
SELECT event_id, user_id, event_type, ts, event_id % 11 = 0 AND ts < half AS late FROM events, m"""

# an alarm falls when the watermark, a day behind the last event, has passed the limit
SQL["stream_stuck"] = _with(JOBS_V, _JOB_LOG) + f""", w AS (
 SELECT max(ts) - INTERVAL 1 DAY AS mark FROM jlog),
 f AS (SELECT job_id, min(ts) FILTER (WHERE kind = 'start') AS start_time,
   arg_min(worker, (ts, worker)) FILTER (WHERE kind = 'start') AS worker,
   min(ts) FILTER (WHERE kind IN ('succeed', 'fail')) AS finish_time FROM jlog GROUP BY job_id)
SELECT job_id, worker, start_time FROM f, w
WHERE start_time + INTERVAL {STUCK_STREAM_LIMIT_S} SECOND < mark
  AND (finish_time IS NULL OR finish_time > start_time + INTERVAL {STUCK_STREAM_LIMIT_S} SECOND)"""

_RLOG = CLAIM_LOG.replace("SELECT event_id AS id,", """SELECT event_id AS id,
 CASE WHEN event_id % 2 = 0 THEN 'repo/hot' ELSE 'repo/' || CAST(user_id % 30 AS VARCHAR) END
   AS repository,""")
SQL["stream_claims"] = (_with(_RLOG) + _INTERLEAVED).replace(
    "OVER (ORDER BY", "OVER (PARTITION BY repository ORDER BY").replace(
    "ON p.rank = j.rank", "ON p.rank = j.rank AND p.repository = j.repository").replace(
    "p.id AS poll_id, p.t AS poll_t, j.id AS job_id, j.t AS job_t, p.rank",
    "p.repository, p.id AS poll_id, j.id AS job_id, p.rank")

SQL["results_round_trip"] = _with(JOBS_V) + (
    "SELECT id AS job_id, 'o' || substr(query_string, 2) AS node, 'gs://bucket/' || "
    "CAST(id AS VARCHAR) || '.pb' AS result_url, CAST(id % 2 AS INTEGER) AS batch, true AS url_ok "
    "FROM jobs_v WHERE status = 'succeeded'")

ORACLE_SQL = SQL
