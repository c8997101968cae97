"""Schemas, status constants and column orders of the job tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the job model (must equal the reference's for equal results).
STATUS_PENDING = "pending"
STATUS_RUNNING = "running"
STATUS_SUCCEEDED = "succeeded"
STATUS_FAILED = "failed"
STATUSES = (STATUS_PENDING, STATUS_RUNNING, STATUS_SUCCEEDED, STATUS_FAILED)

# Error texts of the model (fixed values).
ERR_JOB_NOT_FOUND = "job not found"
ERR_NO_PENDING = "no pending jobs"
ERR_SUCCEEDED_NO_URL = "query succeeded but ResultURL is not set"
ERR_FAILED_NO_ERROR = "query failed but ResultError is not set"
ERR_BAD_STATUS_PREFIX = "can't poll job with status: "
ERR_WORKSPACE_FMT = 'workspace for repo "{}" not found'

# Client and worker poll delays in seconds (fixed defaults; both are parameters).
CLIENT_POLL_DELAY_S = 5
WORKER_POLL_DELAY_S = 10

# The deduplication key: equal requests share one live job.
KEY = ["repository", "commit_hash", "query_string"]

# Column order of the job row.
JOB_COLUMNS = [
    "id",
    "repository",
    "commit_hash",
    "query_string",
    "status",
    "worker",
    "queue_time",
    "start_time",
    "finish_time",
    "result_url",
    "result_error",
]


def job_schema(id_type: T.DataType = T.StringType(),
               time_type: T.DataType = T.TimestampNTZType()) -> T.StructType:
    """The job row.  Ids are strings in the model; views keep bigint ids."""
    return T.StructType([
        T.StructField("id", id_type, False),
        T.StructField("repository", T.StringType(), False),
        T.StructField("commit_hash", T.StringType(), False),
        T.StructField("query_string", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("worker", T.StringType(), True),
        T.StructField("queue_time", time_type, False),
        T.StructField("start_time", time_type, True),
        T.StructField("finish_time", time_type, True),
        T.StructField("result_url", T.StringType(), True),
        T.StructField("result_error", T.StringType(), True),
    ])


# A text dump of the job table: the three times as RFC 3339 text and the two
# result columns under their SQL names.
TEXT_DUMP_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("repository", T.StringType(), False),
    T.StructField("commit_hash", T.StringType(), False),
    T.StructField("query_string", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("worker", T.StringType(), True),
    T.StructField("queue_time", T.StringType(), False),
    T.StructField("start_time", T.StringType(), True),
    T.StructField("finish_time", T.StringType(), True),
    T.StructField("query_result_url", T.StringType(), True),
    T.StructField("query_error", T.StringType(), True),
])

# Renames from the SQL store's column names to the model's.
DUMP_RENAMES = {"query_result_url": "result_url", "query_error": "result_error"}

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_id", T.LongType(), False),
    T.StructField("repository", T.StringType(), False),
    T.StructField("commit_hash", T.StringType(), False),
    T.StructField("query_string", T.StringType(), False),
    T.StructField("request_time", T.TimestampNTZType(), False),
])

POLL_SCHEMA = T.StructType([
    T.StructField("poll_id", T.LongType(), False),
    T.StructField("worker_name", T.StringType(), False),
    T.StructField("poll_time", T.TimestampNTZType(), False),
])

FINISH_SCHEMA = T.StructType([
    T.StructField("finish_id", T.LongType(), False),
    T.StructField("job_id", T.LongType(), False),
    T.StructField("query_result_location", T.StringType(), True),
    T.StructField("failure_message", T.StringType(), True),
    T.StructField("finish_ts", T.TimestampNTZType(), False),
])

# Life-cycle event log: one row per fact about a job.
EVENT_KINDS = ("request", "start", "succeed", "fail")
EVENT_SCHEMA = T.StructType([
    T.StructField("job_id", T.LongType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
    T.StructField("repository", T.StringType(), True),
    T.StructField("commit_hash", T.StringType(), True),
    T.StructField("query_string", T.StringType(), True),
    T.StructField("worker", T.StringType(), True),
    T.StructField("result", T.StringType(), True),
])
