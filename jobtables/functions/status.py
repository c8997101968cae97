"""Column expressions for job status: poll projection, preconditions,
next-poll times and finish outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtables.schema import (
    CLIENT_POLL_DELAY_S,
    ERR_BAD_STATUS_PREFIX,
    ERR_FAILED_NO_ERROR,
    ERR_SUCCEEDED_NO_URL,
    STATUS_FAILED,
    STATUS_PENDING,
    STATUS_RUNNING,
    STATUS_SUCCEEDED,
)

# Tags of the poll answer (one-of).
IN_PROGRESS = "in_progress"
SUCCESS = "success"
FAILURE = "failure"
ERROR = "error"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_ntz(value) -> Column:
    """A timestamp_ntz literal from text or a datetime (no zone applied)."""
    if isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def next_poll_time(now, delay_s: int = CLIENT_POLL_DELAY_S) -> Column:
    """``now`` plus the poll delay (5 s for clients, 10 s for workers)."""
    return ts_ntz(now) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(delay_s))


def poll_error(status="status", result_url="result_url",
               result_error="result_error") -> Column:
    """The precondition error a poll of this row raises, or null."""
    s, u, e = _col(status), _col(result_url), _col(result_error)
    return (F.when(s.isin(STATUS_PENDING, STATUS_RUNNING), F.lit(None).cast("string"))
            .when(s == STATUS_SUCCEEDED,
                  F.when(u.isNull(), F.lit(ERR_SUCCEEDED_NO_URL)))
            .when(s == STATUS_FAILED,
                  F.when(e.isNull(), F.lit(ERR_FAILED_NO_ERROR)))
            .otherwise(F.concat(F.lit(ERR_BAD_STATUS_PREFIX + '"'),
                                F.coalesce(s, F.lit("")), F.lit('"'))))


def poll_state(status="status", result_url="result_url",
               result_error="result_error") -> Column:
    """Tag of the one-of answer: in_progress, success, failure or error."""
    s = _col(status)
    return (F.when(poll_error(status, result_url, result_error).isNotNull(), F.lit(ERROR))
            .when(s.isin(STATUS_PENDING, STATUS_RUNNING), F.lit(IN_PROGRESS))
            .when(s == STATUS_SUCCEEDED, F.lit(SUCCESS))
            .otherwise(F.lit(FAILURE)))


def poll_columns(now, delay_s: int = CLIENT_POLL_DELAY_S, status="status",
                 result_url="result_url", result_error="result_error") -> dict[str, Column]:
    """Flat form of the poll answer: tag, next poll time, url, message, error."""
    state = poll_state(status, result_url, result_error)
    return {
        "poll_state": state,
        "next_poll_time": F.when(state == IN_PROGRESS, next_poll_time(now, delay_s)),
        "results_url": F.when(state == SUCCESS, _col(result_url)),
        "failure_message": F.when(state == FAILURE, _col(result_error)),
        "error": poll_error(status, result_url, result_error),
    }


def poll_struct(now, delay_s: int = CLIENT_POLL_DELAY_S, status="status",
                result_url="result_url", result_error="result_error") -> Column:
    """Nested form of the poll answer: exactly one of three structs is set
    (none when ``error`` is set)."""
    c = poll_columns(now, delay_s, status, result_url, result_error)
    st = c["poll_state"]
    return F.struct(
        st.alias("status"),
        F.when(st == IN_PROGRESS, F.struct(c["next_poll_time"].alias("next_poll_time"))
               ).alias("in_progress"),
        F.when(st == SUCCESS, F.struct(c["results_url"].alias("results_url"))).alias("success"),
        F.when(st == FAILURE, F.struct(c["failure_message"].alias("failure_message"))
               ).alias("failure"),
        c["error"].alias("error"),
    )


def finish_status(location="query_result_location", message="failure_message") -> Column:
    """Outcome of a finish request: succeeded when a location is set, failed
    when a message is set, null (no change) when neither is set."""
    loc, msg = _col(location), _col(message)
    return (F.when(loc.isNotNull(), F.lit(STATUS_SUCCEEDED))
            .when(msg.isNotNull(), F.lit(STATUS_FAILED)))


def finish_result(location="query_result_location", message="failure_message") -> Column:
    loc, msg = _col(location), _col(message)
    return F.when(loc.isNotNull(), loc).otherwise(msg)
