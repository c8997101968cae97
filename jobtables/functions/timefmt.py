"""RFC 3339 time text <-> timestamp_ntz (UTC), independent of the session zone.

The job store writes times as UTC text with whole seconds and parses them
strictly: an optional fraction, a mandatory offset (``Z`` or ``+hh:mm``), and
calendar-valid fields.  Parsing here casts the text without its offset to
``timestamp_ntz`` and subtracts the offset, so the result does not depend on
``spark.sql.session.timeZone``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shape of an RFC 3339 date-time (fixed value): date, 'T', time with hours
# 00-23 and minutes/seconds 00-59, optional fraction, offset 'Z' or +hh:mm.
# 'T' and 'Z' are upper case.  Month and day are checked by the cast.
RFC3339_RE = (r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,9})?"
              r"(Z|[+-]([01]\d|2[0-4]):[0-5]\d)$")

# Output format: UTC, whole seconds, literal Z.
RFC3339_OUT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rfc3339_encode(ts, offset: str = "Z") -> Column:
    """Encode a timestamp_ntz as RFC 3339 text with whole seconds and the
    given offset text (``Z`` for UTC).  Cut from the value's own text form
    (``yyyy-MM-dd HH:mm:ss[.f]``), so the session time zone plays no part:
    ``date_format`` would pass the value through the session zone and shift
    wall times that fall in a daylight-saving gap there."""
    t = _col(ts).cast("timestamp_ntz").cast("string")
    return F.concat(F.substring(t, 1, 10), F.lit("T"), F.substring(t, 12, 8), F.lit(offset))


def rfc3339_parse(text) -> Column:
    """Parse RFC 3339 text to timestamp_ntz in UTC; null when the text is
    not a valid RFC 3339 date-time (null in, null out).

    One regular-expression test per value fixes the shape; then one cast reads
    the text before the offset (a fraction is cut to microseconds).
    """
    t = _col(text)
    z = F.substring(t, -1, 1) == "Z"
    local = F.substring(t, F.lit(1), F.length(t) - F.when(z, 1).otherwise(6)) \
        .try_cast("timestamp_ntz")
    minutes = F.substring(t, -5, 2).try_cast("int") * 60 + F.substring(t, -2, 2).try_cast("int")
    off_min = F.when(z, 0).when(F.substring(t, -6, 1) == "-", -minutes).otherwise(minutes)
    utc = local - F.make_dt_interval(F.lit(0), F.lit(0), off_min, F.lit(0))
    return F.when(t.rlike(RFC3339_RE), utc)


def rfc3339_parse_strict(text, what: str = "time") -> Column:
    """Like :func:`rfc3339_parse` but raises on a non-null invalid text."""
    t = _col(text)
    err = F.raise_error(F.concat(F.lit(f"failed to parse {what}: "), t)).cast("timestamp_ntz")
    return F.coalesce(rfc3339_parse(t), F.when(t.isNotNull(), err))


def ntz_to_instant(ts) -> Column:
    """timestamp_ntz (UTC wall time) -> TIMESTAMP instant, whatever the session
    zone (event-time watermarks need TIMESTAMP)."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, _col(ts)))
