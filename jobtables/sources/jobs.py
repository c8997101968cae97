"""Job-table sources.

A dump of the SQL store keeps times as RFC 3339 text and names the result
columns ``query_result_url``/``query_error``; the model names them
``result_url``/``result_error``.  Decoding is a projection, so it stays in the
scan's stage and keeps filter pushdown and column pruning.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtables.functions.timefmt import rfc3339_parse, rfc3339_parse_strict
from jobtables.schema import (
    DUMP_RENAMES,
    JOB_COLUMNS,
    REQUEST_SCHEMA,
    TEXT_DUMP_SCHEMA,
    job_schema,
)

TIME_COLUMNS = ("queue_time", "start_time", "finish_time")


def _renamed(dump: DataFrame) -> DataFrame:
    return dump.withColumnsRenamed({k: v for k, v in DUMP_RENAMES.items()
                                    if k in dump.columns})


def decode_jobs(dump: DataFrame) -> DataFrame:
    """Text dump -> job rows.  A bad time fails the query (as the store's
    strict parse does)."""
    d = _renamed(dump)
    return d.select(*[rfc3339_parse_strict(c, c).alias(c) if c in TIME_COLUMNS else F.col(c)
                      for c in JOB_COLUMNS])


def quarantine_jobs(dump: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split a text dump into (good job rows, bad rows).  Bad rows: one
    per unparsable time, as (id, column, value)."""
    d = _renamed(dump)
    parsed = d.select(*[F.col(c) for c in JOB_COLUMNS],
                      *[rfc3339_parse(c).alias(f"_p_{c}") for c in TIME_COLUMNS])
    bad_flags = [F.col(c).isNotNull() & F.col(f"_p_{c}").isNull() for c in TIME_COLUMNS]
    any_bad = bad_flags[0] | bad_flags[1] | bad_flags[2]
    good = parsed.where(~any_bad).select(
        *[F.col(f"_p_{c}").alias(c) if c in TIME_COLUMNS else F.col(c) for c in JOB_COLUMNS])
    bad = parsed.select(
        "id", F.explode(F.filter(F.array(*[
            F.when(flag, F.struct(F.lit(c).alias("column"), F.col(c).alias("value")))
            for c, flag in zip(TIME_COLUMNS, bad_flags)]), lambda x: x.isNotNull())).alias("b")
    ).select("id", "b.column", "b.value")
    return good, bad


#: Columns of a dump that every job has.
REQUIRED = ("id", "repository", "commit_hash", "query_string", "status", "queue_time")
_CORRUPT = "_corrupt"


def read_dump(spark: SparkSession, path: str, fmt: str = "json", **options
              ) -> tuple[DataFrame, DataFrame]:
    """A text dump of JSON or CSV lines, whatever state its records are in.

    Returns ``(good, bad)``: the job rows of sound records, and per defect of
    the others ``(id, reason, column, record)``, where the record is the line
    as read and ``reason`` one of ``malformed record`` (cut or not parsable;
    nothing else is said of it), ``missing value`` (a column that every job
    has) and ``bad time``.  A record has a row per defect.  Empty lines are
    skipped.  The lines are parsed by Spark in one pass; neither side reads
    the input twice in one plan.
    """
    if fmt not in ("json", "csv"):
        raise ValueError(f"no record format: {fmt}")
    schema = T.StructType([T.StructField(f.name, T.StringType()) for f in TEXT_DUMP_SCHEMA]
                          + [T.StructField(_CORRUPT, T.StringType())])
    parse = F.from_json if fmt == "json" else F.from_csv
    given = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, **options}
    lines = spark.read.text(path).where(F.trim("value") != "")
    target = schema if fmt == "json" else schema.simpleString()[len("struct<"):-1].replace(":", " ")
    # exploding arrays of one element keeps a value from being computed again in every
    # filter and column that reads it: each line is parsed once, each time once
    d = lines.select(F.col("value").alias("record"), F.inline(F.array(parse("value", target, given))))
    d = _renamed(d)
    d = d.select("*", F.inline(F.array(F.struct(*[rfc3339_parse(c).alias(f"_p_{c}") for c in TIME_COLUMNS]))))

    def defect(flag, reason: str, column: str | None = None):
        return F.when(flag, F.struct(F.lit(reason).alias("reason"), F.lit(column).cast("string").alias("column")))
    broken = F.col(_CORRUPT).isNotNull()
    missing = {c: ~broken & F.col(c).isNull() for c in REQUIRED}
    unparsed = {c: ~broken & F.col(c).isNotNull() & F.col(f"_p_{c}").isNull() for c in TIME_COLUMNS}
    found = [defect(f, "missing value", c) for c, f in missing.items()]
    found += [defect(f, "bad time", c) for c, f in unparsed.items()]
    defects = F.filter(F.array(defect(broken, "malformed record"), *found), lambda x: x.isNotNull())
    defective = reduce(or_, [broken, *missing.values(), *unparsed.values()])
    good = d.where(~defective).select(
        *[F.col(f"_p_{c}").alias(c) if c in TIME_COLUMNS else F.col(c) for c in JOB_COLUMNS])
    bad = d.where(defective).select(
        F.when(~broken, F.col("id")).alias("id"), F.explode(defects).alias("d"), "record") \
        .select("id", "d.reason", "d.column", "record")
    return good, bad


def read_jobs(spark: SparkSession, path: str, fmt: str = "parquet", text_times: bool = True,
              mode: str = "strict", **options):
    """Read a job table.  ``text_times``: the dump keeps times as text
    (decoded strictly, or split off in ``mode="quarantine"``).  The schema is
    given, never inferred."""
    schema = TEXT_DUMP_SCHEMA if text_times else job_schema()
    reader = spark.read.schema(schema).options(**options)
    df = reader.format(fmt).load(path)
    if not text_times:
        return df
    if mode == "quarantine":
        return quarantine_jobs(df)
    return decode_jobs(df)


def read_requests_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                         max_files_per_trigger: int | None = None) -> DataFrame:
    """S3: unbounded source of enqueue requests (files arriving in ``path``)."""
    r = spark.readStream.schema(REQUEST_SCHEMA).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)
