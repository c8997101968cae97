"""Column expressions for names: result URLs, workspace names, error texts
and deterministic job ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtables.schema import ERR_WORKSPACE_FMT


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def result_url(bucket, job_id="id") -> Column:
    """``gs://<bucket>/<job id>.pb``: where a job's result object lives."""
    b = F.lit(bucket) if isinstance(bucket, str) else bucket
    return F.concat(F.lit("gs://"), b, F.lit("/"), _col(job_id).cast("string"), F.lit(".pb"))


def repo_basename(repository="repository") -> Column:
    """Last path element of a repository URL, as a path base name: trailing
    slashes dropped; the empty text gives ``.``; only slashes give ``/``."""
    r = _col(repository)
    trimmed = F.rtrim(r, F.lit("/"))
    return (F.when(r == "", F.lit("."))
            .when(trimmed == "", F.lit("/"))
            .otherwise(F.substring_index(trimmed, "/", -1)))


def workspace_error(repository="repository") -> Column:
    """``workspace for repo "<r>" not found``."""
    pre, post = ERR_WORKSPACE_FMT.split("{}")
    return F.concat(F.lit(pre), _col(repository), F.lit(post))


def keyed_id(*parts) -> Column:
    """Deterministic job id: SHA-256 of the length-prefixed parts.

    Task retries recompute the same id (unlike ``uuid()``), and length prefixes
    keep ("a|", "b") and ("a", "|b") apart whatever the texts hold.
    """
    pieces = []
    for p in parts:
        c = _col(p).cast("string")
        pieces += [F.length(c).cast("string"), F.lit(":"), c]
    return F.sha2(F.concat(*pieces), 256)
