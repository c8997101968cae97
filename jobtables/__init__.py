"""Job tables on Spark.

Batch and streaming operators over tables of queued query jobs: enqueue
resolution against history, first-in-first-out claiming, life-cycle folds,
finish bookkeeping, bulk status polls, repository routing, audits and
dependency closures.  Every operator takes and returns DataFrames.
"""

from jobtables.schema import (  # noqa: F401
    KEY,
    STATUS_FAILED,
    STATUS_PENDING,
    STATUS_RUNNING,
    STATUS_SUCCEEDED,
    STATUSES,
)
