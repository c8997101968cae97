"""Intermediate tables of operators, in the shared folder of the session.

An operator that reads an intermediate result more than once, or loops, writes
it below ``spark.checkpoint.dir``: the files cut the lineage, and a lost
executor re-reads them.  A returned DataFrame may still read such files, so the
operator cannot delete them itself; the caller can, with a scope::

    with scratch_scope(spark):
        deps_closure(edges, roots).write.parquet(out)
    # everything that operators have written inside is gone
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from jobtables.session import ensure_checkpoint_dir

_scopes: list[list[Scratch]] = []


class Scratch:
    """The intermediate tables of one operator call.

    ``drop`` frees tables as soon as their last reader is done; ``close``
    frees all, catalog tables (``own_table``) included.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.tag = spark, uuid.uuid4().hex
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{self.tag}"
        self._n = 0
        self._names: list[str] = []
        for scope in _scopes[-1:]:
            scope.append(self)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return a reader of the written rows."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def own_table(self, name: str) -> str:
        """A name for a catalog table that ``close`` drops."""
        self._names.append(f"jobtables_{name}_{self.tag}")
        return self._names[-1]

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables; nothing may read them any more."""
        for t in tables:
            delete_path(self.spark, t.scratch_path)

    def close(self) -> None:
        for name in self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete_path(self.spark, self.root)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete, at its end, what operators called inside have written."""
    _scopes.append([])
    try:
        yield
    finally:
        for scratch in _scopes.pop():
            scratch.close()


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
