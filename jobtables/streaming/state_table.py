"""Keyed state of ``foreachBatch`` streams, kept in files.

A table of one row per key, dealt to ``buckets`` folders by a hash of some key
columns.  A micro-batch reads the buckets its keys lie in, merges its rows into
them and writes a new version of these buckets only
(``bucket=<k>/batch=<id>``, dynamic overwrite).  A batch reads versions before
its own, so a replayed batch rewrites what it has written and reads what it has
read.  Versions that no replay can need are deleted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtables.scratch import delete_path


class StateTable:
    """``schema``: key and value columns; ``deal_by``: the columns whose hash
    names a row's bucket; ``combine``: one row per key from the rows of the
    last version and the new ones (a mergeable aggregation)."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, deal_by: Sequence[str],
                 combine: Callable[[DataFrame], DataFrame], buckets: int = 64):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.deal_by, self.combine, self.buckets = list(deal_by), combine, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.deal_by), F.lit(self.buckets)).cast("int")

    def _versions(self) -> dict[int, list[int]]:
        """Batch ids per bucket; two or three of each are kept."""
        jvm = self.spark._jvm
        glob = jvm.org.apache.hadoop.fs.Path(f"{self.root}/bucket=*/batch=*")
        fs = glob.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        out: dict[int, list[int]] = {}
        for s in fs.globStatus(glob) or []:
            path = s.getPath()
            bucket = int(path.getParent().getName().split("=")[1])
            out.setdefault(bucket, []).append(int(path.getName().split("=")[1]))
        return out

    def read(self, before: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows that batches before ``before`` have left, of some buckets."""
        wanted = None if buckets is None else set(buckets)
        paths = []
        for bucket, batches in sorted(self._versions().items()):
            past = [b for b in batches if before is None or b < before]
            if past and (wanted is None or bucket in wanted):
                paths.append(f"{self.root}/bucket={bucket}/batch={max(past)}")
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets that ``keys`` lie in (at most ``buckets`` numbers)."""
        return [r["b"] for r in keys.select(self.bucket().alias("b")).distinct().collect()]

    def merged(self, rows: DataFrame, before: int, touched: list[int] | None = None) -> DataFrame:
        """``rows`` merged into the buckets they touch, those buckets' rows."""
        old = self.read(before, self.touched(rows) if touched is None else touched)
        return self.combine(old.unionByName(rows.select(*self.schema.names)))

    def merge(self, rows: DataFrame, batch: int) -> None:
        """Write the version ``batch`` of the buckets that ``rows`` touch; one
        that ``combine`` has left without rows gets an empty version."""
        touched = self.touched(rows)
        out = self.merged(rows, batch, touched).select(*self.schema.names) \
            .withColumns({"bucket": self.bucket(), "batch": F.lit(batch)})
        out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("bucket", "batch").parquet(self.root)
        for bucket in touched:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/bucket={bucket}/batch={batch}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
        for bucket, batches in self._versions().items():
            past = sorted(b for b in batches if b < batch)
            for b in past[:-1]:  # a replay of this batch reads the last of them
                delete_path(self.spark, f"{self.root}/bucket={bucket}/batch={b}")
