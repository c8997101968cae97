"""Exact quantiles per group without a buffer or a sketch per group.

``percentile`` keeps every value of a group in one task and
``percentile_approx`` a sketch.  Here a group's values are counted per bucket,
a fixed monotone function of the value with at most some thousand different
results, with partial aggregation where the rows are read.  The counts say in
which bucket each wanted rank lies; only the values of these buckets are looked
at again, equal ones as one row, and put in order by
:func:`~jobtables.operators.ordered.running_sums`, which no hot group turns
into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtables.operators.ordered import join_on_keys, running_sums
from jobtables.scratch import Scratch

PER_DOUBLING = 16  # buckets between a value and its double
_BUCKET, _LAST = "_bucket", 1 << 20


def value_bucket(value: Column, kind: T.DataType) -> Column:
    """Never falls as the value grows; NaN, the largest value, comes last."""
    v = value.cast("double")
    size = F.floor(F.least(F.log2(F.abs(v) + 1), F.lit(2_000.0)) * PER_DOUBLING)
    bucket = F.when(v < 0, -size).otherwise(size).cast("int")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        bucket = F.when(F.isnan(v), F.lit(_LAST)).otherwise(bucket)
    return bucket


def exact_quantiles(rows: DataFrame, by: Sequence[str], value: str, q: dict[str, float],
                    segments: int | None = None) -> DataFrame:
    """``by`` and one column per name in ``q``: the value of rank ``ceil(q n)``
    (at least 1) among the group's ``n`` values, nulls left out.  A group
    without values has no row; null is a group of its own."""
    by = list(by)
    scratch = Scratch(rows.sparkSession, "quantiles")
    kind = rows.schema[value].dataType
    v = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_value")) \
        .withColumn(_BUCKET, value_bucket(F.col("_value"), kind))
    counts = v.groupBy(*by, _BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)  # one row per bucket, not per value
    n = F.sum("_n").over(group)
    upto = F.sum("_n").over(group.orderBy(_BUCKET))
    ranks = F.array(*[
        F.struct(F.lit(name).alias("name"),
                 F.greatest(F.lit(1), F.col("_all") - F.floor(F.col("_all") - F.lit(float(f)) * F.col("_all")))
                 .alias("rank")) for name, f in q.items()])
    wanted = scratch.table(
        counts.withColumns({"_all": n, "_upto": upto}).select("*", F.explode(ranks).alias("_r"))
        .where((F.col("_r.rank") <= F.col("_upto")) & (F.col("_r.rank") > F.col("_upto") - F.col("_n")))
        .select(*by, _BUCKET, F.col("_r.name").alias("_name"),
                (F.col("_r.rank") - F.col("_upto") + F.col("_n")).alias("_rank")), "wanted")
    inside = join_on_keys(v, wanted.select(*by, _BUCKET).distinct(), [*by, _BUCKET], "left_semi")
    values = scratch.table(
        inside.groupBy(*by, _BUCKET, "_value").agg(F.count(F.lit(1)).alias("_n")), "values")
    summed = running_sums(values, [*by, _BUCKET], ["_value"], {"_upto": F.col("_n")}, segments=segments)
    found = join_on_keys(summed, wanted, [*by, _BUCKET]) \
        .where((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n")))
    return found.groupBy(*by).agg(*[
        F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(name) for name in q])
