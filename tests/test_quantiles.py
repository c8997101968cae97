"""Exact quantiles against DuckDB's ``quantile_disc``."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from jobtables.operators.quantiles import exact_quantiles, value_bucket

Q = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}


def expected(rows, kind):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE t(k VARCHAR, v {kind})")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    cols = ", ".join(f"quantile_disc(v, {f}) AS {n}" for n, f in Q.items())
    return sorted(con.execute(f"SELECT k, {cols} FROM t WHERE v IS NOT NULL GROUP BY k").fetchall(), key=str)


@pytest.mark.parametrize("kind,spark_kind", [("BIGINT", "long"), ("DOUBLE", "double")])
def test_equals_quantile_disc(spark, kind, spark_kind):
    rnd = random.Random(4)
    rows = []
    for i in range(4_000):
        k = "hot" if i % 2 else rnd.choice([None, "a", "b", "c", "one"][:4])
        v = rnd.choice([rnd.randint(-50, 50), rnd.randint(0, 10**12), -rnd.randint(0, 10**6), 7, None])
        rows.append((k, v if kind == "BIGINT" or v is None else v / 7))
    rows += [("one", 3 if kind == "BIGINT" else 0.1), ("none", None)]
    df = spark.createDataFrame(rows, f"k string, v {spark_kind}").repartition(4)
    got = exact_quantiles(df, ["k"], "v", Q, segments=6).select("k", *Q)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, kind)
    assert exact_quantiles(df.limit(0), ["k"], "v", Q).collect() == []


def test_buckets_never_fall(spark):
    values = sorted({s * (1 << e) + d for s in (1, -1) for e in range(62) for d in (-1, 0, 1)} | {0})
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = [r["b"] for r in df.orderBy("v").select(value_bucket(F.col("v"), df.schema["v"].dataType)
                                                  .alias("b")).collect()]
    assert got == sorted(got) and len(set(got)) > 100


def test_hot_group_is_no_single_task(spark):
    """Half of the rows are one group whose values lie close together: the rows
    of the last sort are spread over the segments."""
    df = spark.range(40_000).select(
        F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50))
        .alias("k"), (F.lit(10**9) + F.col("id")).alias("v"))
    got = exact_quantiles(df, ["k"], "v", {"p50": 0.5}, segments=8)
    hot = got.where("k = 'hot'").first()
    assert hot["p50"] == 10**9 + 2 * (10_000 - 1)
    from jobtables.operators.ordered import SEG, Segments
    sizes = [r["count"] for r in Segments(df, ["k"], ["v"], 8).deal(df).groupBy(SEG).count().collect()]
    assert max(sizes) <= 2 * 40_000 / 8
