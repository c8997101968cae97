"""Connected components of a link table by alternating star rounds.

Every round replaces the links by links to smaller neighbours and writes them
to the shared folder; no links or labels pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtables.llm.shared import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` (longs) -> ``(node, component)``, one row per node that
    has a link to another node; ``component`` is the smallest node reachable.

    Null ends and self links are ignored, repeated links count once, and an
    empty table gives no rows.  The table returned lies in ``scratch``.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")) \
        .where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    e = scratch.table(e, "edges")
    before = _digest(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        large = _star(e, scratch, large=True)
        small = _star(large, scratch, large=False)
        scratch.drop(e, large)
        e, after = small, _digest(small)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"links still change after {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _digest(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h")).first()
    return r["n"], r["h"]


def _star(e: DataFrame, scratch: Scratch, large: bool) -> DataFrame:
    """One star round over links ``u > v``.

    Large: every larger neighbour of a node is linked to the smallest one of
    the node and its neighbours.  Small: so are its smaller neighbours and the
    node itself.  The minima are a table of their own, so that both sides of
    the join are plain exchanges and a hub's links can be split.
    """
    near = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
    least = scratch.table(
        near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")),
        "minima")
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
    table = scratch.table(out.where("u <> v").distinct(), "star")
    scratch.drop(least)
    return table
