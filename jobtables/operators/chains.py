"""Members of successor chains by pointer doubling.

Given a successor table (one ``next`` per node, acyclic) and start nodes, find
every node on the path from each start, with its position.  Round i adds the
nodes 2^i..2^(i+1)-1 steps away using the 2^i-step jump table, then squares the
jump table with one self-join; a chain of length L takes about log2(L) rounds,
each a pair of joins, never one task per chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtables.scratch import Scratch


def chain_members(succ: DataFrame, starts: DataFrame, scratch: Scratch, node: str = "id",
                  max_rounds: int = 64) -> DataFrame:
    """Return (node, start, pos) for every node on the chain from each start.

    ``succ`` has columns (node, "next"); ``starts`` one column ``node``.
    Chains must not cycle (positions strictly increase along ``next``).
    """
    jump = scratch.table(succ.select(F.col(node).alias("a"), F.col("next").alias("b")), "jump")
    rounds = [scratch.table(starts.select(F.col(node).alias("n"), F.col(node).alias("start"),
                                          F.lit(0).cast("bigint").alias("pos")), "members")]
    step = 1
    for _ in range(max_rounds):
        if jump.isEmpty():
            break
        members = _union(rounds)
        reached = (members.join(jump, members["n"] == jump["a"])
                   .select(F.col("b").alias("n"), "start", (F.col("pos") + step).alias("pos")))
        rounds.append(scratch.table(reached, "members"))
        j2 = jump.alias("x").join(jump.alias("y"), F.col("x.b") == F.col("y.a"))
        last, jump = jump, scratch.table(
            j2.select(F.col("x.a").alias("a"), F.col("y.b").alias("b")), "jump")
        scratch.drop(last)
        step *= 2
    else:
        if not jump.isEmpty():
            raise RuntimeError(f"chains longer than 2^{max_rounds} steps (a cycle?)")
    return _union(rounds).select(F.col("n").alias(node), "start", "pos")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
