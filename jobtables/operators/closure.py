"""Dependency closure (G1, G2): reflexive transitive closure by semi-naive
iteration.

Each round joins only the new frontier to the steps (never the whole closure),
drops pairs already seen with a left-anti join, and appends the new pairs to a
table in ``spark.checkpoint.dir``, so the lineage stays one round deep and a
lost executor recomputes at most one round.  The steps are partitioned once
and kept, so a round never re-reads or re-shuffles the edge source.  The table
of what was seen is bucketed on the closure key, so the anti-join never
re-shuffles it; after every ``COMPACT_AFTER`` rounds it is written anew with
one file per bucket.  Cycles end the loop, since the anti-join drops pairs that
come round again.

Hubs.  A node with many edges has them dealt to several parts, and its frontier
rows go to each part.  A node that holds more than a task's share of a round's
frontier has these rows salted, and only its own edges are repeated per salt.
So neither side of a node's join is one task.

Deep graphs.  A round costs a fixed time, so a chain of thousands of levels
must not take a round per level.  After ``STRIDE_AFTER`` rounds the steps are
squared while the closure goes on: steps of 1, 2, 4, 8, ... edges, ``SQUARINGS``
doublings a round, all of them tried on every frontier.  A longer step is a
path, so the pairs are the same.  A squaring whose result would exceed
``STRIDE_GROWTH`` times the edges is not made (the count of its paths is summed
first); the closure then goes on with the strides it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtables.scratch import Scratch, delete_path

STRIDE_AFTER = 4
STRIDE_GROWTH = 4.0
SQUARINGS = 2
COMPACT_AFTER = 8
EDGES_PER_PART = 100_000
LEAST_HEAVY = 1_000


class _Steps:
    """What a round follows: ``(scope, node, part, _dst)``, kept partitioned by
    ``(scope, node, part)``."""

    def __init__(self, edges: DataFrame, scope: Sequence[str], scratch: Scratch, n: int,
                 per_part: int):
        self.scope, self.scratch, self.n, self.per_part = list(scope), scratch, n, per_part
        self.key = [*self.scope, "node"]
        # partial aggregation first, so a much-repeated edge costs one row per task
        self.longest = edges.select(*self.scope, F.col("src").alias("node"), F.col("dst").alias("_dst")) \
            .dropDuplicates([*self.key, "_dst"])
        self.edges, self.all, self.kept = None, self.longest, None
        self._keep()

    def _keep(self) -> None:
        # sorted as every round's merge join needs it, so no round sorts the steps again
        kept, self.kept = self.kept, self.all.repartition(self.n, *self.key) \
            .sortWithinPartitions(*self.key).persist(StorageLevel.MEMORY_AND_DISK)
        hubs = self.kept.groupBy(*self.key).agg(F.count(F.lit(1)).alias("n")) \
            .where(F.col("n") > self.per_part)
        self.hubs = self.scratch.table(hubs.select(
            *self.key, F.ceil(F.col("n") / self.per_part).cast("int").alias("parts")), "hubs")
        self.has_hubs = self.hubs.first() is not None
        if kept is not None:
            kept.unpersist()
        if self.has_hubs:  # only then is there more than one part of a node
            whole = self.kept
            self.kept = whole.join(self.hubs, self.key, "left").select(
                *self.key, F.when(F.col("parts").isNull(), 0).otherwise(
                    F.pmod(F.xxhash64("_dst"), F.col("parts"))).cast("int").alias("part"), "_dst") \
                .repartition(self.n, *self.key, "part").sortWithinPartitions(*self.key, "part") \
                .persist(StorageLevel.MEMORY_AND_DISK)
            self.kept.count()
            whole.unpersist()

    def close(self) -> None:
        self.kept.unpersist()

    def double(self) -> bool:
        """Add steps of twice the longest stride, if they are few enough."""
        if self.edges is None:
            self.all = self.longest = self.scratch.table(self.kept.select(*self.key, "_dst"), "steps")
            self.edges = self.longest.count()
        a = self.longest
        into = a.groupBy(*self.scope, F.col("_dst").alias("node")).agg(F.count(F.lit(1)).alias("i"))
        paths = into.join(a.groupBy(*self.key).agg(F.count(F.lit(1)).alias("o")), self.key) \
            .agg(F.sum(F.col("i").cast("double") * F.col("o"))).first()[0]
        if not paths or paths > STRIDE_GROWTH * self.edges:
            return False
        b = a.withColumnsRenamed({"node": "_mid", "_dst": "_end"})
        two = a.withColumnRenamed("_dst", "_mid").join(b, [*self.scope, "_mid"]) \
            .select(*self.key, F.col("_end").alias("_dst")).distinct()
        self.longest = self.scratch.table(two, "steps")
        self.all = self.all.unionByName(self.longest)
        return True

    def follow(self, frontier: DataFrame, cols: Sequence[str], size: int) -> DataFrame:
        """One step from every frontier row: ``cols`` with the node reached."""
        rest = [c for c in cols if c not in self.key]
        on, steps = list(self.key), self.kept
        frontier = frontier.select(*cols)
        if self.has_hubs:
            frontier = frontier.join(self.hubs, self.key, "left").withColumn(
                "part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
            on.append("part")

        def reached(rows: DataFrame, by: Sequence[str], to: DataFrame) -> DataFrame:
            # the node comes from a generator: an anti-join by nodes alone would else be
            # pushed to the steps, and every round would shuffle all of them
            return rows.join(to, list(by)).select(*self.scope, *rest, F.explode(F.array("_dst")).alias("node"))
        share = max(LEAST_HEAVY, -(-size // self.n))
        if not rest or size <= share:  # a node occurs once, or all fit one task
            return reached(frontier, on, steps)
        # fewer nodes than tasks have more than a task's share
        heavy = self.scratch.table(
            frontier.groupBy(*on).agg(F.count(F.lit(1)).alias("_f")).where(F.col("_f") > share)
            .select(*on), "heavy")
        if heavy.first() is None:
            return reached(frontier, on, steps)
        heavy = F.broadcast(heavy)
        salts = F.explode(F.sequence(F.lit(0), F.lit(self.n - 1))).alias("_salt")
        hot = frontier.join(heavy, on, "left_semi").withColumn(
            "_salt", F.pmod(F.xxhash64(*rest), F.lit(self.n)).cast("int"))
        hot_steps = steps.join(heavy, on, "left_semi").select("*", salts)
        return reached(frontier.join(heavy, on, "left_anti"), on, steps) \
            .unionByName(reached(hot, [*on, "_salt"], hot_steps))


class _Seen:
    """The closure so far: a table of ``cols`` and ``level``, partitioned by
    ``round`` (a round reads back its own folder only) and bucketed on ``cols``."""

    def __init__(self, scratch: Scratch, cols: Sequence[str], n: int):
        self.scratch, self.spark, self.cols, self.n = scratch, scratch.spark, list(cols), n
        self.name = self.path = None

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, df: DataFrame, level: int) -> tuple[DataFrame, int]:
        """Add a round's pairs, which are partitioned by ``cols`` already."""
        df = df.withColumns({"level": F.lit(level), "round": F.lit(level)})
        if self.name is None:
            self._create(df, level)
        else:
            self._write(df, "append")
            if level % COMPACT_AFTER == 0:
                self._compact(level)
        part = self.rows().where(F.col("round") == level)
        return part, part.count()

    def _create(self, df: DataFrame, level: int) -> None:
        self.name = self.scratch.own_table(f"closure{level}")
        self.path = self.scratch.path("seen")
        self._write(df, "error")

    def _write(self, df: DataFrame, mode: str) -> None:
        df.write.mode(mode).format("parquet").partitionBy("round").bucketBy(self.n, *self.cols) \
            .option("path", self.path).saveAsTable(self.name)

    def _compact(self, level: int) -> None:
        """One file per bucket for all rounds before the last; the scan of the
        table is partitioned by ``cols``, so nothing is shuffled."""
        name, path = self.name, self.path
        latest = F.when(F.col("round") == level, level).otherwise(-1)
        self._create(self.rows().withColumn("round", latest), level)
        self.spark.sql(f"DROP TABLE {name}")
        delete_path(self.spark, path)


def _closure(edges: DataFrame, start: DataFrame, cols: Sequence[str], scope: Sequence[str],
             max_rounds: int | None, with_depth: bool, stride_after: int | None,
             per_part: int) -> DataFrame:
    spark = edges.sparkSession
    scratch = Scratch(spark, "closure")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = list(cols)
    steps = _Steps(edges, scope, scratch, n, per_part)
    seen = _Seen(scratch, cols, n)
    frontier, size = seen.append(start.select(*cols).dropDuplicates(cols).repartition(n, *cols), 0)
    rounds, growing = 0, not with_depth and stride_after is not None
    try:
        while size > 0:
            if max_rounds is not None and rounds >= max_rounds:
                raise RuntimeError(f"closure not reached in {max_rounds} rounds")
            rounds += 1
            if growing and rounds > stride_after:
                grown = 0
                while grown < SQUARINGS and steps.double():
                    grown += 1
                growing = grown == SQUARINGS
                if grown:
                    steps._keep()
            # candidates are shuffled once to the buckets of the table; the
            # anti-join reads the table in place and duplicates drop out
            # inside each partition
            step = steps.follow(frontier, cols, size).repartition(n, *cols)
            new = step.join(seen.rows().select(*cols), cols, "left_anti").dropDuplicates(cols)
            frontier, size = seen.append(new, rounds)
    finally:
        steps.close()
    out = seen.rows()
    return out.select(*cols, F.col("level").alias("depth")) if with_depth else out.select(*cols)


def deps_closure(edges: DataFrame, roots: DataFrame, scope: Sequence[str] = (),
                 max_rounds: int | None = None, with_depth: bool = False,
                 stride_after: int | None = STRIDE_AFTER, per_part: int = EDGES_PER_PART
                 ) -> DataFrame:
    """G1: (root, node) for every node reachable from each root, roots
    included.  ``edges``: (src, dst); ``roots``: (root).  ``scope`` columns
    (e.g. repository, commit_hash) on both sides keep snapshots apart.
    ``depth`` (optional) is the length of the shortest path; it takes one round
    per level, as steps of several edges would skip levels."""
    start = roots.select(*scope, "root", F.col("root").alias("node"))
    return _closure(edges, start, [*scope, "root", "node"], scope, max_rounds, with_depth,
                    stride_after, per_part)


def deps_reach(edges: DataFrame, roots: DataFrame, scope: Sequence[str] = (),
               max_rounds: int | None = None, with_depth: bool = False,
               stride_after: int | None = STRIDE_AFTER, per_part: int = EDGES_PER_PART
               ) -> DataFrame:
    """The set of nodes reachable from any root (one set, no root column),
    so the frontier stays linear in the number of nodes."""
    start = roots.select(*scope, F.col("root").alias("node"))
    return _closure(edges, start, [*scope, "node"], scope, max_rounds, with_depth, stride_after,
                    per_part)
