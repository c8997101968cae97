"""Dependency closure (G1, G2) and the flagship batch."""

import random

import pytest
from pyspark.sql import functions as F

from jobtables.operators import closure
from jobtables.operators.closure import deps_closure, deps_reach
from jobtables.scratch import Scratch, scratch_scope


def test_cycle_terminates(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    roots = spark.createDataFrame([("a",), ("d",)], "root string")
    got = sorted((r.root, r.node) for r in deps_closure(edges, roots).collect())
    assert got == [("a", "a"), ("a", "b"), ("a", "c"), ("a", "d"), ("d", "d")]
    depth = {r.node: r.depth for r in deps_closure(edges, roots, with_depth=True)
             .where("root = 'a'").collect()}
    assert depth == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_all_sources_as_roots_reach_src_union_dst(spark):
    edges = spark.createDataFrame([("x", "y"), ("y", "z"), ("w", "z")], "src string, dst string")
    roots = edges.selectExpr("src AS root").distinct()
    got = sorted(r.node for r in deps_reach(edges, roots).collect())
    assert got == ["w", "x", "y", "z"]


def test_scoped_snapshots(spark):
    edges = spark.createDataFrame([("r1", "a", "b"), ("r2", "a", "c")],
                                  "repository string, src string, dst string")
    roots = spark.createDataFrame([("r1", "a"), ("r2", "a")], "repository string, root string")
    got = sorted(tuple(r) for r in deps_closure(edges, roots, scope=["repository"]).collect())
    assert got == [("r1", "a", "a"), ("r1", "a", "b"), ("r2", "a", "a"), ("r2", "a", "c")]


def plain(edges, roots):
    """Reachable nodes per root, by a walk."""
    out = set()
    nexts = {}
    for a, b in edges:
        nexts.setdefault(a, set()).add(b)
    for r in roots:
        todo, seen = [r], {r}
        while todo:
            new = nexts.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        out |= {(r, n) for n in seen}
    return out


@pytest.mark.parametrize("per_part,stride_after", [(100_000, 1), (3, 1), (2, None)])
def test_random_graphs(spark, monkeypatch, per_part, stride_after):
    """Cycles, repeated edges, hubs and long paths; strides and split hubs
    change no pair."""
    monkeypatch.setattr(closure, "LEAST_HEAVY", 2)
    monkeypatch.setattr(closure, "COMPACT_AFTER", 3)
    rnd = random.Random(per_part)
    edges = [(f"n{rnd.randint(0, 30)}", f"n{rnd.randint(0, 30)}") for _ in range(30)]
    edges += [(f"p{i}", f"p{i + 1}") for i in range(25)] + [("n1", "p0"), ("p25", "hub")]
    edges += [(f"n{i}", "hub") for i in range(12)] + [("hub", f"h{i}") for i in range(15)]
    edges += edges[:20]
    roots = [f"n{i}" for i in range(15)] + ["p3", "alone"]
    e = spark.createDataFrame(edges, "src string, dst string")
    r = spark.createDataFrame([(x,) for x in roots], "root string")
    got = [tuple(x) for x in deps_closure(e, r, stride_after=stride_after, per_part=per_part).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(edges, roots)
    reach = [x.node for x in deps_reach(e, r, stride_after=stride_after, per_part=per_part).collect()]
    assert sorted(reach) == sorted({n for _, n in plain(edges, roots)})


def test_500_levels_in_few_rounds(spark):
    chain = [(i, i + 1) for i in range(500)]
    side = [(i, 10_000 + i) for i in range(500)]  # every level branches
    e = spark.createDataFrame(chain + side, "src long, dst long")
    r = spark.createDataFrame([(0,), (100,)], "root long")
    got = deps_closure(e, r, max_rounds=16)
    assert {tuple(x) for x in got.collect()} == plain(chain + side, [0, 100])


def test_hub_is_no_single_task(spark):
    """20,000 of 40,000 frontier rows lie on one node of many edges: no task of
    the round holds more than twice the mean."""
    n, rows = 8, 40_000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.range(50).selectExpr("'hub' AS src", "concat('x', id) AS dst").unionByName(
            spark.range(rows).selectExpr("concat('n', id) AS src", "concat('y', id) AS dst"))
        frontier = spark.range(rows).selectExpr(
            "id AS root", "if(id % 2 = 0, 'hub', concat('n', id)) AS node")
        steps = closure._Steps(edges, [], Scratch(spark, "t"), n, 10)
        assert steps.has_hubs
        out = steps.follow(frontier, ["root", "node"], rows)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        steps.close()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == rows // 2 * 50 + rows // 2
    hot = sorted(sizes)[-n:]
    assert max(hot) <= 2 * sum(hot) / len(hot)


def test_scope_frees_tables_and_folders(spark):
    import os
    root = spark.sparkContext.getCheckpointDir().replace("file:", "")

    def listed():
        return sorted(os.listdir(root)), sorted(t.name for t in spark.catalog.listTables())
    before = listed()
    e = spark.createDataFrame([(i, i + 1) for i in range(20)], "src long, dst long")
    r = spark.createDataFrame([(0,)], "root long")
    with scratch_scope(spark):
        assert deps_closure(e, r).count() == 21
        assert listed() != before
    assert listed() == before


def test_max_rounds_raises(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    roots = spark.createDataFrame([("a",)], "root string")
    with pytest.raises(RuntimeError):
        deps_closure(edges, roots, max_rounds=1).collect()


def test_run_jobs_keeps_snapshots_apart(spark):
    """The same query on two commits follows each commit's own edges; a job
    of an unknown repository fails."""
    import datetime as dt

    from jobtables.plans.run_jobs import run_jobs
    from jobtables.schema import job_schema
    t0 = dt.datetime(2024, 1, 1)
    jobs = spark.createDataFrame(
        [(i, r, c, "a", "pending", None, t0 + dt.timedelta(seconds=k), None, None, None, None)
         for k, (i, r, c) in enumerate([("1", "r", "c1"), ("2", "r", "c2"), ("3", "x", "c1")])],
        job_schema())
    polls = spark.createDataFrame([(k, "w", "r", t0 + dt.timedelta(minutes=1 + k)) for k in range(3)],
                                  "poll_id long, worker_name string, repository string, "
                                  "poll_time timestamp_ntz")
    repos = spark.createDataFrame([("r", "ws")], "repository string, workspace string")
    edges = spark.createDataFrame([("c1", "a", "b"), ("c2", "a", "d"), ("c2", "d", "e")],
                                  "commit_hash string, src string, dst string")
    out = run_jobs(jobs, polls, repos, edges, root=F.col("query_string"), scope=["commit_hash"])
    assert {(r.job_id, r.node) for r in out.results.collect()} == \
        {("1", "a"), ("1", "b"), ("2", "a"), ("2", "d"), ("2", "e")}
    assert {(r.job_id, r.status, r.n_deps) for r in out.outcomes.collect()} == \
        {("1", "succeeded", 2), ("2", "succeeded", 3), ("3", "failed", 0)}
    assert {(r.id, r.status) for r in out.jobs.collect()} == \
        {("1", "succeeded"), ("2", "succeeded"), ("3", "failed")}


def test_reach_rounds_leave_the_steps_in_place(spark, monkeypatch):
    """No round sorts or shuffles the edges again, nor joins them to what was seen."""
    from jobtables.operators import closure
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    plans, append, old = [], closure._Seen.append, spark.conf.get(threshold)

    def noted(self, df, level):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return append(self, df, level)
    monkeypatch.setattr(closure._Seen, "append", noted)
    spark.conf.set(threshold, "-1")
    try:
        edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
        roots = spark.createDataFrame([("a",)], "root string")
        assert sorted(r.node for r in deps_reach(edges, roots).collect()) == ["a", "b", "c"]
        steps = closure._Steps(edges, [], closure.Scratch(spark, "t"), 8, 100)
        assert "Sort [node" in steps.kept._jdf.queryExecution().optimizedPlan().toString()
        steps.close()
    finally:
        spark.conf.set(threshold, old)
    for plan in plans[1:]:
        lines = plan.splitlines()
        anti = next(i for i, x in enumerate(lines) if "LeftAnti" in x)
        inner = next(i for i, x in enumerate(lines) if "Join Inner" in x)
        assert anti < inner  # the frontier is followed first
