"""Job-table views over the driver's test tables (FIXTURES.md §3).

Each view is a plain projection of one or two test tables, so the work of
every query built on them grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _days(n) -> F.Column:
    return F.make_dt_interval(n.cast("int"), F.lit(0), F.lit(0), F.lit(0))


def jobs_v(spark: SparkSession, sf_dir: str, with_priority: bool = False) -> DataFrame:
    """The job table, one row per order (``with_priority`` keeps the order's
    priority as an extra column)."""
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    st, price = F.col("o_orderstatus"), F.col("o_totalprice")
    done_ok = (st == "F") & (price >= 250000) & (k % 50 != 0)
    done_bad = (st == "F") & (price < 250000) & (k % 50 != 0)
    return o.select(
        k.alias("id"),
        F.concat(F.lit("repo/"), (c % 30).cast("string")).alias("repository"),
        F.concat(F.lit("c"), (k % 5).cast("string")).alias("commit_hash"),
        F.concat(F.lit("q"), (c % 997).cast("string")).alias("query_string"),
        F.when(st == "O", "pending").when(st == "P", "running")
         .when(price < 250000, "failed").otherwise("succeeded").alias("status"),
        F.when(st != "O", F.concat(F.lit("worker-"), (c % 10).cast("string"))).alias("worker"),
        F.col("o_orderdate").alias("queue_time"),
        F.when(st != "O", F.col("o_orderdate") + _days(k % 7)).alias("start_time"),
        F.when(st == "F", F.col("o_orderdate") + _days(k % 7 + k % 3 + 1)).alias("finish_time"),
        F.when(done_ok, F.concat(F.lit("gs://bucket/"), k.cast("string"), F.lit(".pb"))
               ).alias("result_url"),
        F.when(done_bad, F.lit("some query failure")).alias("result_error"),
        *([F.col("o_orderpriority").alias("priority")] if with_priority else []),
    )


def requests_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enqueue requests: click and view events."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    i = F.col("event_id")
    return e.select(
        i.alias("request_id"),
        F.concat(F.lit("repo/"), ((i % 1500) % 30).cast("string")).alias("repository"),
        F.concat(F.lit("c"), (i % 5).cast("string")).alias("commit_hash"),
        F.concat(F.lit("q"), ((i % 1500) % 997).cast("string")).alias("query_string"),
        F.col("ts").alias("request_time"),
    )


def finish_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finish requests: purchase = success, error = failure, signup = unset.
    Three neighbouring events name one job, so ids repeat in a batch."""
    e = table(spark, sf_dir, "events").where(
        F.col("event_type").isin("purchase", "error", "signup"))
    i, t = F.col("event_id"), F.col("event_type")
    return e.select(
        i.alias("finish_id"),
        ((i - i % 3) * 2).cast("bigint").alias("job_id"),
        F.when(t == "purchase", F.concat(F.lit("gs://bucket/"), (i * 2).cast("string"),
                                         F.lit(".pb"))).alias("query_result_location"),
        F.when(t == "error", F.lit("query failed")).alias("failure_message"),
        F.col("ts").alias("finish_ts"),
    )


def repos_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository dimension: repository -> workspace."""
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.concat(F.lit("repo/"), F.col("n_nationkey").cast("string")).alias("repository"),
        F.col("n_name").alias("workspace"),
    )


def polls_v(spark: SparkSession, sf_dir: str, surplus: bool = False) -> DataFrame:
    """Worker polls: purchase and error events (``surplus``: all events, more
    than there are pending jobs)."""
    e = table(spark, sf_dir, "events")
    if not surplus:
        e = e.where(F.col("event_type").isin("purchase", "error"))
    u = F.col("user_id")
    return e.select(
        F.col("event_id").alias("poll_id"),
        F.concat(F.lit("worker-"), (u % 10).cast("string")).alias("worker_name"),
        F.concat(F.lit("repo/"), (u % 30).cast("string")).alias("repository"),
        F.col("ts").alias("poll_time"),
    )


def dedup_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and failures keyed by user: click/view = request, error = fail."""
    e = table(spark, sf_dir, "events").where(
        F.col("event_type").isin("click", "view", "error"))
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id"),
        F.col("ts").alias("t"),
        F.when(F.col("event_type") == "error", "fail").otherwise("request").alias("kind"),
    )


def strict_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_log where every failure names a job.  Every fifth event id names
    the user's first request (stale once that job is closed); the others name
    the user's latest request, which closes the current job where that request
    has created it, so long chains of jobs arise."""
    log = dedup_log(spark, sf_dir)
    request = F.when(F.col("kind") == "request", F.col("id"))
    w = Window.partitionBy("user_id").orderBy("t", "id")
    named = F.when(F.col("id") % 5 == 0, F.first(request, ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) \
        .otherwise(F.last(request, ignorenulls=True).over(
            w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return log.select("id", "user_id", "t", "kind",
                      F.when(F.col("kind") == "fail", named).alias("target"))


def claim_log(spark: SparkSession, sf_dir: str, starved: bool = False) -> DataFrame:
    """Enqueues and worker polls in one log.  Normal: click/view enqueue,
    purchase/error poll.  Starved: click enqueues, all others poll."""
    e = table(spark, sf_dir, "events")
    t = F.col("event_type")
    if starved:
        kind = F.when(t == "click", "enqueue").otherwise("poll")
    else:
        e = e.where(t.isin("click", "view", "purchase", "error"))
        kind = F.when(t.isin("click", "view"), "enqueue").otherwise("poll")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("t"), kind.alias("kind"))


def repository_claim_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_log with a repository; half of the rows lie in one."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id")
    repo = F.when(F.col("event_id") % 2 == 0, F.lit("repo/hot")).otherwise(
        F.concat(F.lit("repo/"), (F.col("user_id") % 30).cast("string")))
    return claim_log(spark, sf_dir).join(e.select(F.col("event_id").alias("id"), repo.alias("repository")),
                                         "id")


def edges_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys as dependency edges (src depends on dst), as a bag."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")

    def node(prefix, col):
        return F.concat(F.lit(prefix), F.col(col).cast("string"))

    parts = [
        # one scan of lineitem for both of its edge kinds
        li.select(node("o", "l_orderkey").alias("src"),
                  F.explode(F.array(node("p", "l_partkey"), node("s", "l_suppkey"))).alias("dst")),
        o.select(node("o", "o_orderkey").alias("src"), node("c", "o_custkey").alias("dst")),
        c.select(node("c", "c_custkey").alias("src"), node("n", "c_nationkey").alias("dst")),
        s.select(node("s", "s_suppkey").alias("src"), node("n", "s_nationkey").alias("dst")),
        n.select(node("n", "n_nationkey").alias("src"), node("r", "n_regionkey").alias("dst")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # repeated pairs (an order holds a part on several lines) are left in: the
    # closure operators drop them
    return out


def scoped_edges_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges per snapshot ``(repository, commit_hash)``: an order's edges lie in
    the repository of its key, in two commits that differ in some lines; other
    edges lie in one snapshot each."""
    def node(prefix, col):
        return F.concat(F.lit(prefix), F.col(col).cast("string"))

    def repo(col):
        return F.concat(F.lit("repo/"), (F.col(col) % 30).cast("string")).alias("repository")

    def commit(n):
        return F.concat(F.lit("c"), n.cast("string")).alias("commit_hash")

    both = F.explode(F.array(F.lit(0), F.lit(1))).alias("c")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey",
                                                 "l_linenumber", both)
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", both)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", both)
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    parts = [
        li.where((F.col("l_linenumber") + F.col("c")) % 3 != 0).select(
            repo("l_orderkey"), commit(F.col("c")), node("o", "l_orderkey").alias("src"),
            F.explode(F.array(node("p", "l_partkey"), node("s", "l_suppkey"))).alias("dst")),
        o.select(repo("o_orderkey"), commit(F.col("c")), node("o", "o_orderkey").alias("src"),
                 node("c", "o_custkey").alias("dst")),
        c.select(repo("c_custkey"), commit(F.col("c_custkey") % 2),
                 node("c", "c_custkey").alias("src"), node("n", "c_nationkey").alias("dst")),
        s.select(repo("s_suppkey"), commit(F.col("s_suppkey") % 2),
                 node("s", "s_suppkey").alias("src"), node("n", "s_nationkey").alias("dst")),
        n.select(repo("n_nationkey"), commit(F.col("c")), node("n", "n_nationkey").alias("src"),
                 node("r", "n_regionkey").alias("dst")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def odd_repositories_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repository texts with slashes in odd places, one per event."""
    i = F.col("event_id")
    name = F.concat(F.lit("r"), (i % 11).cast("string"))
    forms = ["", "/", "//", "///"]
    odd = [F.lit(x) for x in forms] + [
        name, F.concat(name, F.lit("/")), F.concat(F.lit("/"), name), F.concat(F.lit("a//"), name, F.lit("//")),
        F.concat(F.lit("https://host/x/"), name, F.lit("/")), F.concat(name, F.lit(".git")),
        F.concat(F.lit("."), F.lit("/"), name), F.concat(name, F.lit("/.."))]
    return table(spark, sf_dir, "events").select(
        F.element_at(F.array(*odd), (i % len(odd) + 1).cast("int")).alias("repository"))


def query_root(query_string: str) -> F.Column:
    """The node that a job's query asks about: ``q<k>`` asks for the
    dependencies of order node ``o<k>``."""
    return F.concat(F.lit("o"), F.substring(F.col(query_string), 2, 1 << 30))


def roots_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closure roots: every urgent order."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    return o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("root"))


def line_ids_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that repeat: order and line number of lineitem."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat_ws("/", F.col("l_orderkey").cast("string"),
                                 F.col("l_linenumber").cast("string")).alias("id"))


def job_log_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The life-cycle event log that produces jobs_v: one request per job,
    a start per dequeued job, a succeed or fail per finished job."""
    from jobtables.operators.update import job_events
    return job_events(jobs_v(spark, sf_dir))


def dump_lines_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jobs_text_v as JSON lines, some of them damaged: every 97th is cut off,
    every 89th lacks its status, every 83rd has an empty query (a sound one),
    and low-priority orders have a queue time without an offset."""
    j = jobs_text_v(spark, sf_dir, corrupt=True)
    k = F.col("id").cast("long")

    def text(c, value):
        return F.when(value.isNotNull(), F.concat(F.lit(f',"{c}":"'), value, F.lit('"'))).otherwise(F.lit(""))
    query = F.when(k % 83 == 0, F.lit("")).otherwise(F.col("query_string"))
    status = F.when(k % 89 != 0, F.col("status"))
    line = F.concat(F.lit('{"id":"'), F.col("id"), F.lit('"'), *[text(c, F.col(c)) for c in (
        "repository", "commit_hash")], text("query_string", query), text("status", status),
        *[text(c, F.col(c)) for c in ("worker", "queue_time", "start_time", "finish_time",
                                      "query_result_url", "query_error")], F.lit("}"))
    return j.select(F.when(k % 97 == 0, F.substring(line, 1, 60)).otherwise(line).alias("value"))


def user_log_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A life-cycle log with many events per job and few dates: one job per
    user, signup = start, purchase = succeed, error = fail, others = request."""
    t, u, i = F.col("event_type"), F.col("user_id"), F.col("event_id")
    kind = F.when(t == "signup", "start").when(t == "purchase", "succeed").when(t == "error", "fail") \
        .otherwise("request")
    asked, ended = t.isin("click", "view"), t.isin("purchase", "error")
    return table(spark, sf_dir, "events").select(
        u.alias("job_id"), kind.alias("kind"), F.col("ts"),
        F.when(asked, F.concat(F.lit("repo/"), (u % 30).cast("string"))).alias("repository"),
        F.when(asked, F.concat(F.lit("c"), (u % 5).cast("string"))).alias("commit_hash"),
        F.when(asked, F.concat(F.lit("q"), u.cast("string"))).alias("query_string"),
        F.when(t == "signup", F.concat(F.lit("worker-"), (i % 10).cast("string"))).alias("worker"),
        F.when(ended, F.concat(F.lit("r"), i.cast("string"))).alias("result"))


def jobs_text_v(spark: SparkSession, sf_dir: str, corrupt: bool = False) -> DataFrame:
    """jobs_v as the SQL store dumps it: times as RFC 3339 text, id as text,
    result columns under their SQL names.  Urgent orders carry their times
    as Pacific local time with a -08:00 offset.  With ``corrupt``,
    low-priority orders lose the offset of their queue time (an invalid
    value, for quarantine)."""
    from jobtables.functions.timefmt import rfc3339_encode
    j = jobs_v(spark, sf_dir, with_priority=True)

    def enc(c):
        local = rfc3339_encode(F.col(c) - F.make_dt_interval(F.lit(0), F.lit(8)), "-08:00")
        return F.when(F.col("priority") == "1-URGENT", local).otherwise(rfc3339_encode(c))

    q = enc("queue_time")
    if corrupt:
        q = F.when(F.col("priority") == "5-LOW",
                   rfc3339_encode("queue_time", offset="")).otherwise(q)
    return j.select(
        F.col("id").cast("string").alias("id"), "repository", "commit_hash", "query_string",
        "status", "worker", q.alias("queue_time"), enc("start_time").alias("start_time"),
        enc("finish_time").alias("finish_time"),
        F.col("result_url").alias("query_result_url"),
        F.col("result_error").alias("query_error"),
    )
