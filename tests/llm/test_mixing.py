"""Mixing: targets by plain clamping rounds, samples near their targets."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from jobtables.llm.mixing import mix, mixed_documents

SF01 = "/root/testdata/sf0.01"


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total >= cap * sizes[s]]
        if not over:
            out |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            out[s] = cap * sizes[s]
            open_.discard(s)
        left -= sum(out[s] for s in over)
    return out


def check(rows, texts):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(int)
    for _, s, t in texts:
        by[s] += size(t)
    want = plain_targets(by)
    source = {d: s for d, s, _ in texts}
    taken = defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == by[s]
        assert r.target == pytest.approx(want[s])
        assert r.taken <= 2 * r.size
        taken[s] += r.taken
    return want, taken


def test_targets_and_taken_words(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    texts = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    rows = mix(docs).collect()
    want, taken = check(rows, texts)
    for s in want:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 5, (s, taken[s], want[s])
    assert sorted(rows) == sorted(mix(docs.repartition(7)).collect())
    assert {r.taken for r in mix(docs, seed=8).collect()} != {r.taken for r in rows}


def test_mixed_documents_repeat_whole_rows(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").limit(200).cache()
    plan = {r.doc_id: r for r in mix(docs).collect()}
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    times = defaultdict(int)
    for r in out.collect():
        times[r.doc_id] += 1
    assert all(plan[d].taken == plan[d].size * times[d] for d in plan)


def test_edges(spark):
    rows = [(1, None, None), (2, "a", ""), (3, "a", " \t"), (4, "b", "one two three"),
            (5, "b", "one two three"), (5, "b", "one two three"), (None, "c", "x " * 50),
            (7, None, "w " * 100), (8, "é", "w " * 100000), (9, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string") \
        .withColumns({c: F.lit(1) for c in ("size", "key", "skey", "target", "row", "whole")})
    got = mix(df).collect()
    assert len(got) == len(rows)
    check(got, rows)
    assert all(r.taken == 0 for r in got if not r.size)
    assert mixed_documents(df).columns == df.columns


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mix(df).count() == 0 and mixed_documents(df).count() == 0
    blank = spark.createDataFrame([(1, "a", None)], "doc_id long, source string, text string")
    assert [tuple(r) for r in mix(blank).collect()] == [(1, 0, 0, 0.0, 0)]


def test_equals_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from jobtables.llm.mixing import ORACLE_SQL
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF01}/documents.parquet')")
    cur = con.execute(ORACLE_SQL)
    names = [c[0] for c in cur.description]
    got = mix(spark.read.parquet(f"{SF01}/documents.parquet"))
    assert names == got.columns
    assert sorted(cur.fetchall()) == sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("same_text", [True, False])
def test_repeated_ids_reach_the_target(spark, same_text):
    """400 documents and 600 rows of one id, with one text or many: whatever
    the seed, the words taken lie within 1 % of the target."""
    rows = [(i, "a", "w " * 100) for i in range(400)]
    rows += [(1_000, "a", "w " * 99 + ("w" if same_text else f"v{i}")) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").cache()
    for seed in (1, 2, 3, 7, 9):
        got = mix(df, seed=seed).collect()
        assert len(got) == 1_000 and {r.taken for r in got} <= {100, 200}
        assert abs(sum(r.taken for r in got) - 150_000) <= 1_500
        assert sorted(got) == sorted(mix(df.repartition(5), seed=seed).collect())
    assert abs(mixed_documents(df, seed=3).count() - 1_500) <= 15


def test_equals_sql_with_copies_and_small_sources(spark):
    duckdb = pytest.importorskip("duckdb")
    import random

    import pandas as pd

    from jobtables.llm.mixing import ORACLE_SQL
    rnd = random.Random(5)
    rows = [(rnd.choice([1, 2, 3, None, rnd.randint(0, 500)]), rnd.choice(["a", "a", "b", "ç", None]),
             rnd.choice(["x " * rnd.randint(0, 40), "y " * 7, None, ""])) for _ in range(900)]
    documents = pd.DataFrame(rows, columns=["doc_id", "source", "text"])
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM documents")
    want = con.execute(ORACLE_SQL).fetchall()
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    assert sorted(want, key=str) == sorted((tuple(r) for r in mix(df).collect()), key=str)
