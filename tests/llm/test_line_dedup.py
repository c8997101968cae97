"""Line dedup against the plain rule on windows of lines."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from jobtables.llm.line_dedup import (
    ORACLE_SQL, line_report, remove_repeated_lines, suffix_array)
from jobtables.llm.shared import Scratch
from jobtables.scratch import scratch_scope

SF01 = "/root/testdata/sf0.01"


def brute(rows, m):
    """rows in order of (id, row): a window of m lines seen before goes."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    seen, gone = set(), {k: set() for k in order}
    for k in order:
        lines = [] if rows[k][1] is None else rows[k][1].split("\n")
        for i in range(len(lines) - m + 1):
            w = tuple(lines[i:i + m])
            if w in seen:
                gone[k] |= set(range(i, i + m))
            seen.add(w)
    out = []
    for k in order:
        lines = [] if rows[k][1] is None else rows[k][1].split("\n")
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone[k])
        runs = sum(1 for i in gone[k] if i - 1 not in gone[k])
        out.append((rows[k][0], len(lines), len(gone[k]), runs,
                    hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_equals_plain_windows(spark, m):
    random.seed(m)
    rows = [(i, "\n".join(random.choice("abcdé") for _ in range(random.randint(1, 14))))
            for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n\n\n\n"), (103, "\n".join(["x"] * 3000)),
             (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string") \
        .withColumns({c: F.lit(1) for c in ("row", "line", "rank", "record", "runs")})
    assert sorted(map(tuple, line_report(df, m).collect()), key=str) == brute(rows, m)
    clean = remove_repeated_lines(df, m)
    assert clean.columns == df.columns
    got = {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest())
           for r in clean.collect()}
    assert got == {(r[0], r[4]) for r in brute(rows, m)}


def test_repeated_rows_keep_one_copy(spark):
    text = "one\ntwo\nthree\nfour"
    df = spark.createDataFrame([(1, text)] * 20, "doc_id long, text string")
    kept = [r.text for r in remove_repeated_lines(df).collect()]
    assert sorted(kept) == [""] * 19 + [text]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_report(df).count() == 0 and remove_repeated_lines(df).count() == 0


def test_documents_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF01}/documents.parquet')")
    cur = con.execute(ORACLE_SQL)
    names, want = [c[0] for c in cur.description], sorted(map(tuple, cur.fetchall()))
    got = line_report(spark.read.parquet(f"{SF01}/documents.parquet"))
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == want
    assert sum(r[2] for r in want) > 0


def brute_words(rows, m, least):
    """As ``brute``, and windows of fewer lines go if they hold ``least`` words."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    seen, out = set(), []
    for k in order:
        lines = [] if rows[k][1] is None else rows[k][1].split("\n")
        gone = set()
        for i in range(len(lines)):
            for d in range(1, m + 1):
                w = tuple(lines[i:i + d])
                if len(w) == d and (d == m or sum(len(x.split()) for x in w) >= least):
                    gone |= set(range(i, i + d)) if w in seen else set()
                    seen.add(w)
        kept = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out.append((rows[k][0], len(lines), len(gone), sum(1 for i in gone if i - 1 not in gone),
                    hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("m", [1, 3, 5])
def test_runs_of_many_words_go(spark, m):
    random.seed(20 + m)
    some = ["", "a", "b", "a b c", "a b d e", "x y z v w u", "long " * 8]
    rows = [(i, "\n".join(random.choices(some, k=random.randint(1, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "new " * 9), (103, "new " * 9), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, line_report(df, m, 6).collect()), key=str) == brute_words(rows, m, 6)
    kept = {r.doc_id: r.text for r in remove_repeated_lines(df, m, 6).collect()}
    assert kept[102] and kept[103] == ""


def test_words_equal_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from jobtables.llm.line_dedup import WORDS_SQL
    from jobtables.llm.queries import op3_line_dedup
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF01}/documents.parquet')")
    want = sorted(map(tuple, con.execute(WORDS_SQL).fetchall()))
    assert sorted(map(tuple, op3_line_dedup(spark, SF01).collect())) == want
    fewer = con.execute(ORACLE_SQL).fetchall()
    assert sum(r[2] for r in want) > sum(r[2] for r in fewer)


def test_suffix_array_and_common_prefixes(spark):
    """Every suffix that begins with a repeated line has one place; neighbours'
    common prefixes, and the longest of each suffix, are the plain ones."""
    random.seed(5)
    texts = [random.choices("abc", k=random.randint(1, 12)) for _ in range(25)]
    texts += [[f"l{i}" for i in range(300)], ["new"] + [f"l{i}" for i in range(300)], ["c"] * 40]
    df = spark.createDataFrame(
        [(r, r // 2, i, s) for r, t in enumerate(texts) for i, s in enumerate(t)],
        "row long, doc_id long, line int, s string")
    lines = df.select("row", "doc_id", "line", F.xxhash64("s").alias("a"), F.hash("s").alias("b"),
                      F.length("s").cast("long").alias("words"))
    with scratch_scope(spark):
        got = sorted((r.pos, r.row, r.line, r.lcp, r.words1, r.words2) for r in
                     suffix_array(lines, Scratch(spark, "lines"), 2).collect())

    def common(x, y):
        (r, i), (q, j), n = x, y, 0
        while i + n < len(texts[r]) and j + n < len(texts[q]) and texts[r][i + n] == texts[q][j + n]:
            n += 1
        return n
    by_line = {}
    for r, t in enumerate(texts):
        for i, s in enumerate(t):
            by_line.setdefault(s, []).append((r, i))
    tied = [x for group in by_line.values() if len(group) > 1 for x in group]
    order = [g[1:3] for g in got]
    assert [g[0] for g in got] == list(range(len(tied))) and sorted(order) == sorted(tied)
    lcp = [g[3] for g in got] + [0]
    assert lcp[:-1] == [0] + [common(x, y) for x, y in zip(order, order[1:])]
    for k, x in enumerate(order):
        rest = by_line[texts[x[0]][x[1]]]
        assert max(lcp[k], lcp[k + 1]) == max(common(x, y) for y in rest if y != x)
    assert max(lcp) == 300
    for g in got:  # words beyond what repeats are of no use
        if g[3] >= 2:
            assert g[5] == sum(map(len, texts[g[1]][g[2]:g[2] + 2]))
