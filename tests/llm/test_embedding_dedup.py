"""Embedding near-duplicates against all products in double precision."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import jobtables.llm.embedding_dedup as op
from jobtables.llm.embedding_dedup import near_duplicate_vectors

SF01 = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    ok, unit = [], []
    for _, e, label in rows:
        x = None if e is None or any(v is None for v in e) else np.array(e, np.float32).astype(float)
        good = label is not None and x is not None and len(x) and np.isfinite(x).all() and x.any()
        ok.append(good)
        unit.append(x / np.linalg.norm(x) if good else None)
    n = len(rows)
    links = [[j for j in range(n) if j != i and ok[i] and ok[j] and rows[i][2] == rows[j][2]
              and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    comp = [None] * n
    for i in range(n):
        if comp[i] is None:
            seen, todo = {i}, [i]
            while todo:
                for j in links[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            ids = [rows[j][0] for j in seen if rows[j][0] is not None]
            for j in seen:
                comp[j] = (min(ids, default=None),)
    return sorted(((rows[i][0], len(links[i]), comp[i][0], rows[i][0] == comp[i][0])
                   for i in range(n)), key=str)


def got(df, **kw):
    return sorted((tuple(r) for r in near_duplicate_vectors(df, **kw).collect()), key=str)


def test_equals_all_products(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 64)
    df = spark.read.parquet(f"{SF01}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert got(df) == brute(rows)
    assert got(df, threshold=0.5) == brute(rows, 0.5)


def test_equals_sql():
    """The SQL twin and the plain products agree (and so does the operator)."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF01}/embeddings.parquet')")
    rows = con.execute("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    assert sorted(con.execute(op.ORACLE_SQL).fetchall(), key=str) == brute(rows)


def test_groups_of_copies_and_edges(spark, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 16)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((6, 8))
    rows = []
    for k in range(150):
        v = base[k % 6] + rng.standard_normal(8) * 0.06
        rows.append((k, v.astype(np.float32).tolist(), k % 2))
    same = rows[3][1]
    rows += [(200 + k, same, 1) for k in range(40)] + [(200, same, 1), (None, same, 1)]
    rows += [(300, None, 1), (301, same, None), (302, [0.0] * 8, 1), (303, [None] + same[1:], 1),
             (304, [float("nan")] + same[1:], 1), (305, [float("inf")] + same[1:], 1), (306, [], 1),
             (307, same[:4], 1), (308, same[:4], 1), (None, None, None),
             (309, [x * 1e30 for x in same], 1), (310, [-x for x in same], 1)]
    df = spark.createDataFrame(rows, SCHEMA) \
        .withColumns({c: F.lit(1) for c in ("did", "n_links", "kept", "vector", "dim")})
    assert got(df) == brute(rows)


def test_empty_table(spark):
    assert near_duplicate_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    only = spark.createDataFrame([(1, None, 1)], SCHEMA)
    assert [tuple(r) for r in near_duplicate_vectors(only).collect()] == [(1, 0, 1, True)]


@pytest.mark.parametrize("threshold", [0.3, 0.9, 0.999, 1.0])
def test_bounds_drop_no_pair(threshold):
    rng = np.random.default_rng(2)
    x = op._unit(rng.standard_normal((80, 20)) * np.linspace(3, 0.1, 20))
    y = op._unit(np.concatenate([x[:30] + rng.standard_normal((30, 20)) * 0.05, x[30:40] * 2.0]))
    axes = op._rotation(x)
    i, j = op.linked_pairs(x, y, axes, threshold)
    want = np.argwhere(np.einsum("ik,jk->ij", x, y) >= threshold)
    close = {tuple(p) for p in np.argwhere(np.abs(x @ y.T - threshold) < 1e-12).tolist()}
    assert set(zip(i.tolist(), j.tolist())) ^ set(map(tuple, want.tolist())) <= close


def test_labels_of_any_type(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [1.0, 0.001], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, 0.0], None)]
    text = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert sorted((r.vec_id, r.n_links) for r in near_duplicate_vectors(text).collect()) == \
        [(1, 1), (2, 1), (3, 0), (4, 0)]
    wide = spark.createDataFrame([(i, v, None if k is None else 2**40 + ord(k)) for i, v, k in rows],
                                 "vec_id long, embedding array<double>, label long")
    assert sorted((r.vec_id, r.n_links) for r in near_duplicate_vectors(wide).collect()) == \
        [(1, 1), (2, 1), (3, 0), (4, 0)]
