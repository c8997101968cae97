"""Quality classifier: held-out accuracy and edge cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from jobtables.llm.quality import NeighbourModel, classify, fit, keep_good, terms
from jobtables.llm.sampling import MAX_CHARS, labelled_sample

SF01 = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    rows = classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    good = [r.predicted for r in rows if r.quality == 1]
    bad = [r.predicted for r in rows if r.quality == 0]
    assert sum(good) / len(good) >= 0.98
    assert sum(bad) / len(bad) <= 0.2


def test_edge_rows(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    odd = spark.createDataFrame(
        [(None, None), (-1, ""), (-1, ""), (-2, " "), (-3, "a"), (-4, "word " * 40000)],
        "doc_id long, text string")
    both = docs.unionByName(odd).withColumns({c: F.lit(1) for c in ("score", "label", "order")})
    out = classify(both, labels, per_class=100)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == both.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [True]
    assert keep_good(both, labels, per_class=100).columns == both.columns


def test_empty_tables_and_no_labels(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert classify(docs, labels).count() == 0
    some = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    assert {r.score for r in classify(some, labels).collect()} == {0.5}
    odd = spark.createDataFrame([(1, None, 0), (2, 7, 0)], "doc_id long, quality int, toxic int")
    assert fit(some, odd).prior == 0.5
    assert not terms("").any() and not terms(None).any()


def test_votes_equal_a_plain_count():
    """Exact cosines, ties at the k-th place by sample order, weighted votes."""
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((60, 8)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[20:40] = vectors[:20]  # ties with other labels
    labels = (rng.random(60) < 0.4).astype(float)
    weights = np.where(labels == 1, 3.0, 1.5)
    model = NeighbourModel(np.ones(1), np.zeros((1, 8)), vectors, labels, weights, 0.25, 7, 4.0)
    x = np.concatenate([vectors[::3], rng.standard_normal((40, 8)).astype(np.float32),
                        np.zeros((2, 8), np.float32)])
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = (x / np.where(norm > 0, norm, 1)).astype(np.float32)
    sims = x @ vectors.T
    for row, got in zip(sims, model._vote(x)):
        near = sorted(range(60), key=lambda i: (-row[i], i))[:7]
        w = [max(float(row[i]), 0.0) ** 4 * weights[i] for i in near]
        want = sum(a * labels[i] for a, i in zip(w, near)) / sum(w) if sum(w) else 0.25
        assert abs(got - want) < 1e-6


def test_sample_is_bounded_in_rows_and_characters(spark):
    """One id in most rows of both tables, and a very long text."""
    docs = spark.range(20_000).selectExpr("if(id % 10 = 0, id, 7) AS doc_id", "concat('text ', id) AS text") \
        .unionByName(spark.createDataFrame([(11, "w " * 100_000)], "doc_id long, text string"))
    labels = spark.range(20_000).selectExpr("if(id % 10 = 0, id, 7) AS doc_id", "int(id % 2) AS quality") \
        .unionByName(spark.createDataFrame([(11, 1)], "doc_id long, quality int"))
    sample, totals = labelled_sample(docs, labels, "quality", 50, F.lit(True))
    rows = sample.collect()
    assert len(rows) <= 100 and sum(totals.values()) == 20_001
    assert max(len(r.text) for r in rows) <= MAX_CHARS
    again = labelled_sample(docs.repartition(3), labels.repartition(5), "quality", 50, F.lit(True))[0]
    assert sorted(rows) == sorted(again.collect())
