"""Toxicity classifier: plain convolution, held-out accuracy, edge cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

import jobtables.llm.toxicity as op
from jobtables.llm.toxicity import LANGUAGES, best_threshold, classify, tokenise

SF01, SF1 = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
ODD = [(None, None), (-1, ""), (-1, ""), (-2, " \n"), (-3, "a"), (-4, "word " * 450000)]


def test_pooling_equals_plain_convolution(monkeypatch):
    monkeypatch.setattr(op, "CHUNK_WORDS", 7)
    model = op._new_model(np.random.default_rng(0))
    texts = ["one two three two", "", None, "x", "a b c d e f g h i j k l m n o p q r s t " * 3]
    t = tokenise(texts)
    got = model.pooled(t)
    vectors = model.embedding[t.rows].sum(axis=1)
    for d, ids in enumerate(t.ids):
        x = np.concatenate([vectors[ids], np.zeros((3, op.DIM))])
        first = 0
        for k, width in enumerate(op.WIDTHS):
            want = [sum(x[p + o] @ model.filters[:, first + o] for o in range(width))
                    for p in range(max(1, len(ids)))]
            assert np.allclose(got[d, k], np.max(want, axis=0), atol=1e-5)
            first += width


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF1}/documents.parquet")
    labels = spark.read.parquet(f"{SF1}/labels.parquet")
    rows = classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    toxic = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(toxic) / len(toxic) >= 0.9
    assert sum(clean) / len(clean) <= 0.02


def test_edge_rows(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text") \
        .unionByName(spark.createDataFrame(ODD, "doc_id long, text string")) \
        .withColumns({c: F.lit(1) for c in ("score", "order", "label")})
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    out = classify(docs, labels, per_class=60, epochs=1)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    blank = {r.score for r in rows if r.doc_id in (None, -1, -2)}
    assert len(blank) == 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, "text"), (2, None)], "doc_id long, text string")
    assert classify(docs, labels).count() == 0
    assert {r.score for r in classify(some, labels).collect()} == {0.0}


def test_languages_and_thresholds():
    t = tokenise(["the cat of the house", "der Hund und die Katze", "le chat et les chiens",
                  "el gato y los perros", "zzz", ""])
    assert [LANGUAGES[k] for k in t.guess()] == ["en", "de", "fr", "es", "other", "other"]
    cut = best_threshold(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1.0, 1.0, 0.0, 0.0]))
    assert 0.2 < cut < 0.8
    words = [w for ws in op.FUNCTION_WORDS.values() for w in ws.split()]
    assert len(words) == len(set(words))


def test_all_labelled_rows_are_learned_from(spark):
    # more rows of each class than a sample of 2,500 holds; the word that marks the
    # toxic rows with the largest hashes is in no other row
    n = 6000
    order = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    learn = op.remainder(F.col("doc_id"), 4) != 2
    ids = spark.range(2 * n).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    cut = ids.where(learn & (F.col("toxic") == 1)).select(order.alias("h")).orderBy("h") \
        .limit(2500).agg(F.max("h")).first()[0]
    fine = F.concat(F.lit("fine"), F.pmod(F.xxhash64("doc_id"), F.lit(500)))  # a rare word is no sign
    word = F.when(F.col("toxic") == 0, fine).when(order <= cut, "grumph").otherwise("zorgblat")
    docs = ids.select("doc_id", F.concat_ws(" ", F.lit("some words"), word, F.concat(
        F.lit("w"), F.col("doc_id") % 50)).alias("text"))
    rows = classify(docs, ids).join(ids, "doc_id").join(docs, "doc_id").where("held_out").collect()
    late = [r.predicted for r in rows if "zorgblat" in r.text]
    assert len(late) > 100 and sum(late) / len(late) > 0.9
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(clean) / len(clean) < 0.1


def test_learnable_texts(spark):
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2]
    learn = [i for i in range(40) if i not in held]
    long = "long " * 40_000
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3, 40)] + [(learn[0], long)] * 30
                                 + [(learn[1], None), (None, "x"), (99, "no label")],
                                 "doc_id long, text string").where(~F.col("doc_id").isin(3))
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(40)] * 2 + [(learn[4], 1 - learn[4] % 2), (learn[5], 2), (None, 1)],
        "doc_id long, toxic int")
    rows, n = op.learnable_texts(docs, labels, "toxic", op.remainder(F.col("doc_id"), 4) != 2)
    assert n == len(learn) + 1
    have = {r.doc_id: r.text for r in docs.where("doc_id is not null").collect()}
    want = [(have[i], i % 2) for i in learn if i in have] + [(have[learn[4]], 1 - learn[4] % 2)]
    got = [(r.text, r.label) for r in rows.collect()]
    key = lambda v: (v[0] or "", v[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert (long, learn[0] % 2) in got


def test_thresholds_equal_plain_ones(spark):
    rng = np.random.default_rng(1)
    p = np.round(rng.beta(0.5, 2, 3000), 3)
    y = (rng.random(3000) < p).astype(int)
    language = rng.integers(0, 3, 3000)
    rows = spark.createDataFrame([(int(k), float(v), int(t)) for k, v, t in zip(language, p, y)],
                                 "language int, p double, label int")
    for bins in (1, 7, op.SCORE_BINS):
        got = op.best_thresholds(rows, bins)
        assert set(got) == {-1, 0, 1, 2}
        for k, (cut, positives, n) in got.items():
            own = (language == k) | (k < 0)
            assert (positives, n) == (y[own].sum(), own.sum())
            assert np.isclose(cut, best_threshold(p[own], y[own].astype(float)))


def test_maxima_lie_where_they_are_said_to(monkeypatch):
    monkeypatch.setattr(op, "CHUNK_WORDS", 7)
    model = op._new_model(np.random.default_rng(0))
    t = tokenise(["one two three two", "", "x", "a b c d e f g h i j k l m n o p q r s t " * 3])
    again = op._decoded(*zip(*op._encoded(t)))
    best, where = model.pooled(t, arg=True)
    assert np.allclose(model.pooled(again), best)
    for d, ids in enumerate(t.ids):
        x = np.concatenate([model.vectors(t.rows)[ids], np.zeros((3, op.DIM))])
        first = 0
        for k, width in enumerate(op.WIDTHS):
            for f in range(op.FILTERS):
                at = where[d, k, f]
                y = sum(x[at + o] @ model.filters[:, first + o, f] for o in range(width))
                assert 0 <= at < max(1, len(ids)) and np.isclose(y, best[d, k, f], atol=1e-5)
            first += width


def test_shards_are_averaged_and_reruns_agree(spark):
    ids = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    docs = ids.select("doc_id", F.concat_ws(" ", F.when(F.col("toxic") == 1, "bad").otherwise("good"),
                                            F.concat(F.lit("w"), F.col("doc_id") % 9)).alias("text"))
    # enough partitions of the join to make shards of
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        one, two = (op.fit(docs, ids, shard_texts=100) for _ in range(2))
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    assert np.array_equal(one.embedding, two.embedding) and one.out_bias == two.out_bias
    assert np.array_equal(one.thresholds, two.thresholds)
    p = one.scores(["bad w3", "good w3"])
    assert p[0] >= 0.3 > p[1]
