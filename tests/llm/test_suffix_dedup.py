"""Suffix-array dedup against plain sorting and plain substring counts."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobtables.llm.suffix_dedup import anchors, remove_repeats, repeat_report, suffix_array

SF001 = "/root/testdata/sf0.001"


def brute(rows, length):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(x[i:i + length] for _, x in data for i in range(len(x) - length + 1))
    out = []
    for d, x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(x, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(x), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_array_equals_sorting():
    random.seed(1)
    texts = [[], [0], [1, 1, 1, 1], list(b"mississippi"), list(b"abababababcababab"), [2, 1, 0],
             [0, 1, 2], [1, 0] * 20, [0, 1, 0, 0, 1, 0, 1, 0] * 5]
    texts += [[random.randint(0, random.choice([1, 2, 5, 50])) for _ in range(random.randint(1, 60))]
              for _ in range(3000)]
    for t in texts:
        assert suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:]), t


def test_every_start_has_the_same_anchor_wherever_it_occurs():
    random.seed(2)
    shared = bytes(random.choices(b"abc ", k=300))
    for _ in range(20):
        data = bytes(random.choices(b"abc ", k=random.randint(0, 400))) + shared \
            + bytes(random.choices(b"abc ", k=random.randint(0, 400)))
        offset = data.index(shared)
        a, first, last, h, piece = anchors(data, 60, 16)
        assert first[0] == 0 and last[-1] == len(data) - 60
        assert (first[1:] == last[:-1] + 1).all()
        assert ((a >= last) & (a <= first + 60 - 16)).all()
        own = {}
        for x, f, t, y in zip(a.tolist(), first.tolist(), last.tolist(), h.tolist()):
            for s in range(f, t + 1):
                own[s] = (x - s, y)
        got = [own[offset + s] for s in range(300 - 60 + 1)]
        alone = {}
        for x, f, t, y in zip(*(v.tolist() for v in anchors(shared, 60, 16)[:4])):
            for s in range(f, t + 1):
                alone[s] = (x - s, y)
        assert got == [alone[s] for s in range(300 - 60 + 1)]


@pytest.mark.parametrize("length,k", [(40, 16), (64, 32)])
def test_equals_plain_counts(spark, length, k):
    random.seed(length)
    word = lambda: "".join(random.choices("abcdeé", k=random.randint(2, 7)))
    base = [" ".join(word() for _ in range(60)) for _ in range(4)]
    rows = []
    for i in range(40):
        w = random.choice(base).split(" ")
        for _ in range(random.randint(0, 4)):
            w[random.randrange(len(w))] = word()
        lo = random.randint(0, 20)
        rows.append((i, " ".join(w[lo:lo + random.randint(5, 60)])))
    rows += [(50, None), (51, ""), (52, "x" * (length - 1)), (53, "y" * length), (54, "z" * 500),
             (55, rows[0][1]), (56, "ab" * 300), (57, base[0] + base[0]), (None, base[1]),
             (None, "alone " + word() * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string") \
        .withColumns({c: F.lit(1) for c in ("data", "record", "k1", "spans", "h")})
    assert sorted(map(tuple, repeat_report(df, length, k).collect()), key=str) == brute(rows, length)
    clean = remove_repeats(df, length, k)
    assert clean.columns == df.columns and clean.count() == len(rows)


def test_documents_equal_plain_counts(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(1000 + d, t[:len(t) // 2] + "%" + t[len(t) // 2 + 1:]) for d, t in rows[:40]]
    rows += rows[50:55]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 200)
    assert sorted(map(tuple, repeat_report(df).collect()), key=str) == want
    assert sum(r[2] for r in want) > 10_000


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeat_report(df).count() == 0 and remove_repeats(df).count() == 0


def test_pieces_of_one_anchor_are_split(spark, tmp_path):
    """A phrase around one anchor in ever other surroundings: no task sorts
    more than ``group`` of them, and nothing is lost."""
    random.seed(9)
    other = lambda n: "".join(random.choices("abcdefgh", k=n))
    phrase, head, tail = other(30), other(40), other(40)
    texts = [other(50) + phrase + other(50) for _ in range(60)]
    texts += [other(20) + head[-n:] + phrase + tail[:40 - n] + other(20) for n in range(41)]
    texts += [other(30) + head + phrase + other(30) for _ in range(30)]
    texts += [other(30) + phrase + tail + other(30) for _ in range(30)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, 64)
    assert sum(r[2] for r in want) > 0
    for group in (4, 15, 1000):
        assert sorted(map(tuple, repeat_report(df, 64, 16, group=group).collect()), key=str) == want


def test_large_groups_are_bounded(spark):
    from jobtables.llm.shared import Scratch
    from jobtables.llm.suffix_dedup import _dealt
    random.seed(10)
    other = lambda n: bytes(random.choices(b"abcdefgh", k=n))
    anchor, same = other(16), other(60)
    pieces = [(1, i, 50, 40, other(50) + anchor + other(60)) for i in range(200)]
    pieces += [(1, 1000 + i, 30, 20, same[:30] + anchor + same[30:] + other(10 + i % 3)) for i in range(50)]
    texts = spark.createDataFrame(
        [(h, p, a, n, bytearray(x)) for h, p, a, n, x in pieces],
        "h long, piece long, at long, starts long, data binary")
    dealt, many = _dealt(texts, Scratch(spark, "test"), 64, 16, 10)
    assert dealt.groupBy("g").count().agg(F.max("count")).first()[0] <= 10
    seen = {r.piece for r in dealt.select("piece").unionByName(many.select("piece")).collect()}
    assert seen == {p[1] for p in pieces}
    assert {r.piece for r in many.select("piece").collect()} <= {p[1] for p in pieces[200:]}
