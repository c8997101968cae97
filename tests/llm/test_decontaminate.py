"""Greedy string tiling against a plain version that tries all positions."""

import random

import numpy as np
from pyspark.sql import functions as F

from jobtables.llm.decontaminate import (contaminated_pairs, decontaminate, tile, words)

SF01 = "/root/testdata/sf0.01"


def plain_tiles(a, b, k):
    """The definition: again and again mark all longest runs."""
    fa, fb, out = [True] * len(a), [True] * len(b), 0
    while True:
        best, found = k - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while (i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]
                       and fa[i + n] and fb[j + n]):
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best and n >= k:
                    found.append((i, j))
        if best < k:
            return out
        for i, j in found:
            if all(fa[i:i + best]) and all(fb[j:j + best]):
                fa[i:i + best] = fb[j:j + best] = [False] * best
                out += best


def test_tiles_equal_the_definition():
    random.seed(3)
    for _ in range(300):
        a = [random.randint(1, 4) for _ in range(random.randint(0, 22))]
        b = [random.randint(1, 4) for _ in range(random.randint(0, 30))]
        if random.random() < 0.5 and len(a) > 8:
            b = b[:5] + a[6:] + [9] + a[:6] + b[5:]
        got = tile(np.array(a, np.int64), np.array(b, np.int64), 3)
        used_a = [i + x for i, _, n in got for x in range(n)]
        used_b = [j + x for _, j, n in got for x in range(n)]
        assert len(set(used_a)) == len(used_a) and len(set(used_b)) == len(used_b)
        assert all(a[i:i + n] == b[j:j + n] and n >= 3 for i, j, n in got)
        lengths = sorted((n for _, _, n in got), reverse=True)
        plain = plain_tiles(a, b, 3)
        # ties between equally long runs may be broken either way
        assert (lengths[:1] or [0])[0] == max([0, *_longest(a, b)]) and \
            abs(sum(lengths) - plain) <= 0.35 * max(plain, 6)


def _longest(a, b):
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= 3:
                yield n


ITEM = ("Which of the seven rivers that cross the old valley was the first one to be dammed, "
        "and in what year did its reservoir reach the upper town for the first time?")


def doc_rows():
    w = ITEM.split()
    filler = " ".join(f"filler{i}" for i in range(300))
    return [(1, f"{filler} {ITEM} {filler}", True),
            (2, f"{filler} {' '.join(w[16:])} x y {' '.join(w[:16])} {filler}", True),  # reordered
            (3, " ".join(w[:18]) + " " + filler, False),  # about half
            (4, ITEM.upper().replace("RIVERS", "«RIVERS»"), True),
            (5, None, False), (6, "", False), (7, filler * 200, False),
            (8, " ".join(f"{x} no" for x in w), False),
            (9, " ".join(w[:4] + ["zzz"] + w[5:]), True), (9, " ".join(w[:4] + ["zzz"] + w[5:]), True)]


def test_planted_passages(spark):
    rows = doc_rows()
    docs = spark.createDataFrame([(None, ITEM)] + [r[:2] for r in rows], "doc_id long, text string") \
        .withColumns({c: F.lit(1) for c in ("item_id", "coverage")})
    bench = spark.createDataFrame([(10, ITEM), (11, None), (12, ""), (13, "too short"),
                                   (14, ITEM), (None, ITEM)], "item_id long, text string")
    got = contaminated_pairs(docs, bench).collect()
    want = {None} | {d for d, _, bad in rows if bad}
    assert {r.doc_id for r in got} == want
    assert {r.item_id for r in got} == {10, 14, None}
    assert sum(r.doc_id == 9 for r in got) == 6
    assert all(r.n_words == len(words(ITEM)) and 0.8 <= r.coverage <= 1 for r in got)
    small = contaminated_pairs(docs, bench, block_bytes=100).collect()
    assert sorted(map(str, small)) == sorted(map(str, got))
    kept = decontaminate(docs, bench, block_bytes=100)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [d for d, _, bad in rows if not bad]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    assert contaminated_pairs(docs, bench).count() == 0
    assert contaminated_pairs(some, bench).count() == 0
    assert decontaminate(some, bench).count() == 1


def test_finds_whole_items_in_the_documents(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    bench = spark.read.parquet(f"{SF01}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in contaminated_pairs(docs, bench).collect()}
    items = [(r.item_id, " ".join(words(r.text))) for r in bench.collect()]
    whole = {(r.doc_id, i) for r in docs.collect() for i, t in items
             if t in " ".join(words(r.text))}
    assert whole and whole <= got


def test_short_items_match_whole(spark):
    docs = spark.createDataFrame(
        [(1, "alpha beta gamma delta"), (2, "x Alpha, beta gamma delta! y"), (3, "alpha beta gamma"),
         (4, "alpha beta x gamma delta"), (5, "delta gamma beta alpha"), (6, "yes"), (7, "yesterday")],
        "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "Yes.")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.coverage, r.n_words) for r in contaminated_pairs(docs, bench).collect())
    assert got == [(1, 1, 1.0, 4), (2, 1, 1.0, 4), (6, 2, 1.0, 1)]
    assert sorted(r.doc_id for r in decontaminate(docs, bench).collect()) == [3, 4, 5, 7]


def test_repeated_words_are_scanned_in_bounded_time():
    import time
    a, b = np.ones(1_000, np.int64), np.ones(20_000, np.int64)
    t = time.time()
    assert tile(a, b, 5) == [(0, 0, 1_000)]
    broken = np.tile(np.array([1] * 300 + [2], np.int64), 60)
    tiles = tile(a, broken, 5)
    assert time.time() - t < 5 and sum(n for _, _, n in tiles) == 1_000
