"""Spelling variants against plain counting and all one-edit strings."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobtables.llm.shared import Scratch
from jobtables.llm.spelling import (BidirectionalIndex, Ranks, near_report, near_words,
                                    sorted_rotations, spelling_variants)


def lower(run):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in run)


def plain_counts(docs):
    n = {}
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] = n.get(w, 0) + 1
    return {w: k for w, k in n.items() if k >= 2 and len(w) >= 7}


def edits(w, letters):
    out = {w[:i] + w[i + 1:] for i in range(len(w))}
    for i in range(len(w) + 1):
        for c in letters:
            out.add(w[:i] + c + w[i:])
            out.add(w[:i] + c + w[i + 1:])
    return out - {w}


def plain(n):
    letters = sorted({c for w in n for c in w})
    near = {w: sorted(edits(w, letters) & n.keys()) for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n"))
                  for r in df.collect())


def vocabulary(seed, n=600, letters="abé"):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(7, 11))) for _ in range(n // 6)]
    words = set(base)
    for _ in range(20 * n):
        if len(words) >= n:
            break
        words.add(rnd.choice(sorted(edits(rnd.choice(base), letters))))
    return {w: rnd.choice([2, 3, 25, 400]) for w in words if len(w) >= 7}


def test_index_ranks_and_rotations():
    rnd = np.random.default_rng(1)
    for n, k in ((1, 2), (255, 3), (256, 4), (257, 5), (700, 2)):
        text = rnd.integers(0, k, n)
        ranks = Ranks(text, k)
        for i in {0, 1, n // 2, n - 1, n}:
            for c in range(k + 1):
                assert ranks.less(np.array([i]), np.array([c]))[0] == (text[:i] < c).sum()
        text[0] = k  # a rotation is met once
        t = text.tolist()
        assert sorted_rotations(text).tolist() == sorted(range(n), key=lambda i: t[i:] + t[:i])


@pytest.mark.parametrize("letters", ["ab", "aé", "abcdefgh"])
def test_schemes_find_every_pair_once(letters):
    words = sorted(vocabulary(7, 300, letters))
    index = BidirectionalIndex(words)
    for m in sorted({len(w) for w in words}):
        group = [w for w in words if len(w) == m]
        for cuts in ([0, m // 2, m], [0, 1, 3, m - 2, m - 1, m], [0, m]):
            pairs = []
            for a, b in zip(cuts, cuts[1:]):
                q, x = index.near(group, a, b)
                pairs += [(group[i], words[j]) for i, j in zip(q, x)]
            want = [(w, v) for w in group for v in words
                    if len(v) in (m, m + 1) and v in edits(w, letters)]
            assert sorted(pairs) == sorted(want)
    assert near_words([("abcdefg", 2, 7, 3, 7)]) == []


@pytest.mark.parametrize("max_block", [4_000, 5])
def test_blocks_lose_and_repeat_nothing(spark, max_block):
    n = vocabulary(3)
    n |= {"same" * 6 + c + d: 5 for c in "abcdefghij" for d in ("", "x", "yz")}  # one hot half
    df = spark.createDataFrame(sorted(n.items()), "word string, n long")
    want = {r[0]: r[4] for r in plain(n) if r[4]}
    rows = near_report(df, Scratch(spark, "t"), max_block=max_block).collect()
    assert {r["word"]: r["n_near"] for r in rows} == want and len(rows) == len(want)


def texts(seed):
    rnd = random.Random(seed)
    n = vocabulary(seed, 80, "abcdé")
    run = [w for w, k in n.items() for _ in range(k)]
    rnd.shuffle(run)
    docs = []
    while run:
        k = rnd.randint(1, 60)
        docs.append((len(docs), rnd.choice([" ", ", ", "1", "\n", "_"]).join(
            w.upper() if rnd.random() < 0.1 else w for w in run[:k])))
        run = run[k:]
    return docs


def test_equals_plain_on_texts(spark):
    docs = texts(5) + [(None, "Straßen Straßen ÉCOLEÉCOLE écoleécole ×÷×÷×÷× ×÷×÷×÷×"), (None, None),
                       (1, ""), (1, "aaaaaaa " * 30), (1, "aaaaaaa aaaaaaa"), (2, "aaaaaaaa aaaaaaaa"),
                       (3, "z" * 30_000 + " " + "z" * 30_000), (3, "z" * 30_001), (4, "z" * 30_001),
                       (6, "KelvinKkelvin kelvinkelvin kelvinkelvin ŸŸŸ Ÿéééééééé"),
                       (7, "chained " * 2), (8, "chaineds " * 30), (9, "chainedsx " * 400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns(
        {c: F.lit("x") for c in ("word", "n", "id", "key", "m", "a", "b", "form", "root", "run")})
    n = plain_counts(docs)
    long = {w for w in n if len(w) > 1_000}
    want = [r for r in plain({w: k for w, k in n.items() if w not in long})]
    result = got(spelling_variants(df))
    assert [r for r in result if r[0] not in long] == want
    assert any(r[2] != r[0] and r[2] != r[1] for r in want)  # a chain of two forms
    assert {len(r[0]): r[4] for r in result if r[0] in long} == {30_000: 1, 30_001: 1}
    assert got(spelling_variants(df.limit(0))) == []
