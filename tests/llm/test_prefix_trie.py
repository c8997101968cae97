"""Conversation prefix trie against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from jobtables.llm.prefix_trie import (LOWEST, NODE_COLUMNS, Skeleton, choose_splitters, common_turns,
                                       trie_nodes)

SCHEMA = "conv_id long, turn long, role string, text string"


def md5(role, text):
    return hashlib.md5(role.encode() + b"\xff" + text.encode()).hexdigest()


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, role, md5(role, text), text))
    own = {c: [(r, x) for _, _, r, _, x in sorted(t)] for c, t in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        whole = own.get(base, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            nodes.setdefault(tuple(whole[:d]), []).append((c, d == len(whole)))
    own_saved = {p: (len(m) - 1) * len(p[-1][1].encode()) if p else 0 for p, m in nodes.items()}
    saved, leaves, kids = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p in nodes:
        for d in range(len(p) + 1):
            saved[p[:d]] += own_saved[p]
            leaves[p[:d]] += kids[p] == 0
    return sorted((min(c for c, _ in m), len(p), min(c for c, _ in nodes[p[:-1]]) if p else None,
                   len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in sorted(c for c, e in m if e)).encode())
                   .hexdigest()) for p, m in nodes.items())


def got(df):
    return sorted(tuple(r[c] for c in NODE_COLUMNS) for r in df.collect())


def key(rows):
    return sorted(rows, key=str)


def talks(seed, n=300, words=3):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(2 * n), n):
        for t in range(rnd.randint(1, 9)):
            rows.append((c, t, rnd.choice(["user", "assistant"]), f"é{rnd.randint(1, words)}"))
    # a third of all conversations are equal, another group shares a long start
    for c in range(5_000, 5_000 + n, 5):
        rows += [(c, t, "user", f"same {t}") for t in range(4)]
    for c in range(9_000, 9_000 + n, 5):
        rows += [(c, t, "user", f"long {t}") for t in range(40)] + [(c, 40, "user", f"{c % 7}")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns,max_skeleton", [(10, 100_000), (200_000, 100_000), (10, 30), (50, 1)])
def test_equals_plain_prefixes(spark, shard_turns, max_skeleton):
    rows = talks(shard_turns)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert key(got(trie_nodes(df, shard_turns, max_skeleton))) == key(plain(rows))


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [(None, 0, "user", "x"), (1, None, None, None), (1, 1, "user", "b"), (1, 1, "user", "a"),
            (1, 1, "user", "a"), (0, 0, "", ""), (0, 0, None, None), (-3, 0, "user", "neg"),
            (-5, 3, "user", None), (3, 0, "ab", "c"), (4, 0, "a", "bc"), (10, 0, "user", "z" * 100_000),
            (10, 1, None, "é" * 5)] + [(20, t, "user", str(t % 3)) for t in range(500)] \
        + [(21, t, "user", str(t % 3)) for t in range(501)] + [(22, 0, "user", "short")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns(
        {c: F.lit("x") for c in ("base", "path", "sizes", "t", "node", "kind", "depth", "tokens")})
    assert key(got(trie_nodes(df, 7))) == key(plain(rows))
    empty = trie_nodes(df.limit(0))
    assert empty.columns == NODE_COLUMNS and empty.collect() == []


def test_splitters_are_short_and_bounded():
    def path(*turns):
        return b"".join(bytes([t]) * 16 for t in turns)
    sample = [(path(1, 2, 3, 4), 5), (path(1, 2, 9, 9), 6)] + [(path(7, 7, 7), i) for i in range(40)]
    s = choose_splitters(sample, 8)
    assert all(a < b for a, b in zip(s.keys, s.keys[1:]))
    assert {k[0] for k in s.keys} <= {path(1, 2, 9), path(7), path(7, 7, 7)}
    assert sum(k[1] != LOWEST for k in s.keys) >= 5  # equal paths are split by id
    shards = [s.shard(p, i) for p, i in sorted(sample)]
    assert shards == sorted(shards) and max(shards.count(x) for x in set(shards)) <= 12
    assert len(choose_splitters([(path(*[i] * 50), i) for i in range(200)], 100, 60)) <= 60
    assert len(Skeleton([])) == 1 and common_turns(path(1, 2), path(1, 2, 3)) == 2
