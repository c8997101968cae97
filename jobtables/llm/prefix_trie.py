"""Conversation prefix trie over sorted shards and a skeleton of splitter paths.

A rebuilt conversation is a path: sixteen bytes (MD5 of role and text) a turn.
Rows are range-partitioned by ``(path, conv_id)`` at splitters taken from a
bounded sample.  The trie of the splitters' paths, the skeleton, is broadcast.
A node that is no prefix of a splitter has all of its members in one shard,
which finishes it in one pass over its sorted rows; every prefix of a splitter
is a skeleton node, for which each shard gives a partial aggregate.  The
partials are summed by Spark and folded up the skeleton, whose size is bounded
(``max_skeleton`` nodes).

A shard boundary may fall between equal paths, so any number of conversations
may share any prefix or be equal: their nodes are skeleton nodes then.  The
ids that end at such a node go through one task in pieces of some kilobytes,
in order, since SHA-256 is sequential; its memory does not grow.

Defined cases: rows without a conv_id belong to no conversation and are left
out; turns are ordered null first, equal turns by role and then by the MD5 of
role and text; repeated rows are turns of their own; null roles and texts are
empty ones; a conversation left without turns is a member of the root only; an
empty table has no nodes.  Turn hashes of one conversation (24 bytes a turn)
are held by one task.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtables.llm.shared import Scratch, shuffle_partitions

TOKEN = 16  # bytes of a turn in a path
MODULUS, STEP = 9, 5
SHARD_TURNS = 200_000
MAX_SKELETON = 100_000
SAMPLE_BYTES = 32_000_000
SAMPLE_PER_SHARD = 60
CHUNK = 8_000  # bytes of ids in a row
LOWEST = -(1 << 63)
_EMPTY = hashlib.sha256(b"").hexdigest()
NODE_COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                "saved_tokens", "ends_sha256"]


def shared_turns(conv_id: Column) -> Column:
    """How many leading turns a conversation takes from its base."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % MODULUS).cast("int")


def rebuilt_paths(conversations: DataFrame) -> DataFrame:
    """``(conv_id, path, sizes)``: the turns of every rebuilt conversation as
    hashes, and the UTF-8 bytes of their texts."""
    conv = F.col("conv_id").cast("long")
    role = F.coalesce(F.col("role"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    token = F.md5(F.concat(role.cast("binary"), F.lit(b"\xff"), text.cast("binary")))
    turns = conversations.select(
        (conv - conv % STEP).alias("base"), conv.alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), token.alias("token"),
                 F.octet_length(text).alias("size")).alias("t")).where("conv_id IS NOT NULL")
    # one exchange by base serves the grouping and the join
    own = turns.repartition(shuffle_partitions(conversations.sparkSession), "base") \
        .groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")) \
        .select("base", "conv_id", F.col("turns.token").alias("tokens"),
                F.col("turns.size").alias("sizes"))
    heads = own.where("conv_id = base").select(
        "base", F.slice("tokens", 1, MODULUS - 1).alias("head"),
        F.slice("sizes", 1, MODULUS - 1).alias("head_sizes"))
    h = shared_turns(F.col("conv_id"))

    def spliced(head: str, rest: str, kind: str) -> Column:
        first = F.slice(F.coalesce(head, F.array().cast(f"array<{kind}>")), F.lit(1), h)
        return F.concat(first, F.slice(rest, h + 1, F.greatest(F.size(rest) - h, F.lit(0))))
    return own.join(heads, "base", "left").select(
        "conv_id", F.unhex(F.array_join(spliced("head", "tokens", "string"), "")).alias("path"),
        spliced("head_sizes", "sizes", "int").alias("sizes"))


class Skeleton:
    """Splitters and the trie of their paths.

    ``keys`` are the lower bounds ``(path, conv_id)`` of all shards but the
    first; ``child[(node, token)]`` numbers the trie's nodes, parents first;
    node 0 is the root.
    """

    def __init__(self, keys: list[tuple[bytes, int]]):
        self.keys = keys
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth = [-1], [0]
        for path, _ in keys:
            node = 0
            for i in range(0, len(path), TOKEN):
                step = (node, path[i:i + TOKEN])
                node = self.child.get(step, -1)
                if node < 0:
                    node = self.child[step] = len(self.parent)
                    self.parent.append(step[0])
                    self.depth.append(self.depth[step[0]] + 1)

    def __len__(self) -> int:
        return len(self.parent)

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect_right(self.keys, (path, conv_id))


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths share from the start."""
    lo, hi = 0, min(len(a), len(b)) // TOKEN
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo * TOKEN:mid * TOKEN] == b[lo * TOKEN:mid * TOKEN]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def choose_splitters(sample: list[tuple[bytes, int]], shards: int,
                     max_skeleton: int = MAX_SKELETON) -> Skeleton:
    """Splitters that deal the turns of a sample evenly to ``shards``.

    A splitter is cut to the shortest prefix above the sample row before it;
    between equal paths it keeps the path and the id.  Every second splitter
    goes, again and again, until the skeleton has ``max_skeleton`` nodes.
    """
    rows = sorted(sample)
    total = sum(len(p) // TOKEN + 1 for p, _ in rows)
    keys, before, wanted = [], 0, 1
    for j, (path, conv_id) in enumerate(rows):
        if wanted < shards and j and before * shards >= wanted * total:
            last = rows[j - 1][0]
            key = (path, conv_id) if last == path else (
                path[:TOKEN * (common_turns(last, path) + 1)], LOWEST)
            if not keys or keys[-1] < key:
                keys.append(key)
            while wanted < shards and before * shards >= wanted * total:
                wanted += 1
        before += len(path) // TOKEN + 1
    skeleton = Skeleton(keys)
    while len(skeleton) > max_skeleton:
        skeleton = Skeleton(skeleton.keys[1::2])
    return skeleton


def skeleton_of(paths: DataFrame, shard_turns: int, max_skeleton: int) -> Skeleton:
    """Sample size: ``SAMPLE_PER_SHARD`` rows a shard, at most ``SAMPLE_BYTES``
    of paths as expected; rows are chosen by a hash of the id."""
    r = paths.agg(F.count("*").alias("n"),
                  F.coalesce(F.sum(F.length("path")), F.lit(0)).alias("size")).first()
    if not r["n"]:
        return Skeleton([])
    shards = max(shuffle_partitions(paths.sparkSession),
                 -(-(r["size"] // TOKEN + r["n"]) // shard_turns))
    share = min(1.0, SAMPLE_PER_SHARD * shards / r["n"], SAMPLE_BYTES / (r["size"] + 8 * r["n"]))
    rows = paths.where(F.pmod(F.xxhash64(F.lit("splitters"), "conv_id"), F.lit(1 << 30))
                       < int(share * (1 << 30))).select("path", "conv_id").collect()
    return choose_splitters([(bytes(x["path"]), x["conv_id"]) for x in rows], shards, max_skeleton)


LOCAL, PARTIAL, ENDS = 0, 1, 2
_FOUND = pa.schema([
    ("kind", pa.int8()), ("node", pa.int64()), ("shard", pa.int64()), ("seq", pa.int64()),
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
    ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("size", pa.int64()), ("ends_sha256", pa.string()),
    ("ids", pa.binary())])
_FOUND_SQL = ("kind tinyint, node long, shard long, seq long, conv_id long, depth long, "
              "parent_conv_id long, n_convs long, n_children long, n_leaves long, "
              "saved_tokens long, size long, ends_sha256 string, ids binary")


class _Open:
    """A node on the path from the root to the row at hand."""

    __slots__ = ("skeleton", "size", "first", "least", "children", "leaves", "saved", "sha", "ids",
                 "ids_size", "seq", "closed")

    def __init__(self, skeleton: int, size: int, first: int):
        self.skeleton, self.size, self.first = skeleton, size, first
        self.least = None
        self.children = self.leaves = self.saved = self.ids_size = self.seq = 0
        self.sha = None
        self.ids, self.closed = [], []


class ShardWalk:
    """One pass over the sorted rows of a shard.

    ``out`` collects rows in the columns of ``_FOUND``.  A finished node waits
    in its parent until the parent's smallest member is known; children of a
    skeleton node name that node instead.
    """

    def __init__(self, skeleton: Skeleton, shard: int):
        self.child, self.shard, self.rows = skeleton.child, shard, 0
        self.stack = [_Open(0, 0, 0)]
        self.last = b""
        self.out: list[tuple] = []

    def add(self, path: bytes, conv_id: int, sizes: list[int]) -> None:
        stack, child = self.stack, self.child
        shared = common_turns(self.last, path)
        while len(stack) - 1 > shared:
            self._close()
        for d in range(len(stack), len(path) // TOKEN + 1):
            above = stack[-1].skeleton
            node = child.get((above, path[(d - 1) * TOKEN:d * TOKEN]), -1) if above >= 0 else -1
            stack.append(_Open(node, sizes[d - 1], self.rows))
        self.last = path
        self.rows += 1
        end = stack[-1]
        if end.least is None or conv_id < end.least:
            end.least = conv_id
        text = str(conv_id).encode()
        if end.skeleton >= 0:
            end.ids.append(text)
            end.ids_size += len(text) + 1
            if end.ids_size >= CHUNK:
                self._flush(end)
        elif end.sha is None:
            end.sha = hashlib.sha256(text)
        else:
            end.sha.update(b"," + text)

    def finish(self) -> None:
        while self.rows and self.stack:
            self._close()

    def _flush(self, node: _Open) -> None:
        if node.ids:
            self.out.append((ENDS, node.skeleton, self.shard, node.seq, None, None, None, None, None,
                             None, None, None, None, b",".join(node.ids)))
            node.seq += 1
            node.ids, node.ids_size = [], 0

    def _close(self) -> None:
        node = self.stack.pop()
        above = self.stack[-1] if self.stack else None
        n, depth = self.rows - node.first, len(self.stack)
        if above is not None and (above.least is None or node.least < above.least):
            above.least = node.least
        for row in node.closed:
            self.out.append(row[:6] + (node.least,) + row[7:])
        if node.skeleton >= 0:
            self._flush(node)
            self.out.append((PARTIAL, node.skeleton, self.shard, None, node.least, depth, None, n,
                             node.children, node.leaves, node.saved, node.size, None, None))
            return
        leaves = node.leaves if node.children else 1
        saved = node.saved + (n - 1) * node.size
        above.children += 1
        above.leaves += leaves
        above.saved += saved
        row = (LOCAL, above.skeleton if above.skeleton >= 0 else None, self.shard, None, node.least,
               depth, None, n, node.children, leaves, saved, None,
               node.sha.hexdigest() if node.sha else _EMPTY, None)
        (self.out if above.skeleton >= 0 else above.closed).append(row)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(col, f.type) for col, f in zip(zip(*rows), _FOUND)], schema=_FOUND)


def walk_shards(rows: DataFrame, skeleton: Skeleton, broadcast) -> DataFrame:
    """Deal ``rows(conv_id, path, sizes)`` to the shards and walk each."""
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = broadcast.value.shard
        for b in batches:
            paths, ids = b.column("path").to_pylist(), b.column("conv_id").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard(p, i) for p, i in zip(paths, ids)], pa.int32()), b.column("conv_id"),
                 b.column("path"), b.column("sizes")], names=["shard", "conv_id", "path", "sizes"])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for b in batches:
            for s, i, p, z in zip(*(b.column(c).to_pylist()
                                    for c in ("shard", "conv_id", "path", "sizes"))):
                if walk is None or walk.shard != s:
                    if walk is not None:
                        walk.finish()
                        yield _batch(walk.out)
                    walk = ShardWalk(broadcast.value, s)
                walk.add(p, i, z)
                if len(walk.out) >= 10_000:
                    yield _batch(walk.out)
                    walk.out = []
        if walk is not None:
            walk.finish()
            yield _batch(walk.out)

    return rows.select("conv_id", "path", "sizes") \
        .mapInArrow(dealt, "shard int, conv_id long, path binary, sizes array<int>") \
        .repartitionById(len(skeleton.keys) + 1, F.col("shard")) \
        .sortWithinPartitions("shard", "path", "conv_id").mapInArrow(walked, _FOUND_SQL)


def fold_skeleton(skeleton: Skeleton, partials: dict[int, dict]) -> list[tuple]:
    """Finished skeleton nodes ``(node, conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens)`` from their summed partials: children
    are folded into parents, which have smaller numbers."""
    kids, leaves, saved = ([0] * len(skeleton) for _ in range(3))
    out = []
    for node in range(len(skeleton) - 1, -1, -1):
        p = partials.get(node)
        if p is None:  # only the root of an empty table
            continue
        up = skeleton.parent[node]
        children = p["n_children"] + kids[node]
        n_leaves = p["n_leaves"] + leaves[node] if children else 1
        all_saved = p["saved_tokens"] + saved[node] + (p["n_convs"] - 1) * p["size"]
        if up >= 0:
            kids[up] += 1
            leaves[up] += n_leaves
            saved[up] += all_saved
        out.append((node, p["conv_id"], skeleton.depth[node],
                    partials[up]["conv_id"] if up >= 0 else None, p["n_convs"], children, n_leaves,
                    all_saved))
    return out


def _ends(chunks: DataFrame) -> DataFrame:
    """``(node, ends_sha256)`` of skeleton nodes: their pieces of ids, in order."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = sha = None

        def row():
            return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()),
                                               pa.array([sha.hexdigest()])],
                                              names=["node", "ends_sha256"])
        for b in batches:
            for n, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist()):
                if n != node:
                    if sha is not None:
                        yield row()
                    node, sha = n, hashlib.sha256(ids)
                else:
                    sha.update(b",")
                    sha.update(ids)
        if sha is not None:
            yield row()
    return chunks.select("node", "shard", "seq", "ids") \
        .repartition(shuffle_partitions(chunks.sparkSession), "node") \
        .sortWithinPartitions("node", "shard", "seq").mapInArrow(hashed, "node long, ends_sha256 string")


def trie_nodes(conversations: DataFrame, shard_turns: int = SHARD_TURNS,
               max_skeleton: int = MAX_SKELETON) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (``NODE_COLUMNS``)."""
    spark = conversations.sparkSession
    scratch = Scratch(spark, "trie")
    paths = scratch.table(rebuilt_paths(conversations), "paths")
    skeleton = skeleton_of(paths, shard_turns, max_skeleton)
    broadcast = spark.sparkContext.broadcast(skeleton)
    found = scratch.table(walk_shards(paths, skeleton, broadcast), "found")
    scratch.drop(paths)
    sums = found.where(F.col("kind") == PARTIAL).groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"), F.max("size").alias("size"))
    # at most max_skeleton rows
    partials = {r["node"]: r.asDict() for r in sums.collect()}
    folded = spark.createDataFrame(
        fold_skeleton(skeleton, partials),
        "node long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long")
    top = folded.join(_ends(found.where(F.col("kind") == ENDS)), "node", "left") \
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))
    least = folded.select("node", F.col("conv_id").alias("above"))
    local = found.where(F.col("kind") == LOCAL).join(F.broadcast(least), "node", "left") \
        .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return top.select(*NODE_COLUMNS).unionByName(local.select(*NODE_COLUMNS))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT conv_id, list(struct_pack(role := role, text := text)
                       ORDER BY turn NULLS FIRST, role, md5(text)) AS turns
  FROM t GROUP BY conv_id),
h AS (
  SELECT conv_id, turns, xor(list_reduce(
    list_prepend(4294967295::UBIGINT,
                 list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)),
    lambda acc, b: list_reduce(
      list_prepend(xor(acc, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
      lambda x, z: xor(x >> 1, (x & 1::UBIGINT) * 3988292384::UBIGINT))),
    4294967295::UBIGINT) % 9 AS h
  FROM o),
r AS (
  SELECT c.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, c.h),
                                list_slice(c.turns, c.h + 1, len(c.turns))) AS turns
  FROM h c LEFT JOIN h b ON b.conv_id = c.conv_id - c.conv_id % 5),
p AS (
  SELECT conv_id, d AS depth, len(turns) AS last,
         md5(list_slice(turns, 1, d)::VARCHAR || '#' || d) AS node,
         CASE WHEN d > 0 THEN md5(list_slice(turns, 1, d - 1)::VARCHAR || '#' || (d - 1)) END AS up,
         CASE WHEN d > 0 THEN octet_length(encode(turns[d].text)) ELSE 0 END AS size
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (
  SELECT node, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id,
         count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = last), ''))
           AS ends_sha256
  FROM p GROUP BY node),
k AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
m AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children, (n_convs - 1) * size AS saved
  FROM n LEFT JOIN k USING (node)),
s AS (
  SELECT a.node, sum(CASE WHEN m.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(m.saved) AS saved
  FROM m JOIN p a ON a.conv_id = m.conv_id AND a.depth <= m.depth GROUP BY a.node)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id,
       CAST(m.n_convs AS BIGINT) AS n_convs, CAST(m.n_children AS BIGINT) AS n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN s USING (node) LEFT JOIN m q ON m.up = q.node
"""
