"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors of one label are compared exactly.  Equal vectors are first collapsed
to one.  An orthogonal rotation, fitted on a bounded sample, puts the
directions of most variance first; it changes no product, so the sample bears
on speed only.  Vectors are sorted by their angle to the first direction and
packed into blocks; two blocks whose angles differ by more than the threshold's
can hold no link and are not paired.  A pair of blocks is compared dimension
by dimension: after each step the products so far plus the norms of what is
left bound the cosine (Cauchy-Schwarz), and pairs that cannot reach the
threshold stop.  What survives is compared in double precision on the vectors
as given.

A tile reports per vector its number of links and the smallest vector it is
connected to within the tile, never its pairs, so its output grows with the
vectors and not with the size of a group of copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtables.llm.components import connected_components
from jobtables.llm.sampling import smallest_hashes
from jobtables.llm.shared import Scratch

BLOCK = 1024
SAMPLE = 4096
_SLACK = 1e-9  # of the bounds; the last comparison has none
_BLOCKS = ("label string, dim int, part int, seq int, low double, high double, ids binary, "
           "copies binary, vectors binary")


def _rotation(x: np.ndarray) -> np.ndarray:
    """Orthogonal axes, as columns, of falling second moment."""
    _values, axes = np.linalg.eigh(x.T @ x)
    return np.ascontiguousarray(axes[:, ::-1])


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled by the largest component first: squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _steps(dim: int) -> list[int]:
    out = [min(8, dim)]
    while out[-1] < dim:
        out.append(min(dim, out[-1] * 2))
    return out


def linked_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray, threshold: float
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of unit vectors whose cosine reaches the threshold."""
    rx, ry = x @ axes, y @ axes
    left = lambda r: np.sqrt(np.maximum(  # noqa: E731  norms from each dimension on
        np.cumsum((r * r)[:, ::-1], axis=1)[:, ::-1], 0))
    sx, sy = (np.pad(left(r), ((0, 0), (0, 1))) for r in (rx, ry))
    done, (first, *rest) = 0, _steps(x.shape[1])
    sums = rx[:, :first] @ ry[:, :first].T
    i, j = np.nonzero(sums + np.outer(sx[:, first], sy[:, first]) >= threshold - _SLACK)
    part, done = sums[i, j], first
    for to in rest:
        if not len(i):
            break
        part = part + np.einsum("ij,ij->i", rx[i, done:to], ry[j, done:to])
        alive = part + sx[i, to] * sy[j, to] >= threshold - _SLACK
        i, j, part, done = i[alive], j[alive], part[alive], to
    exact = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
    return i[exact], j[exact]


def _least_connected(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index connected to each of ``n`` by the pairs."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
    return root


def _packed(rows: DataFrame, axes: dict[int, np.ndarray], partitions: int) -> DataFrame:
    """Distinct vectors, sorted by angle within a label, in blocks."""

    @F.pandas_udf("double")
    def angle(vectors: pd.Series) -> pd.Series:
        out = np.empty(len(vectors))
        for k, v in enumerate(vectors):
            x = _unit(np.asarray(v, float)[None])
            out[k] = math.acos(max(-1.0, min(1.0, float(x[0] @ axes[x.shape[1]][:, 0]))))
        return pd.Series(out)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        part, seq, key, held = TaskContext.get().partitionId(), 0, None, []

        def block() -> pd.DataFrame:
            ids, copies, angles, vectors = zip(*held)
            raw = lambda v, t: np.asarray(v, t).tobytes()
            return pd.DataFrame(
                [(*key, part, seq, min(angles), max(angles), raw(ids, "<i8"), raw(copies, "<i8"),
                  np.stack(vectors).astype("<f8").tobytes())],
                columns=[c.split()[0] for c in _BLOCKS.split(", ")])

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if held and (len(held) >= BLOCK or (r.label, r.dim) != key):
                    yield block()
                    held, seq = [], seq + 1
                key = (r.label, r.dim)
                held.append((r.did, r.copies, r.angle, np.asarray(r.vector, float)))
        if held:
            yield block()

    order = ["label", "dim", "angle", "did"]
    return rows.withColumn("angle", angle("vector")).repartitionByRange(partitions, *order) \
        .sortWithinPartitions(*order).mapInPandas(pack, _BLOCKS)


def _compare(axes: dict[int, np.ndarray], threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                a, b = (np.frombuffer(v, "<i8") for v in (r.a_ids, r.b_ids))
                na, nb = (np.frombuffer(v, "<i8") for v in (r.a_copies, r.b_copies))
                x, y = (_unit(np.frombuffer(v, "<f8").reshape(-1, r.dim))
                        for v in (r.a_vectors, r.b_vectors))
                i, j = linked_pairs(x, y, axes[r.dim], threshold)
                if r.same:
                    i, j = i[i < j], j[i < j]
                    both, offset = a, 0
                else:
                    both, offset = np.concatenate([a, b]), len(a)
                links = np.zeros(len(both), np.int64)
                np.add.at(links, i, nb[j])
                np.add.at(links, j + offset, na[i])
                # the smallest id, not index, is the root
                order = np.argsort(both, kind="stable")
                rank = np.empty(len(both), np.int64)
                rank[order] = np.arange(len(both))
                root = both[order][_least_connected(len(both), rank[i], rank[j + offset])[rank]]
                has = links > 0
                yield pd.DataFrame({"did": both[has], "links": links[has], "root": root[has]})

    return run


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    ``vectors(vec_id, embedding, label)``: rows are compared if their labels,
    of any simple type, are equal and not null and their vectors have the same length; vectors
    that are null, empty, zero or hold null or non-finite components have no
    links and are a component of their own.  Repeated rows, and rows that
    repeat an id, count as vectors each.  Null ids count as links but never as
    ``component_id``, unless the whole component has none.  An empty table
    gives no rows; other columns are not read.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0 and at most at 1")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    v = F.col("embedding").cast("array<double>")
    usable = (F.col("label").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0)
              & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
              & F.exists("vector", lambda x: x != 0.0))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("label").cast("string").alias("label"), v.alias("vector"))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False))) \
        .withColumn("h1", F.when(F.col("usable"), F.xxhash64("label", "vector"))) \
        .withColumn("h2", F.when(F.col("usable"), F.xxhash64(F.lit("second"), "vector", "label")))
    rows = scratch.table(rows, "rows")
    # ids of the distinct vectors are fixed by writing them
    distinct = scratch.table(
        rows.where("usable").groupBy("h1", "h2").agg(
            F.first("label").alias("label"), F.first("vector").alias("vector"),
            F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("dim", F.size("vector")).withColumn("did", F.monotonically_increasing_id()),
        "distinct")
    n = distinct.count()
    sample = smallest_hashes(distinct.withColumn("order", F.xxhash64("h1")), F.col("order"), SAMPLE, n) \
        .orderBy("order", "h2").limit(SAMPLE).select("vector").collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r["vector"]), []).append(r["vector"])
    axes = {r["dim"]: np.eye(r["dim"]) for r in distinct.select("dim").distinct().collect()}
    axes |= {d: _rotation(_unit(np.array(x, float))) for d, x in by_dim.items()}

    blocks = scratch.table(_packed(distinct, axes, max(1, -(-n // BLOCK))), "blocks") \
        .withColumn("block", F.col("part").cast("long") * F.lit(1 << 32) + F.col("seq"))
    meta = blocks.select("block", "label", "dim", "low", "high")
    near = math.acos(threshold) + 1e-7
    pairs = meta.select(F.col("block").alias("a"), "label", "dim", "low", "high").join(
        meta.select(F.col("block").alias("b"), "label", "dim", F.col("low").alias("low_b"),
                    F.col("high").alias("high_b")), ["label", "dim"]) \
        .where((F.col("a") <= F.col("b")) & (F.col("low_b") - F.col("high") <= near)
               & (F.col("low") - F.col("high_b") <= near)).select("a", "b", "dim")

    def side(s: str) -> DataFrame:
        return blocks.select(F.col("block").alias(s), *[F.col(c).alias(f"{s}_{c}")
                                                        for c in ("ids", "copies", "vectors")])

    tiles = pairs.join(side("a"), "a").join(side("b"), "b") \
        .withColumn("same", F.col("a") == F.col("b"))
    found = scratch.table(
        tiles.mapInPandas(_compare(axes, threshold), "did long, links long, root long"), "found")
    links = found.groupBy("did").agg(F.sum("links").alias("links"))
    comps = connected_components(
        found.select(F.col("did").alias("u"), F.col("root").alias("v")), scratch)
    joined = distinct.select("did", "h1", "h2", "copies", "least").join(links, "did", "left") \
        .join(comps.withColumnRenamed("node", "did"), "did", "left") \
        .withColumn("component", F.coalesce("component", "did"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    result = scratch.table(
        joined.join(least, "component").select(
            "h1", "h2", "component_id",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "result")
    alone = rows.where("NOT usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    compared = rows.where("usable").select("vec_id", "h1", "h2").join(result, ["h1", "h2"]) \
        .select("vec_id", "n_links", "component_id")
    return compared.unionByName(alone) \
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
c(v, u) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT c.v, l.b FROM c JOIN l ON l.a = c.u),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (SELECT v, min(u) AS component_id FROM c GROUP BY v)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, r.component_id,
       v.vec_id = r.component_id AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id JOIN r ON r.v = v.vec_id
"""
