"""SimHash near-duplicates with pigeonring filtering.

Fingerprints of at most ``max_bits`` differing bits are linked.  The 64 bits
are cut into ``max_bits + 1`` consecutive segments on a ring.  If two
fingerprints differ in at most ``t`` bits, some segment starts a chain in
which the first ``l`` segments together differ in at most ``l * t / (t + 1)``
bits, for every ``l``: none in the first, one in the first two, and so on.
The join key holds the first two segments of a chain (the second one with at
most one bit flipped), so candidates share about 26 bits; the longer chains
are tested before the full Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtables.llm.components import connected_components
from jobtables.llm.shared import Scratch, shuffle_partitions

SEED = 42  # of XXH64
BROADCAST_ROWS = 2_000_000  # row numbers that are broadcast
_SLICE = 2_000_000  # shingle hashes held at once while bits are counted


def _text_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every ``width``-word shingle of the lower-cased text."""
    import xxhash
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e - 1], SEED) for s, e in zip(starts, ends[width - 1:])),
                       np.uint64, len(words) - width + 1)


def _majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; none: zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _SLICE):
        part = hashes[at:at + _SLICE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: Column, width: int) -> Column:
    """64-bit SimHash of ``text`` as a signed long (null and empty: zero)."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_majority(_text_hashes(t, width)) for t in texts], dtype="int64")

    return run(text)


def _segments(fp: Column, max_bits: int) -> tuple[list[Column], list[int]]:
    n = max_bits + 1
    widths = [64 // n + (i < 64 % n) for i in range(n)]
    cols, low = [], 0
    for w in widths:
        cols.append(F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << w) - 1).cast("long"))
                    if w < 64 else fp)
        low += w
    return cols, widths


def _bits(x: Column) -> Column:
    return F.bit_count(x)


def _mask(parts: list[int], widths: list[int]) -> int:
    """The bits of the given segments as a signed long."""
    m = 0
    for i in parts:
        m |= ((1 << widths[i]) - 1) << sum(widths[:i])
    return m - (1 << 64) if m >> 63 else m


def link_fingerprints(fps: DataFrame, max_bits: int) -> DataFrame:
    """``fps(fp)`` of distinct fingerprints -> links ``(u, v)``, u < v, of all
    pairs that differ in at most ``max_bits`` bits (each found once or more)."""
    if not 0 < max_bits < 16:
        raise ValueError("max_bits must lie in 1..15")
    n = max_bits + 1
    segs, widths = _segments(F.col("fp"), max_bits)

    def key(i: int, second: Column) -> Column:
        return segs[i].bitwiseOR(F.shiftleft(second, widths[i])).alias("key")

    index, probe = [], []
    for i in range(n):
        nxt = (i + 1) % n
        chain = F.lit(i).alias("chain")  # the segment that starts it
        index.append(F.struct(chain, key(i, segs[nxt])))
        flips = [segs[nxt]] + [segs[nxt].bitwiseXOR(F.lit(1 << b).cast("long"))
                               for b in range(widths[nxt])]
        probe += [F.struct(chain, key(i, s)) for s in flips]
    # few files hold many fingerprints: all tasks take part in the expansion
    fps = fps.repartition(2 * shuffle_partitions(fps.sparkSession), "fp")
    a = fps.select(F.col("fp").alias("u"), F.explode(F.array(*probe)).alias("x")) \
        .select("u", "x.chain", "x.key")
    b = fps.select(F.col("fp").alias("v"), F.explode(F.array(*index)).alias("x")) \
        .select("v", "x.chain", "x.key")
    diff = F.col("u").bitwiseXOR(F.col("v"))
    within = F.lit(True)
    for length in range(3, n):  # chains of 3 segments and more, pruned in turn
        for i in range(n):
            mask = F.lit(_mask([(i + j) % n for j in range(length)], widths)).cast("long")
            within = within & ((F.col("chain") != i)
                               | (_bits(diff.bitwiseAND(mask)) <= length * max_bits // n))
    # candidates are shuffled at every size, so the plan does not change with it
    return a.join(b.hint("merge"), ["chain", "key"]).where(F.col("u") < F.col("v")).where(within) \
        .where(_bits(diff) <= max_bits).select("u", "v")


def near_duplicates(rows: DataFrame, scratch: Scratch, max_bits: int = 4) -> DataFrame:
    """Components of linked fingerprints of ``rows(doc_id, fp)``.

    Returns ``groups(fp, label, n_rows, component_id)``, a table in
    ``scratch`` with one row per distinct fingerprint, where ``label`` is the
    smallest fingerprint of the component, ``n_rows`` the input rows of the
    whole component and ``component_id`` its smallest id (null if all are).

    Null and empty texts have the fingerprint zero, linked like any other;
    texts of fewer words than the shingles are one shingle.  Rows of one id
    keep a fingerprint each.  An empty table gives an empty table.
    """
    own = scratch.table(
        rows.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "distinct")
    comps = connected_components(link_fingerprints(own.select("fp"), max_bits), scratch)
    linked = own.join(comps.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("label", F.coalesce("component", "fp"))
    per = linked.where("component IS NOT NULL").groupBy("label") \
        .agg(F.sum("n").alias("n_rows"), F.min("least").alias("component_id"))
    alone = linked.where("component IS NULL") \
        .select("fp", "label", F.col("n").alias("n_rows"), F.col("least").alias("component_id"))
    together = linked.where("component IS NOT NULL").select("fp", "label").join(per, "label") \
        .select("fp", "label", "n_rows", "component_id")
    return scratch.table(alone.unionByName(together), "groups")


def simhash_components(docs: DataFrame, width: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` (16 hex digits) and
    ``component_id`` (the smallest id of the component)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.table(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                     fingerprint(F.col("text"), width).alias("fp")), "fingerprints")
    groups = near_duplicates(rows, scratch, max_bits)
    return rows.join(groups.select("fp", "component_id"), "fp") \
        .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_group(docs: DataFrame, width: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the smallest id
    (nulls last), among equal ids the smallest text hash.  All columns stay."""
    scratch = Scratch(docs.sparkSession, "simhash-keep")
    cols = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"))
    # one pass over the texts; the written number tells equal rows apart
    tagged = scratch.table(
        row.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64("row").alias("hash"),
                   fingerprint(F.col("row.text"), width).alias("fp"),
                   F.monotonically_increasing_id().alias("number")), "tagged")
    ids = tagged.select("number", "doc_id", "hash", "fp")
    groups = near_duplicates(ids.select("doc_id", "fp"), scratch, max_bits)
    many = scratch.table(ids.join(groups.where("n_rows > 1").select("fp", "label"), "fp"), "many")
    best = many.groupBy("label").agg(F.min_by("number", F.struct(
        F.col("doc_id").isNull(), "doc_id", "hash", "number")).alias("number"))
    # texts are not grouped: the numbers of the rows that go are taken out
    gone = scratch.table(many.select("number").join(best.select("number"), "number", "left_anti"), "gone")
    if gone.count() <= BROADCAST_ROWS:  # else texts are shuffled once
        gone = F.broadcast(gone)
    return tagged.join(gone, "number", "left_anti").select("row.*") \
        .select(*[F.col(f"`{c}`") for c in cols])
