"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of words (lower case, without
punctuation at the ends).  Items are matched in blocks of bounded size, each
broadcast: a document's runs of ``min_match`` words that an item shares are
the seeds; where seeds cover enough of an item, the pair is tiled.  Tiling
repeats a Karp-Rabin scan for common runs of unmarked words, marks the longest
first and halves the run length until ``min_match``; every word lies in one
tile at most, so passages whose parts were reordered are still covered.  A
document is contaminated by an item if its tiles cover at least ``threshold``
of the item's words.
"""

from __future__ import annotations

import heapq
import string
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtables.llm.shared import Scratch

BLOCK_BYTES = 16 << 20
PUNCTUATION = string.punctuation + "“”‘’„«»‹›¿¡…–—"
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_SCHEMA = "doc_id string, item_id long, coverage double, n_tiles int, matched_words int, n_words int"


def words(text: str | None) -> list[str]:
    return [w for w in (x.strip(PUNCTUATION) for x in (text or "").lower().split()) if w]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def run_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``width`` ids, modulo 2**64."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64),
                           np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(ids)),
                                     dtype=np.uint64)])
    return (sums[width:] - sums[:-width]) * _powers(_INVERSE, n)


def _scan(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray,
          width: int) -> list[tuple[int, int, int]]:
    """Maximal common runs of at least ``width`` unmarked ids, as
    ``(-length, start in a, start in b)``."""
    def open_starts(free):
        marked = np.concatenate([[0], np.cumsum(~free)])
        return np.flatnonzero(marked[width:] == marked[:-width])

    at_a, at_b = open_starts(free_a), open_starts(free_b)
    if not len(at_a) or not len(at_b):
        return []
    ha, hb = run_hashes(a, width)[at_a], run_hashes(b, width)[at_b]
    order = np.argsort(ha, kind="stable")
    lo, hi = (np.searchsorted(ha[order], hb, side) for side in ("left", "right"))
    each = hi - lo
    if not each.sum():
        return []
    # all pairs of equal hashes by diagonal; neighbours on one make a longer run
    j = np.repeat(at_b, each)
    within = np.arange(len(j)) - np.repeat(np.cumsum(each) - each, each)
    i = at_a[order[np.repeat(lo, each) + within]]
    place = np.sort((i - j + len(b)) * (len(a) + 1) + i)
    first = np.flatnonzero(np.diff(place, prepend=-2) != 1)
    n = np.diff(np.append(first, len(place))) + width - 1
    i = place[first] % (len(a) + 1)
    j = i - (place[first] // (len(a) + 1) - len(b))
    return list(zip((-n).tolist(), i.tolist(), j.tolist()))


def tile(a: np.ndarray, b: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(start in a, start in b, length)`` of tiles."""
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    tiles, width = [], max(min_match, min(len(a), len(b)))
    while True:
        found = _scan(a, b, free_a, free_b, width)
        heapq.heapify(found)
        while found:  # the longest first; what earlier tiles left of a run goes back
            n, i, j = heapq.heappop(found)
            # equal hashes are held against the ids themselves
            free = free_a[i:i - n] & free_b[j:j - n] & (a[i:i - n] == b[j:j - n])
            if free.all():
                tiles.append((i, j, -n))
                free_a[i:i - n] = free_b[j:j - n] = False
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
            for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
                if e - s >= width:
                    heapq.heappush(found, (s - e, i + s, j + s))
        if width == min_match:
            return tiles
        width = max(min_match, width // 2)


@dataclass
class Block:
    """Items of one block and the index of their seeds."""
    min_match: int
    threshold: float
    vocabulary: dict[str, int] = field(default_factory=dict)
    item_ids: list[int | None] = field(default_factory=list)
    items: list[np.ndarray] = field(default_factory=list)
    short: dict[int, list[tuple[int | None, np.ndarray]]] = field(default_factory=dict)

    def add(self, item_id: int | None, text: str | None) -> None:
        ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)],
                       np.int64)
        if len(ids) >= self.min_match:
            self.item_ids.append(item_id)
            self.items.append(ids)
        elif len(ids):  # its only seed is the whole item
            self.short.setdefault(len(ids), []).append((item_id, ids))

    def finish(self) -> "Block":
        hashes = [run_hashes(x, self.min_match) for x in self.items]
        self.seed = np.concatenate([np.empty(0, np.uint64), *hashes])
        self.seed_item = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        self.seed_at = np.concatenate([np.empty(0, np.int64), *[np.arange(len(h)) for h in hashes]])
        order = np.argsort(self.seed, kind="stable")
        self.seed, self.seed_item, self.seed_at = (
            x[order] for x in (self.seed, self.seed_item, self.seed_at))
        self.short_hashes = {n: np.concatenate([run_hashes(ids, n) for _, ids in held])
                             for n, held in self.short.items()}
        return self

    def _ids(self, text: str) -> np.ndarray:
        """Ids of a text's words, 0 for those of no item."""
        get, all_words = self.vocabulary.get, text.lower().split()
        out = [*map(get, all_words)]
        for k, v in enumerate(out):
            if v is None:
                bare = all_words[k].strip(PUNCTUATION)
                out[k] = get(bare, 0) if bare else -1
        ids = np.array(out, np.int64)
        return ids[ids >= 0]

    def matches(self, text: str | None) -> list[tuple]:
        """``(item_id, coverage, n_tiles, matched_words, n_words)`` of the items
        whose coverage reaches the threshold."""
        if not text or not (len(self.seed) or self.short):
            return []
        ids, k = self._ids(text), self.min_match
        whole = [(item, 1.0, 1, n, n) for n in sorted(self.short) for item in self._whole(ids, n)]
        return whole + (self._tiled(ids, k) if len(self.seed) else [])

    def _whole(self, ids: np.ndarray, n: int) -> list[int | None]:
        """Items of ``n`` words, fewer than ``min_match``, that occur whole."""
        hashes = run_hashes(ids, n)
        out = []
        for k in np.flatnonzero(np.isin(self.short_hashes[n], hashes)).tolist():
            item, want = self.short[n][k]
            at = np.flatnonzero(hashes == self.short_hashes[n][k])
            if (ids[at[:, None] + np.arange(n)] == want).all(axis=1).any():
                out.append(item)
        return out

    def _tiled(self, ids: np.ndarray, k: int) -> list[tuple]:
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        starts = np.flatnonzero(known[k:] - known[:-k] == k)
        if not len(starts):
            return []
        hashes = run_hashes(ids, k)[starts]
        lo, hi = (np.searchsorted(self.seed, hashes, side) for side in ("left", "right"))
        hit = hi > lo
        starts, lo, hi = starts[hit], lo[hit], hi[hit]
        if not len(starts):
            return []
        # the items that share seeds, and how much of each the seeds cover
        shared = np.unique(np.concatenate([np.arange(x, y) for x, y in
                                           np.unique(np.stack([lo, hi], 1), axis=0)]))
        out = []
        for item in np.unique(self.seed_item[shared]).tolist():
            target = self.items[item]
            covered = np.zeros(len(target) + 1, np.int64)
            at = self.seed_at[shared[self.seed_item[shared] == item]]
            np.add.at(covered, at, 1)
            np.add.at(covered, at + k, -1)
            if (np.cumsum(covered[:-1]) > 0).sum() < self.threshold * len(target):
                continue  # tiles lie within seeds, so they cannot cover enough
            own = self.seed[shared[self.seed_item[shared] == item]]
            near = starts[np.isin(hashes[hit], own)]
            inside = np.zeros(len(ids) + 1, np.int64)
            np.add.at(inside, near, 1)
            np.add.at(inside, near + k, -1)
            kept = np.cumsum(inside[:-1]) > 0
            # the parts outside of seeds are cut out; a mark keeps their ends apart
            cut = np.flatnonzero(kept & ~np.concatenate([[False], kept[:-1]]))
            parts = np.insert(np.where(kept, ids, -2), cut, -1)
            tiles = tile(target, parts[parts != -2], k)
            matched = sum(n for _, _, n in tiles)
            if matched >= self.threshold * len(target):
                out.append((self.item_ids[item], matched / len(target), len(tiles), matched,
                            len(target)))
        return out


def blocks(benchmark: DataFrame, min_match: int = 5, threshold: float = 0.8,
           block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark in blocks of about ``block_bytes`` of text, one at a time
    on the driver.  Items without words match nothing; one of fewer than
    ``min_match`` words matches where it occurs whole."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")) \
        .where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(
            F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        block = Block(min_match, threshold)
        for r in sorted(part.collect(), key=lambda r: (r["item_id"] is None, r["item_id"], r["text"])):
            block.add(r["item_id"], r["text"])
        yield block.finish()


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, min_match: int = 5,
                       threshold: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, coverage, n_tiles, matched_words, n_words`` of every
    document and item whose coverage reaches the threshold.

    Null and empty texts match nothing; repeated rows give their pairs each;
    empty tables give no pairs; columns other than the id and text of each
    table are not read.
    """
    spark, out = docs.sparkSession, None
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    names = [c.split()[0] for c in _SCHEMA.split(", ")]
    scratch, shared = Scratch(spark, "tiling"), None
    for block in blocks(benchmark, min_match, threshold, block_bytes):
        if shared is not None:  # one block is broadcast at a time
            out = scratch.table(out, "pairs")
            shared.destroy()
        shared = spark.sparkContext.broadcast(block)

        def find(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                got = [(d, *m) for d, t in zip(pdf["doc_id"], pdf["text"])
                       for m in shared.value.matches(t)]
                yield pd.DataFrame(got, columns=names).astype({"item_id": "Int64"})

        part = rows.mapInPandas(find, _SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _is_contaminated(text: Column, shared) -> Column:
    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(shared.value.matches(t)) for t in texts], dtype=bool)

    return run(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, all columns."""
    out, shared, written = docs, None, None
    scratch = Scratch(docs.sparkSession, "tiling")
    for block in blocks(benchmark, **params):
        if shared is not None:  # one block is broadcast at a time
            last, written = written, scratch.table(out, "kept")
            out = written
            shared.destroy()
            if last is not None:
                scratch.drop(last)
        shared = docs.sparkSession.sparkContext.broadcast(block)
        out = out.where(~_is_contaminated(F.col("text"), shared))
    return out
