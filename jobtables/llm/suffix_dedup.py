"""Suffix-array dedup: remove every byte of a long string that occurs twice.

A string of ``length`` bytes that starts at two places is found at both.  All
suffixes of a corpus cannot be sorted in one task, so starts are first dealt
to anchors: the anchor of a start is the k-byte piece of its string with the
smallest hash, which is the same wherever the string occurs.  Strings can only
repeat where their anchors do.  Around each repeated anchor lies a piece of
text, all strings of the starts it owns; equal pieces are collapsed to one.
Pieces that share an anchor but differ are sorted by a suffix array of their
text from the anchor on, and another of the text before it, read backwards.
Intervals of the two arrays tell which strings agree on both sides.  An anchor
with many different pieces is dealt again by the bytes after it and by the
bytes before it, one of which lies in every string, and where many pieces share
those too, the strings are counted by hash.

The suffix arrays are built by linear grouping: suffixes are grouped by their
longest Lyndon prefix, groups are handled in descending order and pass their
members' previous-smaller pointers on to the groups those point to, and then
every group's order is emitted from the sorted suffixes before it; no suffix
is renamed and nothing recurs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtables.llm.shared import Scratch, shuffle_partitions

LENGTH, ANCHOR = 200, 32
BUCKET = 20_000  # pieces that are sorted together
GROUP = 2_000  # different pieces of one anchor, or of one side of it, that are not dealt again
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_WORD = 8  # bytes of a symbol of the suffix arrays


# ---------------------------------------------------------------- suffix array

def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of a list of non-negative integers, by linear grouping.

    First phase: ``link[i]`` is the first place of the group of suffix ``i``;
    a group's suffixes share a prefix, and groups lie in ascending order.  The
    highest group not yet handled is final: its common prefix is the longest
    Lyndon prefix of its members.  For each of them the nearest suffix before
    it in a lower group is its previous smaller one; such suffixes are moved
    to the end of their group, those that precede more members further back.
    Second phase: in ascending order, suffix ``i`` settles the suffixes whose
    Lyndon prefix ends where ``i`` begins, each at the front of its group.
    """
    n = len(text)
    if not n:
        return []
    order = np.argsort(np.asarray(text), kind="stable")
    sa = order.tolist()
    sorted_text = np.asarray(text)[order]
    first = np.concatenate([[True], sorted_text[1:] != sorted_text[:-1]])
    starts = np.flatnonzero(first)
    link_of_place = starts[np.cumsum(first) - 1]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    link = link_of_place[place].tolist()
    place = place.tolist()
    size = dict(zip(starts.tolist(), np.diff(np.append(starts, n)).tolist()))
    prev = [-1] * n
    end = n - 1
    while end >= 0:
        start = link[sa[end]]
        members = sorted(sa[start:end + 1]) if end > start else [sa[end]]
        end = start - 1
        counts: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and link[p] >= start:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        if not counts:
            continue
        by_count: dict[int, dict[int, list[int]]] = {}
        for p, c in counts.items():
            by_count.setdefault(c, {}).setdefault(link[p], []).append(p)
        for c in sorted(by_count, reverse=True):
            # a group's start may have moved on for members with higher counts only
            for group, moved in by_count[c].items():
                left = size[group] - len(moved)
                if left:
                    last = group + size[group] - 1
                    for p in moved:
                        q, at = sa[last], place[p]
                        sa[last], sa[at] = p, q
                        place[p], place[q] = last, at
                        last -= 1
                    new = group + left
                    for p in moved:
                        link[p] = new
                    size[group], size[new] = left, len(moved)
    # second phase
    front = {s: s for s in size}
    out, done = [-1] * n, bytearray(n)
    # the empty suffix is the smallest of all and settles the last one's chain
    at = 0
    p = n - 1
    while True:
        while p >= 0 and not done[p]:
            done[p] = 1
            g = link[p]
            out[front[g]] = p
            front[g] += 1
            p = prev[p]
        if at == n:
            return out
        p = out[at] - 1
        at += 1


# -------------------------------------------------------------------- anchors

@lru_cache(maxsize=8)
def _powers_to(bits: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (base, pow(base, -1, 1 << 64)):
        p = np.full(1 << bits, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _base(attempt: int) -> int:
    """Odd bases, one per attempt."""
    return (_BASE * (2 * attempt + 1) + 4 * attempt) % (1 << 64)


def anchors(data: bytes, length: int = LENGTH, k: int = ANCHOR, attempt: int = 0):
    """``(anchor, first start, last start, hash of the anchor, hash of the
    piece)`` as arrays; a piece reaches from its first start to ``length``
    bytes after its last one."""
    n = len(data) - length + 1  # starts
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    w = length - k + 1  # k-byte pieces in a string
    bits = max(16, len(data).bit_length())
    powers, inverse = _powers_to(bits, _base(attempt))
    b = np.frombuffer(data, np.uint8)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers[:len(b)], out=sums[1:])
    m = len(b) - k + 1
    h = _mixed((sums[k:] - sums[:m]) * inverse[:m])
    # smallest of each w: blocks of w, their running minima from both ends; the
    # low byte holds the place in the block, so that of equals the left one wins
    blocks = -(-m // w)
    packed = np.full(blocks * w, ~np.uint64(0), np.uint64)
    packed[:m] = h & ~np.uint64(255)
    packed = packed.reshape(blocks, w)
    packed |= np.arange(w, dtype=np.uint64)
    right = np.minimum.accumulate(packed, axis=1).ravel()[w - 1:w - 1 + n]
    left = np.minimum.accumulate(packed[:, ::-1], axis=1)[:, ::-1].ravel()[:n]
    s = np.arange(n)
    low = np.uint64(255)
    anchor = np.where((right >> np.uint64(8)) < (left >> np.uint64(8)),
                      (s + w - 1) // w * w + (right & low).astype(np.int64),
                      s // w * w + (left & low).astype(np.int64))
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.append(first[1:], n) - 1
    piece = _mixed((sums[last + length] - sums[first]) * inverse[first]
                   + (last - first).astype(np.uint64))
    return anchor[first], first, last, h[anchor[first]], piece


def second_hash(data: bytes, first: np.ndarray, last: np.ndarray, length: int, attempt: int
                ) -> np.ndarray:
    """Hash of each piece with another base than that of its first hash."""
    powers, inverse = _powers_to(max(16, len(data).bit_length()), _base(attempt + 1))
    b = np.frombuffer(data, np.uint8)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers[:len(b)], out=sums[1:])
    return _mixed((sums[last + length] - sums[first]) * inverse[first])


_ANCHORS = "k1 long, k2 long, h long, piece long, second long, anchor int, first int, last int"


def _all_anchors(rows: DataFrame, length: int, k: int, attempt: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held, size = [], 0
            for k1, k2, data in zip(pdf["k1"], pdf["k2"], pdf["data"]):
                a, first, last, h, piece = anchors(data, length, k, attempt)
                if len(a):
                    second = second_hash(data, first, last, length, attempt)
                    held.append((np.full(len(a), k1), np.full(len(a), k2), h.view(np.int64),
                                 piece.view(np.int64), second.view(np.int64),
                                 *(x.astype(np.int32) for x in (a, first, last))))
                    size += len(a)
                if size > 200_000:
                    yield frame(held)
                    held, size = [], 0
            if held:
                yield frame(held)

    def frame(held: list) -> pd.DataFrame:
        return pd.DataFrame({c.split()[0]: np.concatenate(x)
                             for c, x in zip(_ANCHORS.split(", "), zip(*held))})

    return rows.select("k1", "k2", "data").mapInPandas(run, _ANCHORS)


# ------------------------------------------------------------ pieces in buckets

_SPANS = "h long, piece long, from long, to long"


def _order(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix by a suffix array of them all, and
    the bytes that each shares with the one before in that order."""
    n, width = texts.shape
    words = np.ascontiguousarray(texts).view(">u8")
    _, symbols = np.unique(words, return_inverse=True)
    lines = np.zeros((n, width // _WORD + 1), np.int64)  # a 0 ends each row
    lines[:, :-1] = symbols.reshape(n, -1) + 1
    sa = np.array(suffix_array(lines.ravel().tolist()), np.int64)
    order = sa[sa % lines.shape[1] == 0] // lines.shape[1]
    differ = texts[order[1:]] != texts[order[:-1]]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, np.concatenate([[0], shared])


def repeated_starts(pieces: list[bytes], at: np.ndarray, starts: np.ndarray,
                    lo: np.ndarray, hi: np.ndarray, length: int = LENGTH, k: int = ANCHOR
                    ) -> np.ndarray:
    """Which starts of each piece begin a string that another piece holds at
    the same place before its anchor: a matrix by bytes before the anchor.

    ``at`` is the anchor's place in its piece and ``starts`` how many starts
    it has, of which those ``lo`` to ``hi`` bytes before the anchor count; no
    two rows are of one piece and count the same start."""
    n, before = len(pieces), length - k
    pad = lambda x: -(-x // _WORD) * _WORD
    after = np.zeros((n, pad(length)), np.uint8)
    back = np.zeros((n, pad(before)), np.uint8)
    for i, (p, a) in enumerate(zip(pieces, at.tolist())):
        x = np.frombuffer(p, np.uint8)
        tail, head = x[a:a + length], x[:a][::-1]
        after[i, :len(tail)] = tail
        back[i, :len(head)] = head
    (right, right_shared), (left, left_shared) = _order(after), _order(back)
    out = np.zeros((n, before + 1), bool)
    r, lf = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(before + 1):  # bytes before the anchor
        own = np.flatnonzero((d <= at) & (d > at - starts) & (d >= lo) & (d <= hi))
        if len(own) < 2:
            continue
        r[right] = np.cumsum(right_shared < length - d)
        lf[left] = np.cumsum(left_shared < d)
        key = r[own] * (n + 1) + lf[own]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        hit = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        out[own[by[hit]], d] = True
    return out


def _runs(s: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Spans of the strings at ascending starts; neighbours make one span."""
    cut = np.flatnonzero(np.diff(s) > 1)
    return [(a, b + length) for a, b in zip(s[np.concatenate([[0], cut + 1])].tolist(),
                                            s[np.append(cut, len(s) - 1)].tolist())]


def _compare(length: int, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list = []
        for pdf in batches:
            for r in zip(*[pdf[c] for c in ("g", "h", "piece", "at", "starts", "lo", "hi", "data")]):
                if len(held) >= BUCKET and held[-1][0] != r[0]:
                    yield spans(held)
                    held = []
                held.append(r)
        if held:
            yield spans(held)

    def spans(held: list) -> pd.DataFrame:
        _g, h, piece, at, starts, lo, hi, data = zip(*held)
        at, starts, lo, hi = (np.array(x, np.int64) for x in (at, starts, lo, hi))
        hits = repeated_starts([bytes(d) for d in data], at, starts, lo, hi, length, k)
        rows = []
        for i in np.flatnonzero(hits.any(axis=1)).tolist():
            rows += [(h[i], piece[i], *r) for r in
                     _runs(np.sort(at[i] - np.flatnonzero(hits[i])), length)]
        return pd.DataFrame(rows, columns=["h", "piece", "from", "to"])

    return run


def _large(rows: DataFrame, scratch: Scratch, group: int) -> DataFrame:
    """Keys ``g`` of more than ``group`` rows, at most one per ``group`` rows."""
    return scratch.table(rows.groupBy("g").agg(F.count("*").alias("n"))
                         .where(F.col("n") > group).select("g"), "large")


def _dealt(texts: DataFrame, scratch: Scratch, length: int, k: int, group: int
           ) -> tuple[DataFrame, DataFrame | None]:
    """``texts`` with the key ``g`` under which they are sorted together, at
    most ``group`` rows each, and the rows that remain too many (or None).

    Of an anchor with more pieces, a string that begins up to half its length
    before the anchor holds the half from there on, any other one the half
    before it; strings that are equal agree in that half."""
    last, half = length - k, length // 2
    whole = texts.select(F.col("h").alias("g"), "*", F.lit(0).alias("lo"), F.lit(last).alias("hi"))
    large = _large(whole, scratch, group)
    if large.isEmpty():
        return whole, None
    inside = whole.join(F.broadcast(large), "g", "left_semi").drop("g", "lo", "hi")
    side = lambda name, first: F.xxhash64(
        F.lit(name), "h", F.substring("data", (first + 1).cast("int"), F.lit(half))).alias("g")
    after = inside.where(F.col("at") - F.col("starts") < half).select(
        side("after", F.col("at")), "*", F.lit(0).alias("lo"), F.lit(min(half, last)).alias("hi"))
    before = inside.where(F.col("at") > half).select(
        side("before", F.col("at") - half), "*", F.lit(half + 1).alias("lo"), F.lit(last).alias("hi"))
    halves = after.unionByName(before)
    larger = _large(halves, scratch, group)
    dealt = whole.join(F.broadcast(large), "g", "left_anti") \
        .unionByName(halves.join(F.broadcast(larger), "g", "left_anti"))
    return dealt, None if larger.isEmpty() else halves.join(F.broadcast(larger), "g", "left_semi")


def _counted(rows: DataFrame, scratch: Scratch, length: int) -> DataFrame:
    """``(h, piece, from, to)`` of the strings that two of the pieces hold, by
    counts of their 128-bit hashes; a piece holds a string once at most."""
    starts = F.sequence(F.greatest("lo", F.col("at") - F.col("starts") + 1), F.least("hi", "at"))
    each = rows.select("h", "piece", "at", "data", F.explode(starts).alias("d"))
    string = F.substring("data", (F.col("at") - F.col("d") + 1).cast("int"), F.lit(length))
    each = each.select("h", "piece", (F.col("at") - F.col("d")).alias("s"),
                       F.xxhash64(string).alias("s1"), F.xxhash64(F.lit("second"), string).alias("s2"))
    twice = scratch.table(each.groupBy("s1", "s2").agg(F.count("*").alias("n"))
                          .where("n > 1").select("s1", "s2"), "strings")
    held = each.join(twice, ["s1", "s2"], "left_semi").groupBy("h", "piece") \
        .agg(F.array_sort(F.collect_list("s")).alias("s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(h, p, *r) for h, p, s in zip(pdf["h"], pdf["piece"], pdf["s"])
                                for r in _runs(np.asarray(s), length)],
                               columns=["h", "piece", "from", "to"])

    return held.mapInPandas(run, _SPANS)


# -------------------------------------------------------------------- operator

def _keyed(docs: DataFrame) -> DataFrame:
    """A 128-bit key of (doc_id, text): equal rows have equal results."""
    cols = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")]
    return docs.select(*cols).select(
        "record", F.xxhash64("record.text").alias("k1"),
        F.xxhash64(F.lit("row"), "record.doc_id", "record.text").alias("k2"),
        F.coalesce(F.encode("record.text", "UTF-8"), F.lit(b"")).alias("data"))


def repeated_spans(docs: DataFrame, scratch: Scratch, length: int = LENGTH, k: int = ANCHOR,
                   group: int = GROUP, attempt: int = 0) -> DataFrame:
    """``(k1, k2, spans)``: per key the byte spans covered by strings of
    ``length`` bytes that also start elsewhere (they may overlap).

    Pieces count as equal if two hashes of different bases agree; where only
    one does, all is done again with other bases."""
    if not 16 <= k <= length <= k + 255:
        raise ValueError("needs 16 <= k <= length <= k + 255")
    rows = _keyed(docs).where(F.octet_length("data") >= length)
    found = scratch.table(_all_anchors(rows, length, k, attempt), "found")
    twice = scratch.table(
        found.groupBy("h").agg(F.count("*").alias("n"), F.min("piece").alias("p1"),
                               F.max("piece").alias("p2"))
        .where("n > 1").select("h", (F.col("p1") != F.col("p2")).alias("mixed")), "repeated")
    again = scratch.table(found.join(twice, "h"), "anchors")
    scratch.drop(found)
    place = F.struct("k1", "k2", "anchor", "first", "last")
    pieces = scratch.table(
        again.groupBy("h", "piece").agg(
            F.count("*").alias("copies"), F.min(place).alias("at"), F.first("mixed").alias("mixed"),
            (F.min("second") != F.max("second")).alias("differ")), "pieces")
    if pieces.where("differ").first() is not None:
        return repeated_spans(docs, scratch, length, k, group, attempt + 1)
    # one representative's text of each piece whose anchor has other pieces too
    wanted = pieces.where("mixed").groupBy("at.k1", "at.k2").agg(F.collect_list(
        F.struct("h", "piece", "at.anchor", "at.first", "at.last")).alias("wanted"))
    texts = rows.select("k1", "k2", "data").join(wanted, ["k1", "k2"]) \
        .dropDuplicates(["k1", "k2"]).select("data", F.explode("wanted").alias("x")).select(
            "x.h", "x.piece", (F.col("x.anchor") - F.col("x.first")).alias("at"),
            (F.col("x.last") - F.col("x.first") + 1).alias("starts"),
            F.substring("data", (F.col("x.first") + 1).cast("int"),
                        (F.col("x.last") - F.col("x.first") + length).cast("int")).alias("data"))
    texts = scratch.table(texts, "texts")
    n = texts.count()
    parts = max(1, min(shuffle_partitions(docs.sparkSession), -(-n // 500)), -(-n // BUCKET))
    dealt, many = _dealt(texts, scratch, length, k, group)
    compared = dealt.repartition(parts, "g").sortWithinPartitions("g", "h", "piece") \
        .mapInPandas(_compare(length, k), _SPANS)
    if many is not None:
        compared = compared.unionByName(_counted(many, scratch, length))
    whole = pieces.where("copies > 1").select(
        "h", "piece", F.lit(0).cast("long").alias("from"),
        (F.col("at.last") - F.col("at.first") + length).alias("to"))
    covered = scratch.table(
        whole.unionByName(compared).groupBy("h", "piece")
        .agg(F.collect_list(F.struct("from", "to")).alias("parts")), "covered")
    spans = again.select("h", "piece", "k1", "k2", "first").join(covered, ["h", "piece"]) \
        .select("k1", "k2", F.explode("parts").alias("p"), "first").select(
            "k1", "k2", (F.col("first") + F.col("p.from")).alias("from"),
            (F.col("first") + F.col("p.to")).alias("to"))
    return scratch.table(spans.groupBy("k1", "k2").agg(
        F.collect_set(F.struct("from", "to")).alias("spans")), "spans")


def merged(spans) -> list[tuple[int, int]]:
    """Sorted spans; those that touch or overlap become one."""
    out: list[list[int]] = []
    for a, b in sorted((s["from"], s["to"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _kept(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def _joined(docs: DataFrame, length: int, k: int, group: int) -> DataFrame:
    spans = repeated_spans(docs, Scratch(docs.sparkSession, "suffix"), length, k, group)
    return _keyed(docs).join(spans, ["k1", "k2"], "left")


def repeat_report(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, group: int = GROUP
                  ) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans,
    kept_sha256``.

    Texts are UTF-8 bytes (null: empty); strings never cross documents and are
    judged on the input, all occurrences alike, so a text that occurs twice
    and has ``length`` bytes is removed whole.  Rows that agree in id and text
    are copies of each other.  Texts shorter than ``length`` keep everything.
    An empty table gives no rows.
    """
    schema = "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc_id, data, spans in zip(pdf["doc_id"], pdf["data"], pdf["spans"]):
                m = merged(spans) if spans is not None else []
                rows.append((doc_id, len(data), sum(b - a for a, b in m), len(m),
                             hashlib.sha256(_kept(data, m)).hexdigest()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    rows = _joined(docs, length, k, group).select(
        F.col("record.doc_id").cast("string").alias("doc_id"), "data", "spans")
    return rows.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, group: int = GROUP
                   ) -> DataFrame:
    """``docs`` without the repeated bytes, all columns; characters of which a
    part is removed go whole.  Null texts stay null."""

    @F.pandas_udf("string")
    def cut(data: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_kept(d, merged(s)).decode("utf-8", "ignore") if s is not None
                          else d.decode("utf-8") for d, s in zip(data, spans)])

    text = F.when(F.col("record.text").isNotNull(), cut("data", "spans"))
    return _joined(docs, length, k, group).select(*[
        text.alias(c) if c == "text" else F.col(f"record.`{c}`") for c in docs.columns])
