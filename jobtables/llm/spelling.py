"""Spelling variants by search schemes on bidirectional FM-indexes.

Two words are near if one edit (a code point inserted, deleted or replaced)
makes them equal.  A search takes the shorter word of a pair, of ``m`` code
points, as its pattern; the edit lies either in its right half, so the left
half occurs in the other word unchanged, or in its left half.  Each scheme
matches the exact half first, with its delimiter, turns round and extends
across the other half allowing one error, on suffix-rank intervals over the
delimited words of an index.  An inserted letter differs from the pattern's
next one, so every pair is met in exactly one half, once.

The vocabulary is dealt to blocks by the exact part, ``(m, a, b)`` and the
code points outside ``[a, b)``, so both words of a pair meet in the block of
the half that holds the edit.  A block of more than ``max_block`` words is
dealt again by two halves of its own ``[a, b)``, and so on: no block grows with
the vocabulary, and nothing is left out.  A task indexes some blocks at a time.

Defined cases: null and empty texts have no words; a null doc_id counts as an
empty one; repeated rows count again; an empty table gives no rows; a word may
be as long as a text (its blocks are then searched letter by letter, and only
if they hold a second word).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtables.llm.shared import Scratch, shuffle_partitions

LETTER = "[A-Za-zÀ-ÿ]"
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
TYPO = 31  # an occurrence whose checksum this divides loses a code point
MAX_BLOCK = 4_000  # words of a block
BATCH_WORDS, BATCH_LETTERS = 6_000, 120_000  # of one index
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)``: words of the documents, with the seeded deletions."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all("text", F.lit(f"{LETTER}{{{min_length},}}"), F.lit(0))).alias("run"))
    low = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("low")) \
        .withColumn("h", F.crc32(F.concat("id", F.lit(":"), "low").cast("binary")))
    at = (F.col("h") % F.char_length("low")).cast("int")
    cut = F.concat(F.substring("low", F.lit(1), at),
                   F.substring("low", at + 2, F.char_length("low")))
    return low.select(F.when(F.col("h") % TYPO == 0, cut).otherwise(F.col("low")).alias("word")) \
        .where(F.char_length("word") >= min_length) \
        .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """Add ``key``: the block of a row's ``(m, a, b)`` and exact code points."""
    size = F.char_length("word")
    return rows.withColumn("key", F.xxhash64(
        "m", "a", "b", F.substring("word", F.lit(1), F.col("a")),
        F.substring("word", (size - F.col("m") + F.col("b") + 1).cast("int"), size)))


def _regions(*bounds: tuple[Column, Column]) -> Column:
    return F.explode(F.array(*[F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
                               for a, b in bounds]))


def blocks(words: DataFrame, scratch: Scratch, min_length: int, max_block: int) -> DataFrame:
    """``(word, n, m, a, b, key)``: every word in the blocks of its own halves
    (as a pattern) and of those of a pattern that is one shorter."""
    size = F.char_length("word")
    half = F.floor(F.col("m") / 2)
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")) \
        .where(F.col("m") >= min_length) \
        .select("*", _regions((half, F.col("m")), (F.lit(0), half)).alias("r"))
    rows = _keyed(rows.select("word", "n", "m", "r.a", "r.b"))
    done = []
    while True:
        counts = rows.groupBy("key").agg(F.count("*").alias("rows"), F.max(F.col("b") - F.col("a"))
                                         .alias("width"))
        large = scratch.table(counts.where((F.col("rows") > max_block) & (F.col("width") > 1))
                              .select("key"), "large-blocks")
        if large.first() is None:
            break
        done.append(rows.join(large, "key", "left_anti"))
        mid = F.floor((F.col("a") + F.col("b")) / 2)
        split = rows.join(large, "key", "left_semi").where("b - a > 1").select(
            "word", "n", "m", _regions((F.col("a"), mid), (mid, F.col("b"))).alias("r"))
        rows = scratch.table(_keyed(split.select("word", "n", "m", "r.a", "r.b")), "split-blocks")
    for d in done:
        rows = rows.unionByName(d)
    return rows


class Ranks:
    """``less(i, c)``: how many of the first ``i`` letters of a transform are
    smaller than ``c``; counts of 256 positions, bytes within them."""

    def __init__(self, bwt: np.ndarray, letters: int):
        n = len(bwt)
        self.base = np.zeros((n // 256 + 1, letters + 1), np.int32)
        self.rest = np.zeros((n + 1, letters + 1), np.uint8)
        bounds = np.arange(letters + 1)
        for k in range(n // 256 + 1):
            part = (bwt[k * 256:k * 256 + 256, None] < bounds).cumsum(0)
            if not len(part):
                break
            stop = min(k * 256 + 256, n + 1)
            self.rest[k * 256 + 1:stop] = part[:stop - k * 256 - 1]
            if k + 1 < len(self.base):
                self.base[k + 1] = self.base[k] + part[-1]

    def less(self, i: np.ndarray, c: np.ndarray) -> np.ndarray:
        return self.base[i >> 8, c] + self.rest[i, c]

    def rows(self, i: np.ndarray) -> np.ndarray:
        return self.base[i >> 8] + self.rest[i]


def sorted_rotations(text: np.ndarray) -> np.ndarray:
    """Start positions of the rotations of ``text`` in order, by doubling."""
    rank, width, n = text.astype(np.int64), 1, len(text)
    while True:
        both = rank * (n + 1) + np.roll(rank, -width)
        order = np.argsort(both, kind="stable")
        steps = np.empty(n, np.int64)
        steps[0] = 0
        np.cumsum(np.diff(both[order]) != 0, out=steps[1:])
        rank = np.empty(n, np.int64)
        rank[order] = steps
        if steps[-1] == n - 1 or width >= n:
            return order
        width *= 2


class States:
    """Partial matches: pattern, its next position, and the interval in the
    index that is extended (``x``), in the other one (``y``) and its size."""

    def __init__(self, q, pos, x, y, size):
        self.q, self.pos, self.x, self.y, self.size = q, pos, x, y, size

    def take(self, keep) -> States:
        return States(self.q[keep], self.pos[keep], self.x[keep], self.y[keep], self.size[keep])

    def turned(self) -> States:
        return States(self.q, self.pos, self.y, self.x, self.size)

    @staticmethod
    def joined(parts: list[States]) -> States:
        return States(*(np.concatenate([getattr(p, f) for p in parts])
                        for f in ("q", "pos", "x", "y", "size")))


class BidirectionalIndex:
    """Intervals of sorted rotations of the delimited words (letter 0 ends a
    word), read from left to right and from right to left, kept in step."""

    def __init__(self, words: list[str]):
        raw = np.frombuffer("".join(w + "\0" for w in words).encode("utf-32-le"), np.uint32)
        self.letters, text = np.unique(raw, return_inverse=True)
        self.size = len(text)
        self.owner = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])
        self.order = sorted_rotations(text)
        mirrored = text[::-1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.letters)))])
        self.left = Ranks(text[self.order - 1], len(self.letters))
        self.right = Ranks(mirrored[sorted_rotations(mirrored) - 1], len(self.letters))

    def codes(self, words: list[str]) -> np.ndarray:
        """Letters of equally long words, one row each."""
        raw = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        return np.searchsorted(self.letters, raw).reshape(len(words), -1)

    def start(self, patterns: int, pos: int) -> States:
        zero = np.zeros(patterns, np.int64)
        return States(np.arange(patterns), zero + pos, zero, zero, zero + self.size)

    def extend(self, ranks: Ranks, s: States, c: np.ndarray, step: int) -> States:
        """Matches that go on with letter ``c`` of each."""
        lo, hi = ranks.less(s.x, c), ranks.less(s.x + s.size, c)
        lo1, hi1 = ranks.less(s.x, c + 1), ranks.less(s.x + s.size, c + 1)
        out = States(s.q, s.pos + step, self.first[c] + (lo1 - lo), s.y + (hi - lo),
                     (hi1 - hi) - (lo1 - lo))
        return out.take(out.size > 0)

    def branch(self, ranks: Ranks, s: States, but: np.ndarray | None, step: int) -> States:
        """Matches that go on with any letter other than ``but`` of each."""
        lo, hi = ranks.rows(s.x), ranks.rows(s.x + s.size)
        count = np.diff(hi, axis=1) - np.diff(lo, axis=1)
        able = count > 0
        able[:, 0] = False
        if but is not None:
            able[np.arange(len(but)), but] = False
        i, c = np.nonzero(able)
        return States(s.q[i], s.pos[i] + step, self.first[c] + (lo[i, c + 1] - lo[i, c]),
                      s.y[i] + (hi[i, c] - lo[i, c]), count[i, c])

    def near(self, words: list[str], a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """``(pattern, found word)`` of all words that equal one of ``words``
        (all of one length) but for one letter replaced in ``[a, b)`` or put
        before a position of it (at the end too, if ``b`` is the length)."""
        w = self.codes(words)
        m = w.shape[1]
        rightward = a >= m - b
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if rightward:
            exact, back, on, step, end = range(a - 1, -1, -1), self.left, self.right, 1, m
        else:
            exact, back, on, step, end = range(b, m), self.right, self.left, -1, -1
        s = self.start(len(words), a if rightward else b - 1)
        for p in exact:
            s = self.extend(back, s, w[s.q, p], 0)
        s = self.extend(back, s, np.zeros(len(s.q), np.int64), 0).turned()
        pool: list[States] = []

        def advance(pool: list[States]) -> list[States]:
            moving = States.joined(pool)
            over = moving.pos == end
            if over.any():
                done = moving.take(over)
                done = self.extend(on, done, np.zeros(len(done.q), np.int64), 0)
                at = done.y if rightward else done.x
                found.append((done.q, self.owner[(self.order[at] + 1) % self.size]))
                moving = moving.take(~over)
            if not len(moving.q):
                return []
            return [self.extend(on, moving, w[moving.q, moving.pos], step)]

        for p in (range(a, b) if rightward else range(b - 1, a - 1, -1)):
            letter = w[s.q, p]
            replaced = self.branch(on, s, letter, step)
            if rightward:
                inserted = self.branch(on, s, letter, 0)
                s = self.extend(on, s, letter, step)
            else:
                s = self.extend(on, s, letter, step)
                inserted = self.branch(on, s, w[s.q, p], 0)
            pool = advance(pool + [replaced, inserted])
        if rightward and b == m:
            pool.append(self.branch(on, s, None, 0))
        while any(len(s.q) for s in pool):
            pool = advance(pool)
        if not found:
            none = np.zeros(0, np.int64)
            return none, none
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def near_words(rows: list[tuple[str, int, int, int, int]]) -> list[tuple[str, int, int, str]]:
    """Search some whole blocks, rows ``(word, n, m, a, b)``: per word with near
    words their number, and the most frequent one (smallest of equals)."""
    counts: dict[str, int] = {}
    patterns: dict[tuple[int, int, int], list[str]] = {}
    for word, n, m, a, b in rows:
        counts[word] = n
        if len(word) == m:
            patterns.setdefault((m, a, b), []).append(word)
    words = sorted(counts)  # position: rank in code-point order
    if len(words) < 2 or not patterns:
        return []
    number = {w: i for i, w in enumerate(words)}
    n = np.array([counts[w] for w in words], np.int64)
    length = np.array([len(w) for w in words])
    index = BidirectionalIndex(words)
    of, other = [], []
    for (_, a, b), group in patterns.items():
        q, x = index.near(group, a, b)
        q = np.array([number[w] for w in group], np.int64)[q]
        longer = length[x] > length[q]  # a longer word does not find the shorter one itself
        of += [q, x[longer]]
        other += [x, q[longer]]
    of, other = np.concatenate(of), np.concatenate(other)
    order = np.lexsort((other, -n[other], of))
    of, other = of[order], other[order]
    heads = np.flatnonzero(np.diff(of, prepend=-1))
    sizes = np.diff(np.append(heads, len(of)))
    return [(words[of[h]], int(k), int(n[other[h]]), words[other[h]]) for h, k in zip(heads, sizes)]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: whole blocks are put together to an index each."""
    rows: list[tuple] = []
    block: list[tuple] = []
    letters = 0
    key = None

    def out(found):
        return pa.RecordBatch.from_arrays(
            [pa.array([f[i] for f in found], t) for i, t in
             enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))],
            names=["word", "n_near", "near_n", "near"])
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "word", "n", "m", "a", "b")]
        for k, *row in zip(*columns):
            if k != key:
                if len(block) > 1:  # a single word has no neighbour in its block
                    rows += block
                    letters += sum(len(r[0]) for r in block)
                if len(rows) >= BATCH_WORDS or letters >= BATCH_LETTERS:
                    yield out(near_words(rows))
                    rows, letters = [], 0
                key, block = k, []
            block.append(tuple(row))
    if len(block) > 1:
        rows += block
    if rows:
        yield out(near_words(rows))


def near_report(words: DataFrame, scratch: Scratch, min_length: int = MIN_LENGTH,
                max_block: int = MAX_BLOCK) -> DataFrame:
    """``words(word, n)``, all different -> ``(word, n_near, best)`` of words
    with near words; ``best(minus_n, word)`` is the most frequent one."""
    parts = shuffle_partitions(words.sparkSession)
    rows = blocks(words, scratch, min_length, max_block)
    found = rows.select("key", "word", "n", "m", "a", "b").repartition(4 * parts, "key") \
        .sortWithinPartitions("key") \
        .mapInArrow(_search, "word string, n_near long, near_n long, near string")
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("minus_n"), F.col("near").alias("word"))).alias("best"))


def follow_forms(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``forms(word, form)`` -> ``(word, root)`` by pointer doubling.  A form is
    at least ``RATIO`` times as frequent as its word, so chains are short."""
    now = scratch.table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = scratch.table(now.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "roots")
        scratch.drop(now)
        now = new.select("word", "root")
        now.scratch_path = new.scratch_path
        if new.where("moved").first() is None:
            return now


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                      ratio: int = RATIO, max_block: int = MAX_BLOCK) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.table(vocabulary(docs, min_length, min_count), "words")
    near = near_report(words, scratch, min_length, max_block)
    good = -F.col("best.minus_n") >= F.lit(ratio) * F.col("n")
    rows = scratch.table(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("best.word")).alias("form"),
        F.when(good, -F.col("best.minus_n")).alias("form_n")), "forms")
    scratch.drop(words)
    roots = follow_forms(rows.where("form IS NOT NULL"), scratch)
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE_SQL = r"""
WITH RECURSIVE r AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM documents),
d AS (SELECT id, low, count(*) AS n, hex(id || ':' || low) AS x FROM r GROUP BY id, low),
c AS (
  SELECT low, n, xor(list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(range(1, length(x), 2),
      lambda i: ((strpos('0123456789ABCDEF', x[i]) - 1) * 16
                 + strpos('0123456789ABCDEF', x[i + 1]) - 1)::UBIGINT)),
    lambda acc, b: list_reduce(
      list_prepend(xor(acc, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
      lambda y, z: xor(y >> 1, (y & 1::UBIGINT) * 3988292384::UBIGINT))),
    4294967295::UBIGINT)::BIGINT AS h
  FROM d),
g AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(low, 1, h % length(low)) || substr(low, h % length(low) + 2)
              ELSE low END AS word, n FROM c),
v AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM g WHERE length(word) >= 7
  GROUP BY word HAVING sum(n) >= 2),
e AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM e a JOIN e b
    ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT e.word, v.word, v.n FROM e JOIN v ON e.rest = v.word
  UNION SELECT v.word, e.word, e.n FROM e JOIN v ON e.rest = v.word),
q AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS form,
         max(near_n) AS form_n FROM p GROUP BY word),
f AS (
  SELECT v.word, v.n, coalesce(q.n_near, 0) AS n_near,
         CASE WHEN q.form_n >= 10 * v.n THEN q.form END AS form,
         CASE WHEN q.form_n >= 10 * v.n THEN q.form_n END AS form_n
  FROM v LEFT JOIN q USING (word)),
t AS (
  SELECT word, word AS root, form AS ahead FROM f
  UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON t.ahead = f.word)
SELECT f.word, f.form, t.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM f JOIN t ON t.word = f.word AND t.ahead IS NULL
"""
