"""Toxicity: a convolutional text classifier trained in numpy tasks.

A word's vector is the sum of the hashed embeddings of the word and of its
first letters.  Filters of several widths slide over the words, the maximum of
each over the text is a feature, and a logistic layer makes a probability of
them.  All labelled rows are learned from: a round trains the shared network
on every shard of them by itself, and the mean of the shards' changes is the
next round's network.  The decision thresholds are calibrated by language on
the fifth of the labelled rows that the training does not see; the language is
guessed from the text's own function words, never taken from a column.  The
calibration is part of the score: the threshold of every language lies at the
same score.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobtables.llm.sampling import labelled_sample, remainder

WORD_ROWS, PREFIX_ROWS, PREFIXES = 1 << 15, 1 << 13, (3, 4, 5)
DIM, FILTERS, WIDTHS = 24, 16, (1, 2, 3)
OFFSETS = sum(WIDTHS)  # one projection per width and place within it
CHUNK_WORDS = 200_000
SHARD_TEXTS = 8_192  # labelled texts that one task trains on in a round
BLOCK_ROWS = 160  # rows of the network that are averaged together
ID_BITS = 1 << 26  # of the filter for labelled ids, 8 MB
SCORE_BINS = 256
PUNCTUATION = string.punctuation + "“”‘’„«»‹›¿¡…–—"

# Frequent function words by language, none in two lists.
FUNCTION_WORDS = {
    "en": "the of and to is that it for with was are be this from have by not you",
    "de": "der die und das von zu auf den ein nicht ist mit dem sich für im eine auch",
    "fr": "le les des et du une dans pour qui sur pas au plus avec ce il sont aux",
    "es": "el los las y por con del una su al lo como más pero sus este ya muy",
}
LANGUAGES = (*FUNCTION_WORDS, "other")


@dataclass
class Texts:
    """Tokenised texts: distinct words' rows and each text's word numbers."""
    rows: np.ndarray  # distinct words x embedding rows
    language: np.ndarray  # of each distinct word, as a number of LANGUAGES
    ids: list[np.ndarray] = field(default_factory=list)

    def guess(self) -> np.ndarray:
        """Number of the language with the most function words of each text."""
        out = np.full(len(self.ids), len(LANGUAGES) - 1)
        for k, x in enumerate(self.ids):
            hits = np.bincount(self.language[x], minlength=len(LANGUAGES))[:-1]
            if hits.any():
                out[k] = hits.argmax()
        return out


_LANGUAGE_OF = {w: k for k, ws in enumerate(FUNCTION_WORDS.values()) for w in ws.split()}


_PREFIX_STARTS = [(n, zlib.crc32(f"{n}:".encode())) for n in PREFIXES]


def _hashes(w: str) -> list[int]:
    """CRC-32 of a word, and of its first letters after their number."""
    b = w.encode("utf-8", "surrogatepass")
    if len(b) == len(w):
        return [zlib.crc32(b), *[zlib.crc32(b[:n], start) for n, start in _PREFIX_STARTS]]
    return [zlib.crc32(b), *[zlib.crc32(w[:n].encode("utf-8", "surrogatepass"), start)
                             for n, start in _PREFIX_STARTS]]


def tokenise(texts: list[str | None]) -> Texts:
    number: dict[str, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in (t or "").lower().split()], np.int64)
           for t in texts]
    bare = [w.strip(PUNCTUATION) for w in number]
    rows = np.array([h for w in bare for h in _hashes(w)], np.int64).reshape(-1, 1 + len(PREFIXES))
    rows[:, 0] %= WORD_ROWS
    rows[:, 1:] = WORD_ROWS + rows[:, 1:] % PREFIX_ROWS
    other = len(LANGUAGES) - 1
    return Texts(rows, np.array([_LANGUAGE_OF.get(w, other) for w in bare], np.int64), ids)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of the texts that are tokenised together."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or "") <= 8 * CHUNK_WORDS):
            size += len(texts[to] or "")
            to += 1
        yield at, to
        at = to


def _pieces(ids: list[np.ndarray]) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of pieces (text, first word, windows) of about ``CHUNK_WORDS`` words;
    no list has two pieces of one text."""
    out, size = [], 0
    for d, x in enumerate(ids):
        for at in range(0, max(1, len(x)), CHUNK_WORDS):
            n = max(1, min(len(x) - at, CHUNK_WORDS))
            out.append((d, at, n))
            size += n
            if size >= CHUNK_WORDS:
                yield out
                out, size = [], 0
    if out:
        yield out


@dataclass
class ConvModel:
    embedding: np.ndarray
    filters: np.ndarray  # DIM x OFFSETS x FILTERS
    bias: np.ndarray  # widths x filters
    out: np.ndarray  # widths * filters
    out_bias: float
    thresholds: np.ndarray  # by language, on the raw probability
    at: float = 0.3  # the score of every threshold

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        out = self.embedding[rows[:, 0]]
        for column in range(1, rows.shape[1]):
            out = out + self.embedding[rows[:, column]]
        return out

    def pooled(self, t: Texts, arg: bool = False):
        """Features before the rectifier (texts x widths x filters) and, if
        asked for, the word each maximum starts at.  Whole texts, in slices."""
        vectors = np.concatenate([self.vectors(t.rows), np.zeros((1, DIM), np.float32)])
        pad = len(vectors) - 1  # the last: padding
        proj = [vectors @ np.ascontiguousarray(self.filters[:, o]) for o in range(OFFSETS)]
        best = np.full((len(t.ids), len(WIDTHS), FILTERS), -np.inf, np.float32)
        where = np.zeros(best.shape, np.int64)
        widest = max(WIDTHS) - 1
        padding = np.full(1 + widest, pad)
        for pieces in _pieces(t.ids):
            docs = np.array([d for d, _at, _n in pieces])
            ats, n = np.array([(at, n) for _d, at, n in pieces]).T
            parts = []
            for d, at, size in pieces:
                part = t.ids[d][at:at + size + widest]
                parts += [part, padding[:size + widest - len(part)]]
            x = np.concatenate([*parts, padding])
            starts = np.concatenate([[0], np.cumsum(n + widest)[:-1]])
            bounds = np.stack([starts, starts + n], axis=1).ravel()
            if arg:
                piece = np.repeat(np.arange(len(pieces)), n + widest)
                inside = np.arange(len(piece)) - starts[piece] < n[piece]
                piece, inside = piece[inside], np.flatnonzero(inside)
            first = 0
            for k, width in enumerate(WIDTHS):
                y = proj[first][x]
                for o in range(1, width):
                    y[:-o] += proj[first + o][x[o:]]
                top = np.maximum.reduceat(y, bounds, axis=0)[::2]
                if arg:
                    hit, f = np.nonzero(y[inside] == top[piece])
                    i = np.zeros(top.shape, np.int64)
                    # of equal maxima the first: it is written last
                    i[piece[hit[::-1]], f[::-1]] = inside[hit[::-1]]
                    better = top > best[docs, k]
                    at = ats[:, None] + i - starts[:, None]
                    where[docs, k] = np.where(better, at, where[docs, k])
                best[docs, k] = np.maximum(best[docs, k], top)
                first += width
        return (best, where) if arg else best

    def probabilities(self, t: Texts) -> np.ndarray:
        h = np.maximum(self.pooled(t) + self.bias, 0).reshape(len(t.ids), -1)
        return 1 / (1 + np.exp(-np.clip(h.astype(float) @ self.out + self.out_bias, -30, 30)))

    def _calibrated(self, p: np.ndarray, language: np.ndarray) -> np.ndarray:
        cut = self.thresholds[language]
        return np.where(p < cut, p * self.at / cut, self.at + (p - cut) * (1 - self.at) / (1 - cut))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for at, to in _slices(texts):
            t = tokenise(texts[at:to])
            out[at:to] = self._calibrated(self.probabilities(t), t.guess())
        return out


def _new_model(rng: np.random.Generator) -> ConvModel:
    normal = lambda *shape: rng.standard_normal(shape).astype(np.float32)
    return ConvModel(0.1 * normal(WORD_ROWS + PREFIX_ROWS, DIM),
                     normal(DIM, OFFSETS, FILTERS) / np.float32(np.sqrt(DIM)),
                     np.zeros((len(WIDTHS), FILTERS), np.float32),
                     0.1 * rng.standard_normal(len(WIDTHS) * FILTERS), 0.0,
                     np.full(len(LANGUAGES), 0.5))


@dataclass
class Trainer:
    """A network and the sums of squared gradients by which Adagrad divides."""
    model: ConvModel
    seen: dict[str, np.ndarray]

    DENSE = ("filters", "bias", "out", "out_bias")

    @classmethod
    def new(cls, seed: int) -> Trainer:
        m = _new_model(np.random.default_rng(seed))
        return cls(m, {n: np.full(np.shape(getattr(m, n)), 1e-6) for n in cls.DENSE}
                   | {"rows": np.full(len(m.embedding), 1e-6)})

    def pack(self) -> np.ndarray:
        """All numbers as a table of DIM + 1 columns, embeddings first."""
        m = self.model
        dense = np.concatenate([np.ravel(v) for n in self.DENSE
                                for v in (getattr(m, n), self.seen[n])])
        dense = np.pad(dense, (0, -len(dense) % (DIM + 1))).reshape(-1, DIM + 1)
        return np.concatenate([np.column_stack([m.embedding, self.seen["rows"]]), dense]) \
            .astype(np.float32)

    def unpack(self, table: np.ndarray) -> None:
        m, k = self.model, len(self.model.embedding)
        m.embedding = np.array(table[:k, :DIM], np.float32)
        self.seen["rows"] = table[:k, DIM].astype(float)
        dense, at = table[k:].ravel(), 0
        for n in self.DENSE:
            old = np.asarray(getattr(m, n))
            setattr(m, n, dense[at:at + old.size].reshape(old.shape).astype(old.dtype))
            at += old.size
            self.seen[n] = dense[at:at + old.size].reshape(old.shape).astype(float)
            at += old.size
        m.out_bias = float(m.out_bias)

    def _step(self, name: str, g, rate: float) -> None:
        self.seen[name] = self.seen[name] + g * g
        old = getattr(self.model, name)
        new = old - rate * g / np.sqrt(self.seen[name])
        setattr(self.model, name, new.astype(old.dtype) if isinstance(old, np.ndarray) else float(new))

    def step(self, t: Texts, y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """Adagrad on the weighted logistic loss of one batch.  Only the words
        at the maxima get a gradient, so a step touches few rows."""
        m = self.model
        top, where = m.pooled(t, arg=True)
        h = np.maximum(top + m.bias, 0)
        flat = h.reshape(len(y), -1).astype(float)
        p = 1 / (1 + np.exp(-np.clip(flat @ m.out + m.out_bias, -30, 30)))
        err = (p - y) * weight / len(y)
        dh = np.outer(err, m.out).reshape(h.shape) * (h > 0)
        length = np.array([len(x) for x in t.ids])
        start = np.concatenate([[0], np.cumsum(length)[:-1]])
        words = np.concatenate([*t.ids, np.zeros(1, np.int64)]).astype(np.int64)
        g_filters = np.zeros(m.filters.shape)
        touched, g_words, first = [], [], 0
        for k, width in enumerate(WIDTHS):
            for o in range(width):
                pos = where[:, k] + o
                d, f = np.nonzero((pos < length[:, None]) & (dh[:, k] != 0))
                w, g = words[start[d] + pos[d, f]], dh[d, k, f][:, None]
                part = m.vectors(t.rows[w]) * g
                for column in range(FILTERS):
                    g_filters[:, first + o, column] = part[f == column].sum(axis=0)
                touched.append(w)
                g_words.append(m.filters[:, first + o].T[f] * g)
            first += width
        touched, g_words = np.concatenate(touched), np.concatenate(g_words)
        self._step("out", flat.T @ err, rate)
        self._step("bias", dh.sum(axis=0), rate)
        self._step("filters", g_filters, rate)
        self._step("out_bias", err.sum(), rate)
        if not len(touched):
            return
        for column in range(t.rows.shape[1]):
            at = t.rows[touched, column]
            order = np.argsort(at, kind="stable")
            rows, cuts = np.unique(at[order], return_index=True)
            g = np.add.reduceat(g_words[order], cuts, axis=0)
            self.seen["rows"][rows] += (g * g).mean(axis=1)
            m.embedding[rows] -= (rate * g / np.sqrt(self.seen["rows"][rows])[:, None]).astype(np.float32)


def _encoded(t: Texts) -> list[tuple[bytes, bytes]]:
    """Each text's own distinct words' rows and its words' numbers among them."""
    out = []
    for x in t.ids:
        used, ids = np.unique(x, return_inverse=True)
        out.append((t.rows[used].astype(np.uint16).tobytes(),
                    ids.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32).tobytes()))
    return out


def _decoded(rows: list[bytes], ids: list[bytes]) -> Texts:
    """The texts of ``_encoded`` without their languages."""
    parts, out, at = [], [], 0
    for r, x in zip(rows, ids):
        part = np.frombuffer(r, np.uint16).reshape(-1, 1 + len(PREFIXES))
        out.append(np.frombuffer(x, np.uint16 if len(part) <= 1 << 16 else np.uint32)
                   .astype(np.int64) + at)
        parts.append(part)
        at += len(part)
    table = np.concatenate(parts).astype(np.int64) if parts else np.zeros((0, 1 + len(PREFIXES)), np.int64)
    return Texts(table, np.zeros(0, np.int64), out)


def _odds(v: float) -> float:
    v = np.clip(v, 1e-6, 1 - 1e-6)
    return np.log(v / (1 - v))


def _cut(p: float, below: float | None) -> float:
    """Half way (in log odds) from a score to the next lower one."""
    low = _odds(p) - 2 if below is None else _odds(below)
    return float(np.clip(1 / (1 + np.exp(-(_odds(p) + low) / 2)), 1e-3, 1 - 1e-3))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut of the best F1, half way (in log odds) to the next lower score."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = -1  # equal scores fall on one side
    k = int(f1.argmax())
    return _cut(p[k], p[k + 1] if k + 1 < len(p) else None)


def best_thresholds(scored: DataFrame, bins: int = SCORE_BINS) -> dict[int, tuple[float, int, int]]:
    """``best_threshold`` of all rows ``(language, p, label)`` by language, and
    of all languages as number -1: ``(cut, positives, rows)`` of each.

    Rows are counted by score and added up within bins of about equally many
    scores; only the bins' totals and each group's cut leave the tasks.
    """
    counts = scored.select(F.explode(F.array(F.col("language"), F.lit(-1))).alias("g"), "p", "label") \
        .groupBy("g", "p").agg(F.count("*").alias("n"), F.sum("label").alias("hits"))
    shares = [i / bins for i in range(1, bins)]
    edges = sorted(set(scored.approxQuantile("p", shares, 0.25 / bins))) if shares else []
    number = F.aggregate(F.array(*[F.lit(e) for e in edges]), F.lit(0),
                         lambda a, e: a + (F.col("p") >= e).cast("int")) if edges else F.lit(0)
    counts = counts.withColumn("bin", number)
    down = Window.partitionBy("g").orderBy(F.desc("bin"))
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("g", "bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"),
                                            F.max("p").alias("top"))
    whole = Window.partitionBy("g")
    totals = totals.select(
        "g", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("hits").over(before), F.lit(0)).alias("hits_before"),
        F.lead("top").over(down).alias("next_top"), F.sum("n").over(whole).alias("n_all"),
        F.sum("hits").over(whole).alias("hits_all"))
    inside = Window.partitionBy("g", "bin").orderBy(F.desc("p"))
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    f1 = 2 * (F.col("hits_before") + F.sum("hits").over(so_far)) \
        / (F.col("n_before") + F.sum("n").over(so_far) + F.col("hits_all"))
    rows = counts.join(F.broadcast(totals), ["g", "bin"]).select(
        "g", "p", "n_all", "hits_all", f1.alias("f1"),
        F.coalesce(F.lead("p").over(inside), F.col("next_top")).alias("below"))
    best = rows.groupBy("g", "n_all", "hits_all") \
        .agg(F.max(F.struct("f1", "p", "below")).alias("best")).collect()
    return {r.g: (_cut(r.best.p, r.best.below), r.hits_all, r.n_all) for r in best}


def learnable_texts(docs: DataFrame, labels: DataFrame, label: str, learn_from: Column,
                    ) -> tuple[DataFrame, int]:
    """All documents with a label of 0 or 1 whose id may be learned from, as
    ``(order, label, text)``, and the number of their labels.

    Of the rows that share an id one text is taken; an id with both labels has
    a row of each.  A filter of hashed ids keeps most other texts from the join.
    """
    usable = labels.select("doc_id", F.col(label).cast("int").alias("label")) \
        .where(learn_from & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).distinct()
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS))
    marked = usable.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("bits", F.floor(place / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    one = docs.select("doc_id", "text").where(learn_from) \
        .withColumn("bucket", F.bitmap_bucket_number(bit)) \
        .join(F.broadcast(marked), "bucket") \
        .where(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0) \
        .groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    # chosen where the rows are read: an id may be repeated in any share of the rows
    rows = one.join(usable, "doc_id") \
        .select(F.xxhash64(F.lit("sample"), F.col("doc_id")).alias("order"), "label", "text")
    return rows, usable.count()


def _tokenised(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            for at, to in _slices(texts):
                t = tokenise(texts[at:to])
                words, ids = zip(*_encoded(t))
                yield b.iloc[at:to, :2].assign(language=t.guess(), words=words, ids=ids)

    return rows.mapInPandas(run, "order long, label int, language int, words binary, ids binary")


def _round(tokens: DataFrame, start: np.ndarray, weights: tuple[float, float], rate: float,
           batch: int, seed: tuple[int, int]) -> np.ndarray:
    """The packed network after every shard has trained ``start`` on its rows:
    each row of numbers changes by the mean over the shards that touched it."""
    shared = tokens.sparkSession.sparkContext.broadcast(start)

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng([*seed, part])
        trainer = Trainer.new(0)
        trainer.unpack(shared.value)
        trained = False
        for b in batches:
            y, words, ids = b["label"].to_numpy(float), b["words"].tolist(), b["ids"].tolist()
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                pick = order[at:at + batch]
                t = _decoded([words[k] for k in pick], [ids[k] for k in pick])
                trainer.step(t, y[pick], np.where(y[pick] > 0, weights[1], weights[0]), rate)
                trained = True
        if trained:
            change = trainer.pack() - shared.value
            moved = change.any(axis=1)
            moved[len(trainer.model.embedding):] = True
            rows = np.flatnonzero(moved).astype(np.int32)
            cuts = np.flatnonzero(np.diff(rows // BLOCK_ROWS)) + 1
            yield pd.DataFrame([(int(r[0]) // BLOCK_ROWS, part, r.tobytes(), change[r].tobytes())
                                for r in np.split(rows, cuts)],
                               columns=["block", "part", "rows", "change"])

    def mean(parts: pd.DataFrame) -> pd.DataFrame:
        total, n = np.zeros((BLOCK_ROWS, DIM + 1)), np.zeros(BLOCK_ROWS, np.int64)
        block = int(parts["block"].iloc[0])
        parts = parts.sort_values("part")
        for r, c in zip(parts["rows"], parts["change"]):
            at = np.frombuffer(r, np.int32) - block * BLOCK_ROWS
            total[at] += np.frombuffer(c, np.float32).reshape(-1, DIM + 1)
            n[at] += 1
        at = np.flatnonzero(n)
        out = (total[at] / n[at, None]).astype(np.float32)
        return pd.DataFrame([(block, 0, (at + block * BLOCK_ROWS).astype(np.int32).tobytes(),
                              out.tobytes())], columns=["block", "part", "rows", "change"])

    schema = "block int, part int, rows binary, change binary"
    out = start.copy()
    for r in tokens.select("label", "words", "ids").mapInPandas(train, schema)             .groupBy("block").applyInPandas(mean, schema).collect():
        out[np.frombuffer(r.rows, np.int32)] += np.frombuffer(r.change, np.float32).reshape(-1, DIM + 1)
    shared.destroy()
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int | None = None,
        held_out: tuple[int, int] = (4, 2), epochs: int = 6, rate: float = 0.05, batch: int = 64,
        least_positives: int = 20, threshold: float = 0.3, seed: int = 11,
        shard_texts: int = SHARD_TEXTS) -> ConvModel | None:
    """Fit on all labelled rows, none of whose crc32(id) leaves the remainder
    ``held_out[1]`` modulo ``held_out[0]``; a fifth of them, by the hash of the
    id, calibrates and the others train, ``epochs`` times over.  A language
    with fewer than ``least_positives`` toxic rows there gets the common
    threshold.  None if a class has no rows.  A caller that wants a quick
    network may ask for at most ``per_class`` rows of each class.
    """
    learn_from = remainder(F.col("doc_id"), held_out[0]) != held_out[1]
    if per_class is None:
        rows, n = learnable_texts(docs, labels, label, learn_from)
    else:
        rows, n = labelled_sample(docs, labels, label, per_class, learn_from)[0], 2 * per_class
    rows = rows.select("order", "label", "text")
    tokens = _tokenised(rows.coalesce(max(1, -(-n // shard_texts)))) \
        .withColumn("back", F.pmod(F.xxhash64(F.lit("back"), F.col("order")), F.lit(5)) == 4) \
        .sortWithinPartitions("order", "label").persist(StorageLevel.DISK_ONLY)
    try:
        count = {(r.label, r.back): r["count"] for r in tokens.groupBy("label", "back").count().collect()}
        if {v for v, _back in count} != {0, 1}:
            return None
        whole = (0, False) not in count or (1, False) not in count  # too few to keep any back
        learn = tokens if whole else tokens.where(~F.col("back"))
        share = [sum(k for (v, back), k in count.items() if v == value and (whole or not back))
                 for value in (0, 1)]
        weights = tuple(0.5 * sum(share) / k for k in share)
        trainer = Trainer.new(seed)
        table = trainer.pack()
        for epoch in range(epochs):
            table = _round(learn, table, weights, rate, batch, (seed, epoch))
        trainer.unpack(table)
        model = trainer.model
        model.at = threshold
        if not whole and (1, True) in count:
            cuts = best_thresholds(_scored(tokens.where("back"), model))
            model.thresholds[:] = cuts[-1][0]
            for k, (cut, positives, n) in cuts.items():
                if k >= 0 and positives >= least_positives and positives < n:
                    model.thresholds[k] = cut
        return model
    finally:
        tokens.unpersist()


def _scored(tokens: DataFrame, model: ConvModel) -> DataFrame:
    """``(language, p, label)`` of tokenised rows; p is the raw probability."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                c = b.iloc[at:at + 256]
                t = _decoded(c["words"].tolist(), c["ids"].tolist())
                yield c[["language", "label"]].assign(p=shared.value.probabilities(t))

    return tokens.select("language", "label", "words", "ids") \
        .mapInPandas(run, "language int, label int, p double")


def score(text: Column, model: ConvModel | None, spark: SparkSession) -> Column:
    """Score of a text column in 0..1, higher: toxic likelier.

    Null, empty and blank texts have the score of a text of padding only;
    without a model every score is 0.
    """
    if model is None:
        return F.lit(0.0)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores(texts.tolist()))

    return run(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3,
             held_out: tuple[int, int] = (4, 2), **fitting) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Repeated rows and ids give a row each; columns other than the id and text
    are not read; an empty table gives no rows.
    """
    model = fit(docs, labels, held_out=held_out, threshold=threshold, **fitting)
    scored = docs.select("doc_id", score(F.col("text"), model, docs.sparkSession).alias("score"))
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), held_out[0]) == held_out[1]).alias("held_out"),
        "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
