"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text becomes counts of hashed byte trigrams, of trigrams of byte classes
(lower case, upper case, digit, blank, kinds of punctuation) and of words that
repeat the word before them.  A truncated SVD of the weighted counts of a
bounded labelled sample gives the latent space; the sample's vectors and
labels are broadcast (their size is fixed by the parameters) and every
document is compared with all of them in blocks of exact cosine products.  The
nearest ones vote with their labels, weighted by similarity and by how many
labelled rows of their class each stands for.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtables.llm.sampling import labelled_sample, remainder

N_CLASSES, N_HASHED, N_REPEAT = 12, 2048, 2
WEIGHTS = (1.0, 0.6, 1.0)  # of the three blocks: classes, bytes, repetition
N_TERMS = N_CLASSES ** 3 + N_HASHED + N_REPEAT
_CHUNK = 256  # documents whose terms are held at once


def _byte_classes() -> np.ndarray:
    table = np.full(256, 11, np.int64)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                               b"0123456789", b" ", b"\n\r\t\x0b\x0c", b".", b",;:", b"!?",
                               b"'\"()[]{}<>", b"|-_/\\", b"#$%&*+=@^~`")):
        table[np.frombuffer(chars, np.uint8)] = k
    table[128:] = 0  # letters beyond ASCII
    return table


_CLASS = _byte_classes()


def _unit(v: np.ndarray, weight: float) -> np.ndarray:
    norm = np.sqrt(v @ v)
    return v * (weight / norm) if norm else v


def terms(text: str | None) -> np.ndarray:
    """Term weights of one text; all zero for a null or empty one."""
    out = np.zeros(N_TERMS, np.float32)
    if not text:
        return out
    b = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", np.uint8)
    c = _CLASS[b]
    shape = (c[:-2] * N_CLASSES + c[1:-1]) * N_CLASSES + c[2:]
    low = np.where((b >= 65) & (b <= 90), b + 32, b).astype(np.uint32)
    gram = (((low[:-2] << 16) | (low[1:-1] << 8) | low[2:]) * np.uint32(2654435761)) >> 21
    words = text.split()
    same = sum(map(operator.eq, words, islice(words, 1, None)))
    a = N_CLASSES ** 3
    out[:a] = _unit(np.log1p(np.bincount(shape, minlength=a)), WEIGHTS[0])
    out[a:a + N_HASHED] = _unit(np.log1p(np.bincount(gram, minlength=N_HASHED)), WEIGHTS[1])
    out[a + N_HASHED:] = _unit(np.array([same, max(len(words) - same, 0)], float), WEIGHTS[2])
    return out


@dataclass
class NeighbourModel:
    """Latent vectors of the labelled sample; a few MB whatever the corpus."""
    idf: np.ndarray
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # sample x dimensions, unit length
    labels: np.ndarray
    weights: np.ndarray  # labelled rows that one sample row stands for
    prior: float  # share of label 1, for texts without neighbours
    neighbours: int
    power: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for at in range(0, len(texts), _CHUNK):
            x = np.stack([terms(t) for t in texts[at:at + _CHUNK]])
            out[at:at + _CHUNK] = self._vote(_latent(x * self.idf, self.axes))
        return out

    def _vote(self, x: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), self.prior)
        sims = x @ self.vectors.T
        k = min(self.neighbours, sims.shape[1])
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        # of equally near neighbours at the k-th place the first of the sample count
        least = np.take_along_axis(sims, near, 1).min(axis=1, keepdims=True)
        for row in np.flatnonzero((sims >= least).sum(axis=1) > k):
            near[row] = np.argsort(-sims[row], kind="stable")[:k]
        w = np.maximum(np.take_along_axis(sims, near, 1), 0.0).astype(float) ** self.power
        w *= self.weights[near]
        total = w.sum(axis=1)
        vote = (w * self.labels[near]).sum(axis=1)
        return np.where(total > 0, vote / np.where(total > 0, total, 1), self.prior)


def _latent(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    z = x @ axes
    norm = np.linalg.norm(z, axis=1, keepdims=True)
    return (z / np.where(norm > 0, norm, 1)).astype(np.float32)


def _principal_axes(x: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """Leading right singular vectors by seeded subspace iteration."""
    dims = min(dims, *x.shape)
    y = x @ np.random.default_rng(seed).standard_normal((x.shape[1], dims + 16)).astype(np.float32)
    for _ in range(5):
        q, _r = np.linalg.qr(y)
        y = x @ (x.T @ q)
    q, _r = np.linalg.qr(y)
    _u, _s, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    return np.ascontiguousarray(vt[:dims].T, np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2000,
        held_out: tuple[int, int] = (5, 0), dims: int = 64, neighbours: int = 25,
        power: float = 4.0, seed: int = 7) -> NeighbourModel:
    """Fit on at most ``per_class`` labelled rows of each class, none of whose
    crc32(id) leaves the remainder ``held_out[1]`` modulo ``held_out[0]``.

    Without labelled rows every score is the prior, then 0.5.
    """
    modulus, rest = held_out
    sample, totals = labelled_sample(docs, labels, label, per_class,
                                     remainder(F.col("doc_id"), modulus) != rest)

    @F.pandas_udf("binary")
    def as_terms(texts: pd.Series) -> pd.Series:
        return pd.Series([terms(t).astype(np.float16).tobytes() for t in texts])

    rows = sample.select("order", "label", as_terms("text").alias("x")).toPandas() \
        .sort_values(["order", "label"], kind="stable")
    y = rows["label"].to_numpy(float)
    prior = totals.get(1, 0) / max(1, sum(totals.values())) if totals else 0.5
    if not len(y):
        return NeighbourModel(np.ones(N_TERMS, np.float32), np.zeros((N_TERMS, 1), np.float32),
                              np.zeros((0, 1), np.float32), y, y, prior, neighbours, power)
    x = np.stack([np.frombuffer(v, np.float16) for v in rows["x"]]).astype(np.float32)
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    x *= idf
    axes = _principal_axes(x, dims, seed)
    stands_for = np.array([totals[int(v)] / (y == v).sum() for v in y])
    return NeighbourModel(idf, axes, _latent(x, axes), y, stands_for, prior, neighbours, power)


def score(text: Column, model: NeighbourModel, spark: SparkSession) -> Column:
    """Score of a text column in 0..1, higher: label 1 likelier.

    Null, empty and blank texts have the share of label 1 (or the vote of
    blank neighbours) as their score.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.scores(texts.tolist()))

    return run(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3,
             held_out: tuple[int, int] = (5, 0), **fitting) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Repeated rows and ids give a row each; other columns are not read, so
    their names do not matter; an empty table gives no rows.
    """
    model = fit(docs, labels, held_out=held_out, **fitting)
    scored = docs.select("doc_id", score(F.col("text"), model, docs.sparkSession).alias("score"))
    return scored.select(
        "doc_id", (remainder(F.col("doc_id"), held_out[0]) == held_out[1]).alias("held_out"),
        "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **fitting) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns."""
    model = fit(docs, labels, **fitting)
    return docs.where(score(F.col("text"), model, docs.sparkSession) >= threshold)
