"""Bounded labelled samples on which the classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 150_000  # of a text that is learned from


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def smallest_hashes(rows: DataFrame, order: Column, wanted: int, total: int) -> DataFrame:
    """``rows`` with a hash ``order`` among the smallest of ``total`` rows: about
    twice ``wanted`` of them, so that a following top-k moves no more than
    these however many tasks there are."""
    share = min(1.0, 2 * (wanted + 100) / max(1, total))
    return rows.where(order <= F.lit(min(int(share * (1 << 64)) - (1 << 63), (1 << 63) - 1)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int,
                    learn_from: Column) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` documents of each label value, and the number of
    labelled rows of each value over the whole table.

    ``learn_from`` says of a ``doc_id`` column which rows may be learned from.
    The smallest seeded hashes of the ids are taken, so reruns agree.  Rows
    whose label is null or neither 0 nor 1 are not learned from, nor are texts
    of more than ``MAX_CHARS`` characters; of the rows that share an id one
    text is.  Returns ``(order, text, label)``, at most ``2 * per_class`` rows.
    """
    usable = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")) \
        .where(learn_from & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    totals = {r["label"]: r["n"] for r in
              usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    ids = None
    for value in sorted(totals):
        part = smallest_hashes(usable.where(F.col("label") == value).withColumn("order", order),
                               F.col("order"), per_class, totals[value]) \
            .orderBy("order", "doc_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    if ids is None:
        return docs.select(F.lit(0).cast("long").alias("order"), F.col("text"),
                           F.lit(0).alias("label")).where(F.lit(False)), {}
    found = docs.select("doc_id", "text") \
        .where(F.col("text").isNull() | (F.char_length("text") <= MAX_CHARS)) \
        .join(F.broadcast(ids), "doc_id")
    # one text per id, chosen where the rows are read: an id may be repeated in any
    # share of the rows
    one = found.groupBy("order", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return one.select("order", "text", "label"), totals
