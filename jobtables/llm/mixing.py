"""Mixing sources to target weights by capped water-filling.

The sources share ``total_share`` of all words by weight.  A source whose part
exceeds ``max_epochs`` times its words is clamped there and the excess goes to
the others by weight, again and again until none is above.  A source's target
divided by its words is its number of repetitions: whole ones for all its
documents, and for the rest a seeded sample.

The sample takes documents in the order of a seeded hash as long as they fit
into what is left.  A round's outcome is one place in that order per source, so
no row needs a rank of its own: words are summed by source and hash prefix
first, and only the prefix in which a source fills up is looked at row by row.
Further rounds fill what is left with documents that are small enough, until
less than ``slack`` of the target is left or no document fits any more.

Rows with equal id and text are copies, counted as one row with a multiplicity;
a round may take some of them.  They are numbered only in the end, and only
where a source's sample holds some of a document's copies but not all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtables.llm.shared import Scratch
from jobtables.operators.ordered import global_row_number, running_sums

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SLACK = 1e-3
_PREFIXES = (2, 4)  # hexadecimal digits of the hash that name a bucket
_ALL = "g"  # after every key


def word_count(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))


def order_key(doc_id: Column, size: Column, text: Column, seed: int) -> Column:
    """Seeded order of documents: by the hash of the id, then size and text."""
    seeded = F.concat(F.lit(f"mix-{seed}-"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.concat(F.md5(seeded.cast("binary")), F.lpad(size.cast("string"), 20, "0"),
                    F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def water_level(sources: DataFrame, total_share: float, max_epochs: float) -> float:
    """Words per unit of weight, such that a source's target is that times its
    weight, or its cap if that is smaller (``sources(skey, source_size,
    weight)``).

    In the order of cap per weight, clamping everything before a source gives
    one level each; the largest is the one at which clamping ends.
    """
    capped = sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))) \
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    upto = running_sums(capped, [], ["ratio", "skey"], {"caps": F.col("cap"), "weights": F.col("weight")})
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("size"),
                        F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    fixed = F.col("caps") - F.col("cap")
    still_open = F.lit(total["weight"]) - (F.col("weights") - F.col("weight"))
    level = upto.agg(F.max((F.lit(float(total["size"])) * F.lit(float(total_share)) - fixed)
                           / still_open)).first()[0]
    return max(level or 0.0, 0.0)


def _taken(copies: Column, rounds: Column) -> Column:
    """How many of ``copies`` of a document the rounds take."""
    def add(n: Column, r: Column) -> Column:
        fits = (F.col("size") > 0) & (F.col("size") <= r["rest"])
        here = F.when(F.col("key") < r["upto"], copies - n) \
            .when(F.col("key") == r["upto"], F.least(r["copies"], copies - n)).otherwise(0)
        return n + F.when(fits, here).otherwise(0)
    return F.aggregate(rounds, F.lit(0).cast("long"), add)


def mixing_plan(docs: DataFrame, scratch: Scratch, weights: Sequence[float] = WEIGHTS,
                total_share: float = 1.5, max_epochs: float = 2.0, seed: int = 7,
                slack: float = SLACK) -> tuple[DataFrame, DataFrame]:
    """``(plan, partial)``.  Per source: ``skey, source_size, target, whole``
    and the rounds ``(rest, upto, copies)``: all open documents before ``upto``
    are taken, and ``copies`` of that one.  Per document of which some copies
    are taken and some are not: ``skey, key, chosen`` (at most one a round).

    Sources are weighed in the order of their code points, null last.
    """
    size = word_count(F.col("text"))
    rows = docs.select("doc_id", "source", "text", size.alias("size")).select(
        source_key(F.col("source")).alias("skey"), "source", "size",
        order_key(F.col("doc_id"), F.col("size"), F.col("text"), seed).alias("key"))
    groups = scratch.table(
        rows.groupBy("skey", "key").agg(F.first("source").alias("source"), F.first("size").alias("size"),
                                        F.count("*").alias("copies")), "groups")
    sums = groups.groupBy("skey").agg(F.first("source").alias("source"),
                                      F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    sums = scratch.table(sums.withColumn("missing", F.col("source").isNull()), "sums")
    ranked = global_row_number(sums, ["missing", "source"])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          ((F.col("rn") - 1) % len(weights) + 1).cast("int"))
    sources = scratch.table(ranked.select("skey", "source_size", weight.alias("weight")), "sources")
    level = water_level(sources, total_share, max_epochs)
    target = F.least(F.col("source_size") * F.lit(float(max_epochs)),
                     F.lit(level) * F.col("weight"))
    plan = scratch.table(
        sources.select("skey", "source_size", target.alias("target"))
        .withColumn("whole", F.when(F.col("source_size") > 0,
                                    F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("rounds", F.array().cast("array<struct<rest:double,upto:string,copies:bigint>>")),
        "plan")
    while True:
        old, plan = plan, scratch.table(_fill(groups, plan, slack), "plan")
        scratch.drop(old)
        if plan.where("moved").first() is None:
            break
    partial = groups.join(plan, "skey").withColumn("chosen", _taken(F.col("copies"), F.col("rounds"))) \
        .where("chosen > 0 AND chosen < copies").select("skey", "key", "chosen")
    partial = scratch.table(partial, "partial")
    scratch.drop(groups, sums, sources)
    return plan.drop("rest", "moved"), partial


def _fill(groups: DataFrame, plan: DataFrame, slack: float) -> DataFrame:
    """One more round for every source that has more than ``slack`` of its
    target left and a document that fits; ``moved``: whether it has taken one."""
    left = F.col("copies") - _taken(F.col("copies"), F.col("rounds"))
    open_rows = groups.select("skey", "size", "key", "copies") \
        .join(plan.where(F.col("rest") > F.col("target") * F.lit(slack)), "skey") \
        .where((F.col("size") > 0) & (F.col("size") <= F.col("rest"))).withColumn("left", left) \
        .where("left > 0").select("skey", "key", "size", (F.col("size") * F.col("left")).alias("words"),
                                  "rest")
    sums = open_rows.groupBy("skey").agg(F.sum("words").alias("all_words"))
    # the hash prefix in which a source fills up, a few digits at a time
    inside, full = open_rows.withColumn("before", F.lit(0).cast("long")), None
    for digits in _PREFIXES:
        cut = F.substring("key", 1, digits).alias("bucket")
        per_bucket = inside.groupBy("skey", cut).agg(
            F.sum("words").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy("skey").orderBy("bucket"))
        full = per_bucket.withColumn("upto", upto).where(F.col("upto") > F.col("rest")) \
            .groupBy("skey").agg(F.min_by(
                F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")), "bucket")
                .alias("b")).select("skey", F.col("b.bucket").alias("bucket"), "b.before")
        inside = open_rows.select("*", cut).join(full, ["skey", "bucket"]).drop("bucket")
    # the document at which it is full, and how many of its copies still fit
    before = F.col("before") + F.sum("words").over(Window.partitionBy("skey").orderBy("key")) - F.col("words")
    fit = F.floor((F.col("rest") - F.col("before_key")) / F.col("size"))
    last = inside.withColumn("before_key", before) \
        .where(F.col("before_key") + F.col("words") > F.col("rest")).withColumn("fit", fit) \
        .groupBy("skey").agg(F.min_by(F.struct("key", "fit", (
            F.col("before_key") + F.col("fit") * F.col("size")).alias("filled")), "key").alias("l"))
    joined = plan.drop("moved").join(sums, "skey", "left").join(last, "skey", "left")
    none_open, all_fit = F.col("all_words").isNull(), F.col("l").isNull()
    taken = F.when(none_open, F.lit(0)).when(all_fit, F.col("all_words")).otherwise(F.col("l.filled"))
    entry = F.struct(F.col("rest").cast("double").alias("rest"),
                     F.coalesce("l.key", F.lit(_ALL)).alias("upto"),
                     F.coalesce("l.fit", F.lit(0)).cast("long").alias("copies"))
    return joined.select(
        "skey", "source_size", "target", "whole", (F.col("rest") - taken).alias("rest"),
        F.when(none_open, F.col("rounds")).otherwise(F.concat("rounds", F.array(entry))).alias("rounds"),
        (taken > 0).alias("moved"))


def _with_plan(docs: DataFrame, seed: int, **params) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "mixing")
    plan, partial = mixing_plan(docs, scratch, seed=seed, **params)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       word_count(F.col("text")).alias("size"),
                       source_key(F.col("source")).alias("skey"))
    rows = rows.withColumn("key", order_key(F.col("row.doc_id"), F.col("size"), F.col("row.text"), seed))
    # of a document all copies are taken, unless it is a partial one
    one = F.lit(1).cast("long")
    planned = rows.join(plan, "skey")

    def timed(df: DataFrame, chosen: Column) -> DataFrame:
        return df.select("row", "size", "source_size", "target",
                         (F.col("whole") + F.when(chosen, 1).otherwise(0)).alias("times"))
    if partial.first() is None:
        return timed(planned, _taken(one, F.col("rounds")) > 0)
    some = ["skey", "key"]
    whole = timed(planned.join(partial, some, "left_anti"), _taken(one, F.col("rounds")) > 0)
    copies = scratch.table(planned.join(partial, some).withColumn(
        "copy", F.monotonically_increasing_id()), "copies")
    numbered = global_row_number(copies, ["copy"], "number", keys=some)
    return whole.unionByName(timed(numbered, F.col("number") <= F.col("chosen")))


def mix(docs: DataFrame, seed: int = 7, **params) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken``.

    Texts that are null, empty or blank have no words and nothing of them is
    taken; null is a source of its own; rows with equal id and text are copies,
    of which the mix may take some; an empty table gives no rows.
    """
    return _with_plan(docs, seed, **params).select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("times")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, seed: int = 7, **params) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; all columns."""
    times = F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))
    return _with_plan(docs, seed, **params).select("row", times.alias("one")) \
        .select("row.*")


_TARGETS = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
k AS (
  SELECT doc_id, source, size,
         md5('mix-7-' || coalesce(CAST(doc_id AS VARCHAR), '')) || lpad(CAST(size AS VARCHAR), 20, '0')
           || md5(text) AS sort_key, row_number() OVER () AS copy FROM d),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
           WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM s),
f AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
         sum(weight) OVER (ORDER BY ratio, source NULLS LAST
                     ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM r),
lv AS (
  SELECT max(((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - fixed) / open_weight) AS lev FROM f),
p AS (
  SELECT source, source_size, least(cap, lev * weight) AS target FROM f, lv),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM p),
v0 AS (
  SELECT k.*, q.source_size, q.target, q.whole, target - whole * source_size AS rest, false AS taken
  FROM k JOIN q ON k.source IS NOT DISTINCT FROM q.source),
"""


def _round_sql(i: int) -> str:
    """A round over the rows ``v<i-1>``; copies are rows of their own here."""
    fits = f"NOT taken AND size > 0 AND size <= rest AND rest > target * {SLACK}::DOUBLE"
    return f"""
o{i} AS (
  SELECT *, {fits} AS ok, sum(CASE WHEN {fits} THEN size ELSE 0 END)
    OVER (PARTITION BY source ORDER BY sort_key, copy ROWS UNBOUNDED PRECEDING) AS upto
  FROM v{i - 1}),
v{i} AS (
  SELECT * EXCLUDE (ok, upto) REPLACE (taken OR (ok AND upto <= rest) AS taken,
    rest - sum(CASE WHEN ok AND upto <= rest THEN size ELSE 0 END) OVER (PARTITION BY source) AS rest)
  FROM o{i})"""


#: Rounds of the SQL twin; more than any table here needs.
_SQL_ROUNDS = 16
ORACLE_SQL = _TARGETS + ",".join(_round_sql(i) for i in range(1, _SQL_ROUNDS + 1)) + f"""
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN taken THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM v{_SQL_ROUNDS}
"""
