"""Line dedup: a suffix array over line-id sequences by prefix doubling.

Every distinct line is a number; a document is the sequence of its lines'
numbers.  A line that occurs once ends whatever could repeat, so only suffixes
that begin with a repeated line are put in order, and a lone line or the end of
the text is their terminator (before every line; among themselves by place).

* Doubling: the round at depth d names every suffix that is still tied by the
  pair of its own rank and the rank of the suffix d lines later; the distinct
  pairs are sorted and numbered in that order.  A suffix whose pair occurs once
  is settled; documents without a tied suffix leave, so rounds shrink; they end
  when none is tied.  Two suffixes are in the order of their ranks in the first
  round that tells them apart, so the array is sorted by the ranks that a suffix
  had until it was settled.
* Longest common prefixes: where a suffix and its predecessor in the array are
  both followed by the next line's suffix and *its* predecessor, the common
  prefix shrinks by one per line.  So only where such a chain ends is it
  measured, by steps of 2^k, ..., 2, 1 lines over the ranks of every round.
* Intervals: neighbours with a common prefix of d lines or more form one
  interval.  Its earliest suffix stays; at every other one a repeated run
  begins: of ``min_lines`` lines, or of fewer that hold ``min_words`` words.
  Runs that overlap or touch make one span, which is deleted.

DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtables.llm.mixing import word_count
from jobtables.llm.shared import Scratch
from jobtables.operators.ordered import global_row_number, running_sums

MIN_LINES = 3
MIN_WORDS = 50
BROADCAST_RUNS = 2_000_000  # of 16 bytes each
JOINS_PER_TABLE = 3  # steps of the common prefixes between two written tables

_SUFFIX = ["row", "doc_id", "line", "first", "words"]


def _in_row():
    return Window.partitionBy("row").orderBy("line")


def _numbered(classes: DataFrame, *order: str) -> DataFrame:
    """The global sort numbers partitions in order, and so does the id."""
    return classes.orderBy(*order).withColumn("rank", F.monotonically_increasing_id())


def _first_ranks(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """Suffixes that begin with a repeated line, ranked by it."""
    classes = lines.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1")
    classes = scratch.table(_numbered(classes, "a", "b").drop("n"), "classes")
    return scratch.table(lines.join(classes, ["a", "b"]).select(
        "row", "doc_id", "line", F.col("rank").alias("first"), "words", "rank",
        F.array("rank").alias("path"), F.lit(True).alias("tied"), F.lit(False).alias("fresh")),
        "ranks")


def _double(ranks: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """Ranks by ``2 * depth`` lines from ranks by ``depth`` lines."""
    w = _in_row()
    there = F.lead("line", depth).over(w) == F.col("line") + depth
    pairs = scratch.table(
        ranks.select(*_SUFFIX, "path", F.col("rank").alias("a"), "tied",
                     F.when(F.col("tied") & there, F.lead("rank", depth).over(w)).alias("b"),
                     F.max("tied").over(Window.partitionBy("row")).alias("alive"))
        .where("alive").drop("alive"), "pairs")
    shared = pairs.where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))
    # terminators differ, so a suffix that has come to its own is a class
    single = pairs.where("b IS NULL").withColumn("n", F.lit(1).cast("long"))
    classes = scratch.table(_numbered(
        single.unionByName(shared, allowMissingColumns=True), "a", "b", "doc_id", "row", "line"),
        "classes")
    named = pairs.where("b IS NOT NULL").join(
        classes.where("b IS NOT NULL").select("a", "b", "n", "rank"), ["a", "b"])
    out = named.unionByName(classes.where("b IS NULL")).select(
        *_SUFFIX, "rank",
        F.when(F.col("tied"), F.concat("path", F.array("rank"))).otherwise(F.col("path")).alias("path"),
        (F.col("n") > 1).alias("tied"), (F.col("tied") & (F.col("n") == 1)).alias("fresh"))
    written = scratch.table(out, "ranks")
    scratch.drop(pairs, classes)
    return written


def _common_prefixes(ends: DataFrame, levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """``ends(row, line, prow, pline)`` with the ``lcp`` of both suffixes."""
    ends = ends.withColumn("lcp", F.lit(0))
    for k in reversed(range(len(levels))):
        tied = levels[k].where("tied")
        mine = tied.select("row", F.col("line").alias("at"), F.col("rank").alias("r"))
        other = tied.select(F.col("row").alias("prow"), F.col("line").alias("pat"),
                            F.col("rank").alias("pr"))
        ends = ends.withColumns({"at": F.col("line") + F.col("lcp"),
                                 "pat": F.col("pline") + F.col("lcp")}) \
            .join(mine, ["row", "at"], "left").join(other, ["prow", "pat"], "left") \
            .select("row", "line", "prow", "pline", (F.col("lcp") + F.when(
                F.col("r") == F.col("pr"), 2 ** k).otherwise(0)).alias("lcp"))
        if k % JOINS_PER_TABLE == 0:
            ends = scratch.table(ends, "prefixes")
    return ends.select("row", "line", "lcp")


def suffix_array(lines: DataFrame, scratch: Scratch, max_depth: int = 0) -> DataFrame:
    """``lines(row, doc_id, line, a, b, words)``, two hashes of each line and its
    words -> ``row, doc_id, line, pos, lcp``, one row per suffix that begins with
    a repeated line: its place in the order of all (from 0), and the lines it
    shares with the suffix before it; ``words1`` to ``words<max_depth>`` are the
    words of its first lines."""
    levels, depth = [_first_ranks(lines, scratch)], 1
    while not levels[-1].where("tied").isEmpty():
        levels.append(_double(levels[-1], depth, scratch))
        depth *= 2
    settled = reduce(DataFrame.unionByName, [
        level.where("fresh").select(*_SUFFIX, "path") for level in levels])
    ordered = scratch.table(_numbered(settled, "path").drop("path"), "ordered")
    array = scratch.table(
        global_row_number(ordered, ["rank"], "pos").withColumn("pos", F.col("pos") - 1)
        .drop("rank"), "array")
    before = array.select((F.col("pos") + 1).alias("pos"), F.col("first").alias("pfirst"),
                          F.col("row").alias("prow"), F.col("line").alias("pline"))
    same = F.coalesce(F.col("first") == F.col("pfirst"), F.lit(False))
    paired = array.join(before, "pos", "left").withColumn("same", same)
    w = _in_row()
    chained = F.lead("same").over(w) & (F.lead("line").over(w) == F.col("line") + 1) \
        & (F.lead("prow").over(w) == F.col("prow")) & (F.lead("pline").over(w) == F.col("pline") + 1)
    paired = scratch.table(paired.select(
        "row", "doc_id", "line", "pos", "prow", "pline", "same",
        (F.col("same") & ~F.coalesce(chained, F.lit(False))).alias("ends"),
        *[F.sum("words").over(w.rowsBetween(0, d - 1)).alias(f"words{d}")
          for d in range(1, max_depth + 1)]), "paired")
    ends = _common_prefixes(paired.where("ends").select("row", "line", "prow", "pline"),
                            levels, scratch)
    end = F.first(F.when(F.col("ends"), F.struct("line", "measured")), ignorenulls=True) \
        .over(w.rowsBetween(0, Window.unboundedFollowing))  # that of the suffix's chain
    out = paired.join(ends.withColumnRenamed("lcp", "measured"), ["row", "line"], "left") \
        .withColumn("end", end) \
        .withColumn("lcp", F.when(F.col("same"), F.col("end.measured") + F.col("end.line")
                                  - F.col("line")).otherwise(0)) \
        .drop("prow", "pline", "same", "ends", "measured", "end")
    written = scratch.table(out, "suffix-array")
    scratch.drop(*levels, ordered, array, paired)
    return written


def _later(array: DataFrame, depths: dict[int, str], scratch: Scratch) -> DataFrame:
    """``(row, line, end)`` of the runs of ``depth`` lines that begin earlier as
    well, by ``depths``: depth -> condition on a suffix."""
    cut = {f"g{d}": F.when(F.col("lcp") < d, 1).otherwise(0) for d in depths}
    numbered = running_sums(array, [], ["pos"], cut)
    in_intervals = F.array(*[
        F.struct(F.lit(d).alias("depth"), F.col(f"g{d}").alias("interval"),
                 F.expr(ok).alias("ok")) for d, ok in depths.items()])
    members = scratch.table(
        numbered.select("doc_id", "row", "line", F.inline(F.filter(in_intervals, lambda x: x["ok"])))
        .drop("ok"), "members")
    place = F.struct("doc_id", "row", "line")
    intervals = scratch.table(
        members.groupBy("depth", "interval").agg(
            F.min(place).alias("earliest"), F.count("*").alias("n"))
        .where("n > 1").drop("n"), "intervals")
    return members.join(intervals, ["depth", "interval"]) \
        .where((F.col("row") != F.col("earliest.row")) | (F.col("line") != F.col("earliest.line"))) \
        .select("row", "line", (F.col("line") + F.col("depth") - 1).alias("end"))


def repeated_runs(rows: DataFrame, scratch: Scratch, min_lines: int = MIN_LINES,
                  min_words: int | None = None) -> DataFrame:
    """``rows(row, doc_id, text)`` with unique ``row`` -> ``(row, first, last)``,
    the maximal spans of lines (from 0) that begin earlier as well: of
    ``min_lines`` lines, or of fewer with ``min_words`` words if that is given."""
    if min_lines < 1:
        raise ValueError("min_lines must be at least 1")
    shorter = range(1, min_lines) if min_words is not None else []
    words = F.lit(0) if min_words is None else word_count(F.col("s"))
    lines = scratch.table(
        rows.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
        .select("row", "doc_id", "line", F.xxhash64("s").alias("a"),
                F.xxhash64(F.lit("second"), "s").alias("b"), words.cast("long").alias("words")),
        "lines")
    array = suffix_array(lines, scratch, len(shorter))
    scratch.drop(lines)
    later = _later(array, {min_lines: "true", **{d: f"words{d} >= {min_words}" for d in shorter}},
                   scratch)
    w = Window.partitionBy("row").orderBy("line", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.select("row", "line", "end", F.when(
        before.isNull() | (F.col("line") > before + 1), 1).otherwise(0).alias("new"))
    islands = islands.withColumn(
        "island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return scratch.table(
        islands.groupBy("row", "island").agg(
            F.min("line").alias("first"), F.max("end").alias("last"))
        .drop("island"), "runs")


def _cut(docs: DataFrame, min_lines: int, min_words: int | None) -> DataFrame:
    """``row`` (all columns), ``lines``, ``runs`` and ``kept`` (lines) of each."""
    scratch = Scratch(docs.sparkSession, "lines")
    rows = scratch.table(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"),
        F.monotonically_increasing_id().alias("row")), "rows")
    runs = repeated_runs(rows.select(
        "row", F.col("record.doc_id").cast("long").alias("doc_id"),
        F.col("record.text").alias("text")), scratch, min_lines, min_words)
    per_row = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first", "last")))
                                      .alias("runs"))
    empty = F.array().cast("array<struct<first:int,last:int>>")
    if runs.count() <= BROADCAST_RUNS:  # else texts are shuffled once
        per_row = F.broadcast(per_row)
    out = rows.join(per_row, "row", "left") \
        .withColumn("runs", F.coalesce("runs", empty)) \
        .withColumn("lines", F.coalesce(F.split("record.text", "\n"),
                                        F.array().cast("array<string>")))
    # what lies between the runs, as slices, so that a text is walked once
    gaps = F.arrays_zip(
        F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["last"] + 1)).alias("at"),
        F.concat(F.transform("runs", lambda r: r["first"]), F.array(F.size("lines"))).alias("to"))
    return out.withColumn("gaps", gaps).withColumn("kept", F.flatten(F.transform(
        "gaps", lambda g: F.slice(F.col("lines"), g["at"] + 1, g["to"] - g["at"]))))


def line_report(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None
                ) -> DataFrame:
    """One row per input row: ``doc_id, n_lines, n_removed, n_runs,
    kept_sha256`` (of the kept lines joined by line feeds, in UTF-8).

    Earlier means a smaller id (null is smallest), then an earlier row, then
    an earlier line.  Lines are compared as they are, blank ones too; runs
    never cross documents.  A null text has no lines, an empty one a single
    empty line.  Repeated rows are copies of the first of them.  An empty
    table gives no rows.
    """
    return _cut(docs, min_lines, min_words).select(
        F.col("record.doc_id").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
        F.size("runs").cast("long").alias("n_runs"),
        F.sha2(F.encode(F.array_join("kept", "\n"), "UTF-8"), 256).alias("kept_sha256"))


def remove_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES,
                          min_words: int | None = None) -> DataFrame:
    """``docs`` without the repeated runs; a null text stays null, a text of
    repeated runs only becomes empty; all columns."""
    cut = _cut(docs, min_lines, min_words)
    text = F.when(F.col("record.text").isNull(), F.lit(None)) \
        .when(F.size("runs") == 0, F.col("record.text")).otherwise(F.array_join("kept", "\n"))
    return cut.select(*[text.alias(c) if c == "text" else F.col(f"record.`{c}`")
                        for c in docs.columns])


ORACLE_SQL = f"""
WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM x),
k AS (
  SELECT doc_id, i, line,
         lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3
  FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
f AS (
  SELECT doc_id, i, line, CASE WHEN l3 IS NULL THEN 0 WHEN row_number() OVER (
           PARTITION BY line, l2, l3 ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS later FROM k),
c AS (
  SELECT doc_id, i, line, max(later) OVER (PARTITION BY doc_id ORDER BY i
           ROWS BETWEEN {MIN_LINES - 1} PRECEDING AND CURRENT ROW) AS gone FROM f),
r AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS gone_before FROM c),
s AS (
  SELECT doc_id, count(*) AS n_lines, sum(gone) AS n_removed,
         sum(CASE WHEN gone = 1 AND gone_before = 0 THEN 1 ELSE 0 END) AS n_runs,
         string_agg(CASE WHEN gone = 0 THEN line END, chr(10) ORDER BY i) AS kept
  FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
       CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id
"""

#: Twin of the report with ``min_words``.
WORDS_SQL = r"""
WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM x),
n AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w1 FROM l),
k AS (
  SELECT *, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3,
         w1 + lead(w1, 1) OVER w AS w2
  FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
f AS (
  SELECT doc_id, i, line, CASE
    WHEN l3 IS NOT NULL AND row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, i) > 1 THEN 3
    WHEN w2 >= 50 AND row_number() OVER (PARTITION BY line, l2 ORDER BY doc_id, i) > 1 THEN 2
    WHEN w1 >= 50 AND row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 THEN 1
    ELSE 0 END AS later FROM k),
c AS (
  SELECT doc_id, i, line, CASE WHEN later >= 1 OR lag(later, 1, 0) OVER w >= 2
                                 OR lag(later, 2, 0) OVER w >= 3 THEN 1 ELSE 0 END AS gone
  FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS gone_before FROM c),
s AS (
  SELECT doc_id, count(*) AS n_lines, sum(gone) AS n_removed,
         sum(CASE WHEN gone = 1 AND gone_before = 0 THEN 1 ELSE 0 END) AS n_runs,
         string_agg(CASE WHEN gone = 0 THEN line END, chr(10) ORDER BY i) AS kept
  FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
       CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id
"""
