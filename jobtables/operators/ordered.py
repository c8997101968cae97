"""Exact running aggregates over a total order without one task per group.

``Window.partitionBy(key).orderBy(t)`` sends every row of a key to one task,
and a window with no partition sends the whole table to one task.  A hot key
holding a third of all rows would then be one task sorting a third of the
data.  Instead:

1. fixed bounds cut the order of ``(keys, order)`` into segments, contiguous
   slices; a hot key spans many of them.  The bounds are rows of a bounded
   sample, chosen by a hash, and enter the plan as literals, so every branch of
   every later plan, and every retry, cuts the rows alike;
2. rows go to their segment in one exchange, and a window inside each
   (segment, key) gives the local running values;
3. a key that began in an earlier segment is the key of a bound, so there is at
   most one such key per segment: only the rows of these keys are summed per
   (segment, key), pre-aggregated in the tasks that read them;
4. a window over these sums (at most two rows per segment) gives the totals of
   all earlier segments, which are broadcast and added.

The result equals the plain window exactly.  Nothing is checkpointed; the
input is read up to four times (count, sample, sums, rows), so a caller whose
input is expensive should write it first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEG = "_seg"
SAMPLE_PER_SEGMENT = 64
_JSON = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
         "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _columns(cols: Sequence) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _position(df: DataFrame, keys: Sequence[str], order: Sequence) -> Column:
    """A row's place in the total order, as one comparable struct (nulls first)."""
    return F.struct(*[c.alias(f"c{i}") for i, c in enumerate([*_columns(keys), *_columns(order)])])


class Segments:
    """Bounds that cut ``(keys, order)`` into segments.

    ``of(df)`` is the segment of a row: the number of bounds at or below it.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence, segments: int | None):
        spark = df.sparkSession
        self.keys, self.order = list(keys), list(order)
        wanted = segments or int(spark.conf.get("spark.sql.shuffle.partitions"))
        placed = df.select(_position(df, keys, order).alias("p"))
        # two passes instead of a top-k: a task sends only its rows of the sample
        total = placed.count() if wanted > 1 else 0
        share = min(1.0, SAMPLE_PER_SEGMENT * wanted / total) if total else 0.0
        chosen = F.pmod(F.xxhash64(F.lit("segments"), "p"), F.lit(1 << 30)) < int(share * (1 << 30))
        rows = [r["j"] for r in placed.where(chosen).orderBy("p")
                .select(F.to_json("p", _JSON).alias("j")).collect()] if share else []
        bounds = []
        for i in range(1, wanted):
            if rows and (b := rows[i * len(rows) // wanted]) not in bounds[-1:]:
                bounds.append(b)
        self.count = len(bounds) + 1
        # the order of equal bounds is that of the sample, so texts need no comparison
        self.type = T.ArrayType(placed.schema["p"].dataType)
        self.bounds = F.from_json(F.lit("[" + ",".join(bounds) + "]"), self.type, _JSON)

    def of(self, df: DataFrame) -> Column:
        place = _position(df, self.keys, self.order)
        n = self.count - 1
        if n <= 16:  # few bounds: compared in generated code
            seg = F.lit(0)
            for i in range(1, n + 1):
                seg = seg + (F.element_at(self.bounds, i) <= place).cast("int")
            return seg

        def halve(acc, _):
            mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
            below = (acc["lo"] < acc["hi"]) & (F.element_at(self.bounds, mid + 1) <= place)
            return F.struct(F.when(below, mid + 1).otherwise(acc["lo"]).alias("lo"),
                            F.when(below, acc["hi"]).otherwise(F.least(mid, acc["hi"])).alias("hi"))
        steps = F.array(*[F.lit(0)] * n.bit_length())
        return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")), halve,
                           lambda acc: acc["lo"])

    def is_cut(self) -> Column:
        """Whether a row's key may be in two segments: it is then the key of the
        bound below the row or of the one above it."""
        key = F.struct(*[F.col(k).alias(f"c{i}") for i, k in enumerate(self.keys)])

        def key_of(bound: Column) -> Column:
            return F.struct(*[bound[f"c{i}"].alias(f"c{i}") for i in range(len(self.keys))])
        below, above = F.get(self.bounds, F.col(SEG) - 1), F.get(self.bounds, F.col(SEG))
        return key.eqNullSafe(key_of(below)) | key.eqNullSafe(key_of(above))

    def deal(self, df: DataFrame) -> DataFrame:
        """The rows in one partition per segment, with their segment in ``SEG``."""
        return df.withColumn(SEG, self.of(df)).repartitionById(self.count, F.col(SEG))


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str],
                 how: str = "inner", small_right: bool = False) -> DataFrame:
    """Null-safe equi-join on ``keys`` keeping the left's key columns.

    ``small_right`` marks a right side whose size is bounded by construction
    (not by the data); only then is it broadcast.
    """
    ren = {k: f"_rk{i}" for i, k in enumerate(keys)}
    r = right.withColumnsRenamed(ren)
    if small_right:
        r = F.broadcast(r)
    cond = [left[k].eqNullSafe(r[v]) for k, v in ren.items()]
    if not cond:
        cond = F.lit(True)
    return left.join(r, cond, how).drop(*ren.values())


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence,
                 values: dict[str, Column], min_before: dict[str, str] | None = None,
                 segments: int | None = None) -> DataFrame:
    """Add, per name in ``values``, the running sum (current row included) of
    that expression over ``keys`` ordered by ``order`` (ascending, nulls first).

    ``min_before`` maps an output name to the name of one of the sums: the
    minimum of that running sum over the rows strictly before the current one
    (null for the first row of a key).  ``order`` must be total.
    """
    keys, min_before = list(keys), min_before or {}
    vnames = {n: f"_v_{n}" for n in values}
    valued = df.withColumns({vnames[n]: e for n, e in values.items()})
    seg = Segments(df, keys, order, segments)
    inside = Window.partitionBy(SEG, *keys).orderBy(*_columns(order))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)

    def with_local(rows: DataFrame, names: Sequence[str]) -> DataFrame:
        local = rows.withColumns({f"_l_{n}": F.sum(vnames[n]).over(upto) for n in names})
        return local.withColumns({f"_lm_{m}": F.min(f"_l_{s}").over(before)
                                  for m, s in min_before.items()})

    local = with_local(seg.deal(valued), list(values))
    drop = [SEG, *vnames.values(), *[f"_l_{n}" for n in values], *[f"_lm_{m}" for m in min_before]]
    if seg.count == 1:
        return local.withColumns({**{n: F.col(f"_l_{n}") for n in values},
                                  **{m: F.col(f"_lm_{m}") for m in min_before}}).drop(*drop)
    cut = valued.withColumn(SEG, seg.of(valued))
    if keys:
        cut = cut.where(seg.is_cut())
    totals = [F.sum(vnames[n]).alias(f"_t_{n}") for n in values]
    if min_before:  # the least running sum of a segment needs its rows in order
        cut = with_local(cut.repartitionById(seg.count, F.col(SEG)), sorted(set(min_before.values())))
        totals += [F.min(f"_l_{s}").alias(f"_mn_{m}") for m, s in min_before.items()]
    sums = cut.groupBy(SEG, *keys).agg(*totals)
    earlier = Window.partitionBy(*keys).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumns({f"_o_{n}": F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0))
                                for n in values})
    if min_before:
        # the least over earlier segments of (their offset + their own least)
        offsets = offsets.withColumns({
            f"_pm_{m}": F.min(F.col(f"_o_{s}") + F.col(f"_mn_{m}")).over(earlier)
            for m, s in min_before.items()})
    offsets = offsets.select(SEG, *keys, *[f"_o_{n}" for n in values], *[f"_pm_{m}" for m in min_before])
    out = join_on_keys(local, offsets, [SEG, *keys], "left", small_right=True)
    out = out.withColumns({n: F.coalesce(F.col(f"_o_{n}"), F.lit(0)) + F.col(f"_l_{n}")
                           for n in values})
    out = out.withColumns({
        m: F.least(F.col(f"_pm_{m}"), F.coalesce(F.col(f"_o_{s}"), F.lit(0)) + F.col(f"_lm_{m}"))
        for m, s in min_before.items()})
    return out.drop(*drop, *[f"_o_{n}" for n in values], *[f"_pm_{m}" for m in min_before])


def global_row_number(df: DataFrame, order: Sequence, name: str = "rn",
                      keys: Sequence[str] = (), segments: int | None = None) -> DataFrame:
    """Exact ``row_number()`` (bigint, from 1) over ``keys`` ordered by ``order``,
    without sending a whole key, or the whole table, to one task."""
    return running_sums(df, keys, order, {name: F.lit(1).cast("bigint")}, segments=segments)
