"""T3 with late rows kept: re-sent rows are dropped, rows behind the watermark
go to a side table instead of being counted only.

The watermark is observed here, per micro-batch: the latest event time of
earlier batches less the delay.  Ids seen since are a :class:`StateTable`; an
id leaves it when the watermark has passed its event time, as a later copy of
it is late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from jobtables.streaming.state_table import StateTable


class ResentFilter:
    """Keeps the first copy of every id that arrives within ``delay_s`` of
    event time; ``apply`` writes a batch's answered and late rows."""

    def __init__(self, spark: SparkSession, root: str, id_field: T.StructField, id_col: str,
                 ts_col: str, delay_s: int, buckets: int = 64):
        self.id_col, self.ts_col, self.delay_s = id_col, ts_col, delay_s
        schema = T.StructType([T.StructField("id", id_field.dataType), T.StructField("us", T.LongType())])

        def oldest(rows: DataFrame) -> DataFrame:
            return rows.groupBy("id").agg(F.min("us").alias("us"))
        self.seen = StateTable(spark, f"{root}/seen", schema, ["id"], oldest, buckets)
        mark = T.StructType([T.StructField("one", T.IntegerType()), T.StructField("us", T.LongType())])

        def latest(rows: DataFrame) -> DataFrame:
            return rows.groupBy("one").agg(F.max("us").alias("us"))
        self.latest = StateTable(spark, f"{root}/latest", mark, ["one"], latest, 1)

    def apply(self, batch: DataFrame, batch_id: int, kept_path: str, late_path: str) -> None:
        batch = batch.persist()
        try:
            us = F.unix_micros(F.col(self.ts_col).cast("timestamp")).alias("us")
            rows = batch.select(F.struct("*").alias("row"), F.col(self.id_col).alias("id"), us)
            past = self.latest.read(batch_id).first()
            mark = past["us"] - self.delay_s * 1_000_000 if past else -(1 << 62)
            late = rows.where(F.col("us") < mark)
            late.select("row.*").write.mode("overwrite").parquet(late_path)
            timely = rows.where(F.col("us").isNull() | (F.col("us") >= mark))
            # one copy of a batch's equal ids, by time and content: not a window per id
            first = timely.groupBy("id").agg(F.min_by(
                F.struct("row", "us"), F.struct(F.coalesce("us", F.lit(mark)), F.xxhash64("row"))).alias("f"))
            seen = self.seen.read(batch_id, self.seen.touched(first.select("id"))) \
                .where(F.col("us") >= mark).select(F.col("id").alias("known"))
            kept = first.join(seen, F.col("id").eqNullSafe(F.col("known")), "left_anti").select("id", "f")
            kept.select("f.row.*").write.mode("overwrite").parquet(kept_path)
            seen_now = kept.select("id", F.coalesce("f.us", F.lit(mark)).alias("us"))
            self.seen.merge(seen_now, batch_id)
            top = rows.agg(F.max("us").alias("us")).where("us IS NOT NULL")
            self.latest.merge(top.select(F.lit(1).alias("one"), "us"), batch_id)
        finally:
            batch.unpersist()


def start_resent_stream(rows: DataFrame, resent: ResentFilter, out_dir: str, checkpoint: str,
                        available_now: bool = False) -> StreamingQuery:
    """Answered rows go to ``out_dir/kept/batch=<id>``, rows behind the
    watermark to ``out_dir/late/batch=<id>``."""
    w = rows.writeStream.foreachBatch(lambda df, bid: resent.apply(
        df, bid, f"{out_dir}/kept/batch={bid}", f"{out_dir}/late/batch={bid}")) \
        .option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
