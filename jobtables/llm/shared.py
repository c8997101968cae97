"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobtables import scratch
from jobtables.scratch import delete_path  # noqa: F401


class Scratch(scratch.Scratch):
    """Intermediate tables of one operator call, in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        super().__init__(spark, f"llm-{name}")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
