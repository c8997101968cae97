"""Corpus pipeline: documents -> token records, one operator per stage.

Counted as part of ``jobtables.llm``.  Every stage takes ``(spark, docs,
sf_dir)``; its result is written as Parquet and read again as the next one's
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobtables.llm.shared import Scratch, read_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    from jobtables.llm.quality import keep_good
    return keep_good(docs, read_table(spark, sf_dir, "labels"), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays (the smallest id)."""
    from jobtables.llm.simhash import keep_one_per_group
    return keep_one_per_group(docs, width=4, max_bits=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover 0.8 or more of a benchmark item go."""
    from jobtables.llm.decontaminate import decontaminate
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"), min_match=5, threshold=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    from jobtables.llm.mixing import mixed_documents
    return mixed_documents(docs, weights=(3, 1, 2), total_share=1.5, max_epochs=2.0, seed=7)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records of all documents, in ascending id order, read back."""
    import public_tokenizers
    from jobtables.llm.token_records import token_records
    return token_records(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixture),
    ("token records", tokens),
]

#: No SQL form: fingerprints, trained models and the tokenizer are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
