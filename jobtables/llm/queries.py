"""The registered queries of this subpackage, with production parameters.

Each derives the columns of its contract from its operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobtables.llm import embedding_dedup, line_dedup, mixing, prefix_trie, spelling, url_filters
from jobtables.llm.shared import read_table


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobtables.llm.simhash import simhash_components
    return simhash_components(read_table(spark, sf_dir, "documents"), width=4, max_bits=4)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobtables.llm.quality import classify
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from jobtables.llm.token_records import token_records
    return token_records(read_table(spark, sf_dir, "documents"),
                         public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), weights=(3, 1, 2), total_share=1.5,
                      max_epochs=2.0, seed=7)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobtables.llm.decontaminate import contaminated_pairs
    return contaminated_pairs(read_table(spark, sf_dir, "documents"),
                              read_table(spark, sf_dir, "benchmark"), min_match=5, threshold=0.8)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobtables.llm.toxicity import classify
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobtables.llm.warc import archived_pages
    return archived_pages(read_table(spark, sf_dir, "pages"), min_bytes=0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated runs of three lines or more, and of fewer with 50 words."""
    return line_dedup.line_report(read_table(spark, sf_dir, "documents"), min_lines=3,
                                  min_words=line_dedup.MIN_WORDS)


def op3_line_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By lines only: shorter runs stay, whatever words they hold."""
    return line_dedup.line_report(read_table(spark, sf_dir, "documents"), min_lines=3)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobtables.llm.suffix_dedup import repeat_report
    return repeat_report(read_table(spark, sf_dir, "documents"), length=200)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_nodes(read_table(spark, sf_dir, "conversations"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(read_table(spark, sf_dir, "pages"), url_filters.RULES)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op8_simhash": op8_simhash,
    "op1_quality": op1_quality,
    "op4_token_records": op4_token_records,
    "op6_mixing": op6_mixing,
    "op5_decontamination": op5_decontamination,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op9_toxicity": op9_toxicity,
    "op2_warc": op2_warc,
    "op3_line_dedup": op3_line_dedup,
    "op3_line_dedup_lines": op3_line_dedup_lines,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_url_filters": op12_url_filters,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": line_dedup.WORDS_SQL,
    "op3_line_dedup_lines": line_dedup.ORACLE_SQL,
    "op6_mixing": mixing.ORACLE_SQL,
    "op10_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op11_prefix_trie": prefix_trie.ORACLE_SQL,
    "op12_url_filters": url_filters.ORACLE_SQL,
    "op13_spelling": spelling.ORACLE_SQL,
}
