"""Registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorebook.llm import arc_convert, flow_mix, gumbel_pieces, host_rules, int8_join, line_join, pii_disclosure, probminhash, radix_resample, repair_shards, run_finder, token_cache, unit_dedup
from scorebook.llm.common import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge_documents(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


QUERIES["op5_host_rules"] = op5_host_rules
ORACLE["op5_host_rules"] = host_rules.oracle_sql()


def op6_flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow_mix.mixed_documents(_documents(spark, sf_dir))


QUERIES["op6_flow_mix"] = op6_flow_mix
ORACLE["op6_flow_mix"] = flow_mix.oracle_sql()


def op3_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache folder of its own for each run; no SQL can encode, so tests hold it to the library."""
    import public_tokenizers
    return token_cache.count_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
                                    fresh_path(spark, "token-cache"))


QUERIES["op3_token_cache"] = op3_token_cache


def op8_arc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc_convert.convert_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES["op8_arc_convert"] = op8_arc_convert
ORACLE["op8_arc_convert"] = arc_convert.oracle_sql()


def op9_int8_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return int8_join.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES["op9_int8_join"] = op9_int8_join
ORACLE["op9_int8_join"] = int8_join.oracle_sql()


def op10_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: all pairs of lines are too many for it; a brute-force test stands in."""
    return line_join.line_report(_documents(spark, sf_dir), limits=line_join.ALL_LINES)


QUERIES["op10_line_join"] = op10_line_join


def op4_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.unit_report(_documents(spark, sf_dir))


QUERIES["op4_unit_dedup"] = op4_unit_dedup
ORACLE["op4_unit_dedup"] = unit_dedup.oracle_sql()


def op4_unit_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, paragraphs, sentences and clauses together; a brute-force test stands in for SQL."""
    return unit_dedup.passage_report(_documents(spark, sf_dir))


QUERIES["op4_unit_passages"] = op4_unit_passages


def op7_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: all pairs of shingle sets are too many for it; a brute-force test stands in."""
    return probminhash.class_report(_documents(spark, sf_dir))


QUERIES["op7_probminhash"] = op7_probminhash


def op2_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: offsets of matches and the term table are held to brute force in the tests."""
    return pii_disclosure.disclosure_report(_documents(spark, sf_dir))


QUERIES["op2_disclosure"] = op2_disclosure


def op1_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segmentations a document; no SQL: samples are held to enumerated lattices in the tests."""
    import public_tokenizers
    return gumbel_pieces.segmentation_report(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES["op1_gumbel_pieces"] = op1_gumbel_pieces


def op11_run_finder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL: runs of all periods are quadratic there; a brute-force test stands in."""
    return run_finder.run_report(_documents(spark, sf_dir))


QUERIES["op11_run_finder"] = op11_run_finder


def op12_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of its own for each run; no SQL can encode, so tests hold it to the library."""
    import public_tokenizers
    return repair_shards.token_report(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"),
                                      fresh_path(spark, "token-files"))


QUERIES["op12_repair_shards"] = op12_repair_shards


def op13_radix_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return radix_resample.resampled_documents(_documents(spark, sf_dir),
                                              spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES["op13_radix_resample"] = op13_radix_resample
ORACLE["op13_radix_resample"] = radix_resample.oracle_sql()
