"""Registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathmill.llm import mixing, oracles, quality
from pathmill.llm.byte_bpe import decode_documents, encode_documents
from pathmill.llm.exact_dedup import exact_duplicates
from pathmill.llm.fm_index import erase_repeated_words
from pathmill.llm.hard_negatives import hard_negatives
from pathmill.llm.language_id import identify_languages
from pathmill.llm.line_dedup import drop_common_lines
from pathmill.llm.mixing import mix_sources
from pathmill.llm.ngram_join import near_duplicates
from pathmill.llm.packing import pack_documents
from pathmill.llm.quality import quality_rules
from pathmill.llm.spelling import spelling_variants
from pathmill.llm.suffix_groups import erase_repeated_bytes
from pathmill.llm.warc import round_trip


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_read(spark, sf_dir, "pages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = erase_repeated_words(_read(spark, sf_dir, "documents"))
    return words.select("doc_id", F.col("n").alias("n_words"), F.col("removed").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_read(spark, sf_dir, "documents"), keep="max")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_read(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = erase_repeated_bytes(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("n_bytes"), F.col("removed").alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = drop_common_lines(_read(spark, sf_dir, "documents"))
    return lines.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_read(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", shifted), anchor=F.col("vec_id") % 100 == 0)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decode_documents(encode_documents(_read(spark, sf_dir, "documents")))
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_writer": op1_warc_writer,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_language_id": op4_language_id,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_ngram_join": op7_ngram_join,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_source_mixing": op9_source_mixing,
    "op10_line_dedup": op10_line_dedup,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": oracles.SUBSTRING,
    "op3_exact_dedup": oracles.EXACT,
    "op6_quality_rules": oracles.quality(quality.FENCES, quality.COUNTS, quality.GAMMA, quality.PRIOR_ROWS, quality.SYMBOLS),
    "op9_source_mixing": oracles.mixing(17, 32, 3, mixing.SHARD_ROWS, mixing.MOST_DIGITS),
    "op10_line_dedup": oracles.LINES,
    "op11_spelling_variants": oracles.SPELLING,
    "op12_hard_negatives": oracles.NEGATIVES,
}
