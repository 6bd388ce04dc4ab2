"""Registered queries of the operators in this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barloom.llm import align, bpe, counts, extract, licenses, packing, quality, repair, secrets, simhash, substring, vafile, warc
from barloom.llm.common import shared_folder, table
from barloom.llm.sql import ORACLE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def op1_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring.removal(table(spark, sf, "documents"))


def op6_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return counts.count_tokens(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op2_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    return vafile.top_k(rows, rows.where("vec_id % 100 = 0"), k=10)


def op3_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


def op4_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan(table(spark, sf, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(packing.by_words(table(spark, sf, "documents")), [512, 1024, 2048, 4096])


def op8_license_scans(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.recognise(table(spark, sf, "documents"))


def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark)
    warc.write_archive(table(spark, sf, "pages"), path)
    return warc.describe(warc.read_archive(spark, path))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return align.link_counts(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract(table(spark, sf, "pages"))


def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return repair.repair(table(spark, sf, "conversations"))


QUERIES |= {f.__name__: f for f in (op1_byte_bpe, op2_exact_top_k, op3_simhash_near_dedup, op4_secret_scans, op5_substring_dedup, op6_token_counts, op7_best_fit_packing, op8_license_scans,
                                     op9_quality_rules, op10_warc, op11_cross_tokenizer_alignment, op12_html_extraction,
                                     op13_conversation_repair)}

__all__ = ["ORACLE", "QUERIES"]
