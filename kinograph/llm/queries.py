"""The queries of this subpackage over the whole documents table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinograph.llm import exact_dedup, fingerprints, language_id, line_dedup, packing, recompression, sentencepiece_codec, sharding, simhash_dedup, suffix_dedup


#: So small that the table is split at every size.
SHARD_BYTES = 64 << 10


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": lambda spark, d: recompression.substring_repeats(documents(spark, d)),
        "op2_document_fingerprints": lambda spark, d: fingerprints.sketches(documents(spark, d)),
        "op3_exact_dedup": lambda spark, d: exact_dedup.exact_dedup(documents(spark, d)),
        "op4_sentencepiece": lambda spark, d: sentencepiece_codec.encode(documents(spark, d)),
        "op5_best_fit_packing": lambda spark, d: packing.best_fit_packing(documents(spark, d)),
        "op6_simhash_near_dedup": lambda spark, d: simhash_dedup.near_copies(documents(spark, d)),
        "op7_language_id": lambda spark, d: language_id.identify(documents(spark, d)),
        "op8_line_dedup": lambda spark, d: line_dedup.line_dedup(documents(spark, d)).select("doc_id", "text"),
        "op9_suffix_array_dedup": lambda spark, d: suffix_dedup.suffix_repeats(documents(spark, d)),
        "op10_sharding": lambda spark, d: sharding.shard(documents(spark, d), SHARD_BYTES),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": recompression.SQL,
        "op2_document_fingerprints": fingerprints.SQL,
        "op3_exact_dedup": exact_dedup.SQL,
        "op8_line_dedup": line_dedup.SQL,
        "op9_suffix_array_dedup": suffix_dedup.SQL,
        "op10_sharding": sharding.sql(SHARD_BYTES),
    }
