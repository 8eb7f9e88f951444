"""The queries of this subpackage and their SQL, added by ``__spark_entry__`` when it can import this module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chunk_dedup, decontaminate, host_rules, jaccard_join, language_id, license_rules, packing, sharding, substring_dedup, token_files


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file, the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_documents(spark, sf_dir), 40)


def op5_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.recognise(_documents(spark, sf_dir))


def op1_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_documents(spark, sf_dir))


def pages_language_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_bucket_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_documents(spark, sf_dir)).drop("kept")


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(_documents(spark, sf_dir))


def op6_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.dedup(_documents(spark, sf_dir)).drop("text")


def op7_tournament_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), end_id=1, length=2048)


def op8_ranked_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), end_id=2)


def op9_combination_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link(_documents(spark, sf_dir))


def op10_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_language_evidence, pages_language_evidence, op2_bucket_refinement, op3_host_rules, op4_minimax_shards, op5_license_rules, op6_gear_chunks,
        op7_tournament_packing, op8_ranked_token_files, op9_combination_prefixes, op10_containment_search,
    ]
    return {**{f.__name__: f for f in found}, "pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_host_rules": host_rules.oracle(),
        "op5_license_rules": license_rules.oracle(),
        "op9_combination_prefixes": jaccard_join.oracle(),
        "op10_containment_search": decontaminate.oracle(),
    }
