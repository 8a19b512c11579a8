"""Registered queries of the text operators: key -> (query, oracle SQL or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanframe.llm import (
    exact_dedup, lexical_search, license_scan, neighbours, packing, pieces, quality, sharding, simhash, spelling, suffix_dedup,
    token_counts, toxicity,
)
from urbanframe.llm.common import read_table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(read_table(spark, sf_dir, "documents"), words=3, max_bits=3)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("p0"), 16, "0")).alias("fingerprint"), "component_id")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(spark, read_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.measured(read_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups_of(read_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.counted(read_table(spark, sf_dir, "documents"), path, token_counts.scrubbing)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, sf_dir, "embeddings"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(read_table(spark, sf_dir, "documents"), least=5, shortest=6, damage=199))


def op12_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(read_table(spark, sf_dir, "documents"), shards=8).drop("stratum")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)


ENTRIES = {
    "op1_simhash_near_dedup": (op1_simhash_near_dedup, None),
    "op2_license_scans": (op2_license_scans, license_scan.oracle()),
    "op3_toxicity": (op3_toxicity, None),
    "op4_sentencepiece": (op4_sentencepiece, None),
    "op5_suffix_array_dedup": (op5_suffix_array_dedup, None),
    "op6_exact_dedup": (op6_exact_dedup, exact_dedup.ORACLE),
    "op7_quality_classifier": (op7_quality_classifier, None),
    "op8_token_counts": (op8_token_counts, None),
    "op9_nearest_neighbours": (op9_nearest_neighbours, None),
    "op10_best_fit_packing": (op10_best_fit_packing, None),
    "op11_spelling_variants": (op11_spelling_variants, spelling.ORACLE),
    "op12_stratified_shards": (op12_stratified_shards, sharding.ORACLE),
    "op13_lexical_search": (op13_lexical_search, lexical_search.ORACLE),
}
