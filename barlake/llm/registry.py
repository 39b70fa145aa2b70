"""The corpus queries by name: each applies its operator with production parameters to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm import ann, backoff, bpe, neardup, oracle, packing, pii, prefixes, quality, rolling, substring, topk, toxicity, urls
from barlake.llm.storage import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), stable=True)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_quantised(read_table(spark, sf_dir, "embeddings"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group(read_table(spark, sf_dir, "documents"), percent=85)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), keep_cache=True)


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(read_table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.verdicts(read_table(spark, sf_dir, "pages"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = backoff.score(read_table(spark, sf_dir, "documents"), stable=True)
    return scores.withColumn("log_score", F.round("log_score", 4))


def op11_rolling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.features(read_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(read_table(spark, sf_dir, "conversations"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_bpe_round_trip": op2_bpe_round_trip,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_exact_top_k": op4_exact_top_k,
        "op5_minhash_near_dedup": op5_minhash_near_dedup,
        "op6_packing": op6_packing,
        "op7_nearest_neighbours": op7_nearest_neighbours,
        "op8_pii": op8_pii,
        "op9_url_filters": op9_url_filters,
        "op10_lm_scoring": op10_lm_scoring,
        "op11_rolling_windows": op11_rolling_windows,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_toxicity": op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.queries()
