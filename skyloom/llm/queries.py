"""One query per operator over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import (
    decontaminate, language, licenses, mixing, packing, preferences, prefixes, quality, resampling, simhash, substring, suffixes, vectors,
)
from skyloom.llm.oracles import ORACLES

VOCABULARY = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text."""
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with another's turns from one of its replies on, as prompt and masked completions."""
    pairs = preferences.branched_replies(preferences.conversations_of(table(spark, sf_dir, "conversations")))
    text = lambda c: F.array_join(F.transform(c, lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    return preferences.format_pairs(pairs).select(
        "pair_id", "n_common", "prompt", "chosen", "rejected",
        text("chosen_mask").alias("chosen_spans"), text("rejected_mask").alias("rejected_spans"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut and packed into sequences of 1024 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, with the place."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left in each document when windows of 20 words that stand earlier too are removed."""
    kept = substring.remove_passages(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left in each document when strings of 100 bytes that begin earlier too are removed."""
    kept = suffixes.remove_strings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and near-duplicate group of every vector."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every whole text."""
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document a mix of all sources takes."""
    return mixing.allocate(table(spark, sf_dir, "documents"))


def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn by their likeness to the benchmark."""
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefixes that grafted conversations share."""
    return prefixes.prefix_trie(prefixes.grafted(prefixes.turn_sequences(table(spark, sf_dir, "conversations"))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_preference_format, op3_packing, op4_decontamination, op5_substring_dedup, op6_simhash_neardup, op7_quality,
        op8_suffix_dedup, op9_embedding_neardup, op10_license_scan, op11_source_mix, op12_target_resampling, op13_prefix_trie,
    )
}
__all__ = ["ORACLES", "QUERIES"]
