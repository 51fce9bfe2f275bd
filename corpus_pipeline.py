"""From raw documents to training sequences, in stages that each read what the one before has written."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import decontaminate, language, packing, simhash, substring
from skyloom.session import scratch_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language go on: those without a letter, or with a score below 0.3, go."""
    return language.recognised(docs, language.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates goes on, that with the smallest id."""
    return simhash.one_per_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that stand earlier too are cut out of the texts; n_chars counts what is left.

    Texts from which nothing is cut stay as they are. A document of which nothing is left goes.
    """
    kept = substring.remove_passages(docs).where("n_removed > 0").select(
        F.col("doc_id").alias("_id"), F.col("kept").alias("_kept"),
    ).dropDuplicates(["_id"])
    joined = docs.join(kept, docs["doc_id"] == kept["_id"], "left").where("_kept is null or _kept <> ''")
    text = F.coalesce("_kept", "text")
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("_kept").isNull(), F.col("n_chars")).otherwise(F.char_length("_kept").cast("long"))
    return joined.select(*(new[c].alias(c) if c in new else docs[c] for c in docs.columns))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark go on."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences of 1024 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("simhash_neardup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("packing", sequences),
]
#: A trained network and ids of a tokenizer are nothing that SQL expresses.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written below spark.checkpoint.dir and read again."""
    folder = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = stage(spark, docs, sf_dir)
        done.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(done.schema).parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
