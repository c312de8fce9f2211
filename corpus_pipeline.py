"""A training corpus from raw documents: toxic ones go, near copies fold, repeats and secrets are cut, the rest is packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsieve.llm import common, ngram_join, packing, secrets, suffix_dedup, toxicity


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, says how long the text is now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels, does not predict to be toxic."""
    return toxicity.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def fold_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by a Jaccard similarity of 0.8 on five-word shingles."""
    return ngram_join.representatives(docs, ngram_join.Rule(5, 80))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; passages of 50 words or more stay where they occur first."""
    return _measured(suffix_dedup.without_repeats(docs, suffix_dedup.Passage(50)))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced by a mark."""
    return _measured(secrets.masked(docs, secrets.fit(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", fold_near_copies),
    ("suffix_dedup", cut_repeats),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: Trained models and token merges are beyond SQL; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read by the next."""
    scratch = common.Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        with common.released():  # what a stage wrote for itself
            docs = scratch.save(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
