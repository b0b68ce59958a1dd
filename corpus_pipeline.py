"""From raw documents to packed training sequences: quality rules, near-duplicates, repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import neardup, packing, quality, suffixdedup
from sextant.llm.common import written

#: Tokens of a packed sequence.
CAPACITY = 2048

#: No SQL expresses the near-duplicate, repeated-passage and packing stages; tests hold them against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are too short or repetitive, or that a rule learned from the labels rejects."""
    judged = quality.judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), prefix="__quality_")
    return judged.where("__quality_kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose five-word shingles are at least 0.8 alike."""
    return neardup.without_near_duplicates(docs, width=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out every byte of strings of 200 bytes that the corpus has twice or more; n_chars follows the text.

    A cut inside a character drops the rest of it. Documents of which nothing is left stay as empty ones.
    """
    others = [c for c in docs.columns if c != "text"]
    kept = suffixdedup.remove_repeats(docs, 200, keep_text=True, carry=others)
    fields = [F.col("kept").alias(c) if c == "text" else F.char_length("kept").cast("long").alias(c) if c == "n_chars" else F.col(f"row.{c}").alias(c) for c in docs.columns]
    return kept.select(*fields)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenizes the documents and packs them into sequences; a row per piece."""
    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY, 0)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what each makes is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
