"""From raw documents to packed training sequences, in stages that each write their table.

`run` applies the stages to `documents`.  Every stage reads what the one before it wrote, and
all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import bag_minhash, packing, quality_rules, suffix_dedup
from recordloom.llm.common import read, removed, saved, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the risk-controlled cutoff of their language."""
    return quality_rules.accepted(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return bag_minhash.one_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that occur anywhere else."""
    return suffix_dedup.deduplicated(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed token sequences, with their ids."""
    return packing.pieces(packing.tokenised(docs, packing.tokenizer_path()), with_ids=True)


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("repeated strings", repeated_strings),
    ("packing", sequences),
]

#: Holdout folds, near-duplicate classes and packing go beyond SQL: tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        # What a stage wrote on its way, and the table it read, go once its own table is there.
        with scratch():
            docs = saved(stage(spark, docs, sf_dir), "stage", keep=True)
        if before is not None:
            removed(before)
        before = docs
    return docs
