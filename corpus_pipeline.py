"""Corpus pipeline: quality rules, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the
columns of ``documents``; the last returns the packed pieces. ``run`` writes each stage's rows as
Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chainsight.llm import op1_quality, op4_simhash, op6_packing, op7_cdc, op9_mixing
from chainsight.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above their host's limit are taken out of the others."""
    return op1_quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return op4_simhash.one_of_each(docs, shingle=3, radius=3)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut out."""
    return op7_cdc.deduplicated(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by their calibrated probabilities; cells with at most 1 % of the raked weights keep theirs whole."""
    return op9_mixing.mixed_documents(docs, mix=op9_mixing.Mix(rare=0.01))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequences and offsets."""
    return op6_packing.packed(docs, window=1024, end=0)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixing", mixing), ("packing", packing)]
#: SQL can express neither the fingerprints nor the chunks; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
