"""Corpus pipeline over ``documents``: quality rules, SimHash near-duplicates, repeated passages, packing.

Each stage applies one operator of ``patchlens.llm`` to all that its predecessor kept. A
stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the
next one's docs. All but the last return the columns of ``documents``.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patchlens.llm import packing, quality, simhash, substrings
from patchlens.llm.common import Handoff, new_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy rejects go; null and empty texts have too few words and go too, repeated rows share a verdict."""
    return quality.kept(docs, quality.PRODUCTION)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate component stays, that of the smallest doc_id; null and empty texts are one component."""
    return simhash.deduplicated(docs, Handoff(spark), shingle=4, radius=4)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 35-word windows that are found again are removed from the texts; no document goes.

    Null and empty texts stay as they are.
    """
    return substrings.without_repeats(docs, Handoff(spark), 35)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids; a null or empty text is one end id."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN, window=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", simhash_stage),
    ("substring_dedup", substring_stage),
    ("packing", packing_stage),
]

#: Fingerprints, their components and packing have no SQL; the tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
