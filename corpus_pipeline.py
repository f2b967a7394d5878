"""Corpus pipeline: documents -> language, near copies, repeated passages, mix of sources, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from zonetide.llm import stages
from zonetide.session import cut_lineage

STAGES = [
    ("language_id", stages.known_language),
    ("ngram_jaccard_join", stages.one_of_each_group),
    ("suffix_array_dedup", stages.without_repeated_bytes),
    ("source_mixing", stages.mixed_sources),
    ("bpe_encode_decode", stages.encoded),
]

#: Language models, byte spans and token ids have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each is written and read again by the next."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
