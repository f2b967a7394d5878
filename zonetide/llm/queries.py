"""One query per operator over the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from zonetide.llm import oracles
from zonetide.llm.bpe import encode_decode, read_file, token_counts
from zonetide.llm.centroids import clustered, finite, floored
from zonetide.llm.exact import exact_dedup
from zonetide.llm.fingerprint import as_text, edited_fingerprints, likeness
from zonetide.llm.jaccard import jaccard_components
from zonetide.llm.language import labelled_sample, predict, train
from zonetide.llm.mixing import mix
from zonetide.llm.negatives import hard_negatives
from zonetide.llm.quality import classified
from zonetide.llm.stages import held_out
from zonetide.llm.suffix import without_repeats
from zonetide.llm.unitigs import without_repeated_words
from zonetide.llm.vectors import linked_vectors


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_documents(spark, sf_dir))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited_fingerprints(_documents(spark, sf_dir))
    fp, edited, after = F.col("fp"), F.col("edited_fp"), F.col("next_fp")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(fp).alias("fingerprint"),
        as_text(edited).alias("edited_fingerprint"), likeness(fp, edited).alias("near_edited"), likeness(fp, after).alias("near_next"),
    )


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(_embeddings(spark, sf_dir))


def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(_documents(spark, sf_dir), read_file(public_tokenizers.path("word_bpe_49k.json")))
    return coded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return classified(_documents(spark, sf_dir), labels.filter("quality = 1").select("doc_id"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = without_repeats(_documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "_cut.n_bytes", "_cut.n_removed", "_cut.n_spans", F.sha2("_cut.kept", 256).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(_documents(spark, sf_dir), read_file(public_tokenizers.path("byte_bpe_50k.json")))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = without_repeated_words(_documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "_cut.n_words", "_cut.n_removed", F.sha2(F.col("_cut.kept").cast("binary"), 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("held_out", held_out())
    model = train(labelled_sample(docs.filter("not held_out")))
    return predict(docs, model).select("doc_id", "held_out", F.col("_lang.lang").alias("lang_pred"), F.col("_lang.score").alias("score"))


def op11_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _embeddings(spark, sf_dir).filter(finite("embedding"))
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    points = rows.select("vec_id", label.alias("label"), floored("embedding", 256).alias("v"))
    return hard_negatives(points, F.pmod("vec_id", F.lit(100)) == 0)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return exact_dedup(spark, f"{sf_dir.rstrip('/')}/documents.parquet").withColumnRenamed("digest", "text_sha256")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(_embeddings(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_source_mixing": op3_source_mixing,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_bpe_encode_decode": op5_bpe_encode_decode,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_language_id": op10_language_id,
    "op11_hard_negative_mining": op11_hard_negative_mining,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_centroid_clustering": op13_centroid_clustering,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": oracles.JACCARD,
    "op3_source_mixing": oracles.MIXING,
    "op4_embedding_near_dedup": oracles.VECTORS,
    "op7_suffix_array_dedup": oracles.SUFFIXES,
    "op9_substring_dedup": oracles.SUBSTRINGS,
    "op11_hard_negative_mining": oracles.NEGATIVES,
    "op12_exact_dedup": oracles.EXACT,
    "op13_centroid_clustering": oracles.CENTROIDS,
}
