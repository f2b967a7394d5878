"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and gives the documents it keeps."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonetide.llm.bpe import encode_decode, read_file
from zonetide.llm.columns import fresh
from zonetide.llm.jaccard import jaccard_components
from zonetide.llm.language import UNKNOWN, labelled_sample, predict, train
from zonetide.llm.mixing import mixed_documents
from zonetide.llm.suffix import without_repeats

LEAST_SCORE = 0.5
BATCH_BYTES = 8 << 20  # executors have served four stages by then, so batches are small


def _small_batches(spark: SparkSession) -> None:
    """Bound what the JVM and the Python worker of every task hold of a batch; Spark's own bound is 64 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Documents that no language model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; null texts and those without a letter or without a clear language go.

    Repeated rows go or stay together; other columns pass through, whatever their names.
    """
    _small_batches(spark)
    model = train(labelled_sample(docs.filter(~held_out())))
    (told,) = fresh(docs, "_told")
    found = predict(docs, model, told)
    return found.filter((F.col(told)["lang"] != UNKNOWN) & (F.col(told)["score"] >= LEAST_SCORE)).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four fifths of their 5-grams, the one of least id; rows of one id are one document."""
    _small_batches(spark)
    found = jaccard_components(docs)
    copies = found.filter(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def without_repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what an earlier document has too; documents of which nothing is left go, cut characters are dropped."""
    _small_batches(spark)
    (column,) = fresh(docs, "_cut")
    parts = F.col(column)
    cut = without_repeats(docs, column=column, characters=True).filter((parts["n_removed"] == 0) | (parts["n_removed"] < parts["n_bytes"]))
    text = F.when(parts["n_removed"] == 0, F.col("text")).otherwise(parts["kept"].cast("string"))
    return cut.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, one row for each time it takes at least half of them; null and empty texts and null ids go."""
    return mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of each row; a null text has no ids, other columns go."""
    _small_batches(spark)
    coded = encode_decode(docs, read_file(public_tokenizers.path("word_bpe_49k.json")), BATCH_BYTES)
    return coded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
