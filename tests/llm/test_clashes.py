"""Columns of a caller that have the names operators use inside."""

import pytest
from pyspark.sql import functions as F

from zonetide.llm import stages
from zonetide.llm.columns import fresh
from zonetide.llm.mixing import mixed_documents
from zonetide.llm.suffix import without_repeats
from zonetide.llm.unitigs import without_repeated_words

NAMES = ["_id", "_spans", "_n", "_told", "_cut", "_ID_", "_lang", "_row", "digest", "node", "lo", "size", "count"]


@pytest.fixture(scope="module")
def clashing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in NAMES}).cache()


@pytest.fixture(scope="module")
def plain(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _rows(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_fresh_names(spark):
    df = spark.createDataFrame([], "_id int, _ID_ int, x int")
    assert fresh(df, "_id", "y", "_id") == ["_id__", "y", "_id___"]


@pytest.mark.parametrize("cut", [without_repeats, without_repeated_words])
def test_cutting_operators(clashing, plain, cut):
    got = cut(clashing)
    assert got.columns == [*(c for c in clashing.columns if c != "_cut"), "_cut"]
    assert _rows(got, ["doc_id", "_cut"]) == _rows(cut(plain), ["doc_id", "_cut"])
    kept = cut(clashing, column="_mine")
    assert kept.columns == [*clashing.columns, "_mine"] and kept.filter("_cut <> concat('_cut', doc_id) or _spans <> concat('_spans', doc_id)").count() == 0


def test_mix(clashing, plain):
    got = mixed_documents(clashing)
    assert got.columns == clashing.columns
    assert _rows(got, plain.columns) == _rows(mixed_documents(plain), plain.columns)
    assert got.filter("_n <> concat('_n', doc_id) or _id <> concat('_id', doc_id)").count() == 0


@pytest.mark.parametrize("stage", [stages.known_language, stages.one_of_each_group, stages.without_repeated_bytes, stages.mixed_sources])
def test_stages_pass_other_columns(spark, sf_dir, clashing, plain, stage):
    got = stage(spark, clashing, sf_dir)
    assert got.columns == clashing.columns
    assert _rows(got, plain.columns) == _rows(stage(spark, plain, sf_dir), plain.columns)
    for name in NAMES:
        assert got.filter(F.col(name) != F.concat(F.lit(name), F.col("doc_id").cast("string"))).count() == 0
