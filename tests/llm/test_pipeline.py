import numpy as np
import pytest
from brute import jaccard, repeated_bytes
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from zonetide.llm import stages
from zonetide.llm.mixing import mix


def test_each_stage_on_what_the_last_one_kept(spark, documents, sf_dir):
    docs = documents
    told = stages.known_language(spark, docs, sf_dir).cache()
    assert told.columns == docs.columns
    ids = {r.doc_id for r in told.collect()}
    assert {9001, 9002, 9003, 9008}.isdisjoint(ids) and len(ids) >= 195

    single = stages.one_of_each_group(spark, told, sf_dir).cache()
    want = jaccard([(r.doc_id, r.text) for r in told.collect() if r.doc_id is not None])
    assert {r.doc_id for r in single.collect()} - {None} == {d for d, (_, c) in want.items() if c == d}

    cut = stages.without_repeated_bytes(spark, single, sf_dir).cache()
    want = repeated_bytes([(r.doc_id, r.text) for r in single.collect() if r.doc_id is not None], 100)
    got = {r.doc_id: r for r in cut.collect() if r.doc_id is not None}
    assert {d: r.text for d, r in got.items()} == {d: x[3].decode("utf-8", "ignore") for d, x in want.items() if x[3]}
    assert all(r.n_chars == len(r.text) for r in got.values())

    mixed = stages.mixed_sources(spark, cut, sf_dir).cache()
    taken = {r.doc_id: r for r in mix(cut).collect() if r.doc_id is not None}
    times = {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert all(abs(times.get(d, 0) * r["size"] - r.taken) <= r["size"] / 2 for d, r in taken.items() if r["size"])

    last = stages.encoded(spark, mixed, sf_dir).collect()
    tok = Tokenizer.from_str(stages.read_file(stages.public_tokenizers.path("word_bpe_49k.json")))
    texts = {r.doc_id: r.text for r in mixed.collect()}
    assert len(last) == sum(times.values())
    assert all(np.frombuffer(r.ids, "<u4").tolist() == tok.encode(texts[r.doc_id], add_special_tokens=False).ids for r in last)


def test_texts_are_cut_once_by_one_worker_of_a_task(spark, few):
    """Each Python step of a task holds a worker, and an executor keeps them all."""
    rows = [(1, "é" * 120), (2, "x" + "é" * 60 + "ü"), (3, "é" * 120), (None, "é" * 120), (4, None)]
    docs = few(rows).select("*", F.lit(0).alias("n_chars"))
    out = stages.without_repeated_bytes(spark, docs, "")
    # one for the documents with an id, one for those without, which are other tasks
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 2
    want = {d: x[3].decode("utf-8", "ignore") for d, x in repeated_bytes([r for r in rows if r[0]], 100).items() if x[3] or not x[1]}
    want[None] = "é" * 120
    assert {r.doc_id: r.text or "" for r in out.collect()} == want


def test_run(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "suffix_array_dedup", "source_mixing", "bpe_encode_decode"]
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 150 and out.filter("n_tokens is null").count() == 0


@pytest.mark.parametrize("name", ["known_language", "one_of_each_group", "without_repeated_bytes", "mixed_sources", "encoded"])
def test_stages_take_an_empty_table(spark, sf_dir, nothing, name):
    assert getattr(stages, name)(spark, nothing, sf_dir).count() == 0


@pytest.mark.parametrize("name", ["known_language", "one_of_each_group", "without_repeated_bytes", "encoded"])
def test_stages_with_workers_take_small_batches(spark, sf_dir, nothing, name):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        getattr(stages, name)(spark, nothing, sf_dir)
        assert int(spark.conf.get(key).rstrip("b")) == stages.BATCH_BYTES
    finally:
        spark.conf.set(key, before)
