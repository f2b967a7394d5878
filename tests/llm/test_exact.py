import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from zonetide.llm import exact as op
from zonetide.llm import skew


def _digest(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def _brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    best = {t: max(ids, key=lambda d: (d is not None, d or 0)) for t, ids in groups.items()}
    return sorted(((d, best[t or ""], len(groups[t or ""]), _digest(t)) for d, t in rows), key=str)


def _plain(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.digest) for r in df.collect()), key=str)


@pytest.fixture
def table(spark, tmp_path, documents):
    path = str(tmp_path / "documents.parquet")
    documents.withColumn("_metadata", F.lit("own")).withColumn("digest", F.lit("x")).repartition(3).write.parquet(path)
    return path


def test_against_brute_force(spark, table, texts):
    got = op.exact_dedup(spark, table).cache()
    assert _plain(got) == _brute(texts)
    kept = got.filter("kept").collect()
    assert len(kept) == len({t or "" for _, t in texts})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_texts_of_one_digest_are_told_apart_by_their_bytes(spark, table, texts):
    weak = lambda c: F.concat(F.lit("d"), F.pmod(F.octet_length(c), F.lit(5)).cast("string"))
    got = op.exact_dedup(spark, table, digest=weak).collect()
    want = sorted(((d, k, n) for d, k, n, _ in _brute(texts)), key=str)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == want


def test_later_files_join_earlier_groups(spark, tmp_path, few):
    path, log = str(tmp_path / "t.parquet"), str(tmp_path / "log")
    few([(1, "a"), (2, "b"), (7, "a"), (3, None)]).coalesce(1).write.parquet(path)
    first = op.take_in(spark, path, log)
    assert {r.digest: (r["at"].id, r.n) for r in first.collect()} == {_digest("a"): (7, 2), _digest("b"): (2, 1), _digest(""): (3, 1)}
    more = [(9, "a"), (1, "b"), (5, "new"), (5, "new")]
    few(more).coalesce(1).write.mode("append").parquet(path)
    got = op.exact_dedup(spark, path, log, files_per_batch=1)
    assert _plain(got) == _brute([(1, "a"), (2, "b"), (7, "a"), (3, None), *more])
    assert got.filter("kept and doc_id = 5").count() == 1
    batches = len({r.batchId for r in spark.read.format("state-metadata").load(log).selectExpr("explode(sequence(minBatchId, maxBatchId)) as batchId").collect()})
    assert batches >= 2


def test_hot_long_and_empty(spark, tmp_path, few, monkeypatch):
    monkeypatch.setattr(skew, "SHARE", 4)
    rows = [(i, "same") for i in range(300)] + [(1000 + i, f"own {i}") for i in range(200)]
    rows += [(5000, "é" * 2_000_000), (5001, "é" * 2_000_000), (5002, "é" * 1_999_999 + "e")]
    path = str(tmp_path / "hot.parquet")
    few(rows).repartition(4).write.parquet(path)
    assert _plain(op.exact_dedup(spark, path)) == _brute(rows)
    none = str(tmp_path / "none.parquet")
    few([]).write.parquet(none)
    assert op.exact_dedup(spark, none).collect() == []
    single = f"{path}/" + next(p.name for p in (tmp_path / "hot.parquet").iterdir() if p.suffix == ".parquet")
    assert op.exact_dedup(spark, single).count() == spark.read.parquet(single).count()


def test_plan_is_native_and_state_has_no_text(spark, table):
    got = op.exact_dedup(spark, table)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert spark.conf.get(f"{op._STORE}.providerClass", "").count("RocksDB") == 0
    assert op.take_in(spark, table, f"{table}-log").columns == ["digest", "at", "n"]
