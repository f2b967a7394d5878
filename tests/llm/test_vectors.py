import numpy as np
import pytest
from brute import Forest

from zonetide.llm import vectors as op
from zonetide.plans.audit import plan_text


def _brute(rows, least=0.95):
    units = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in rows if _usable(v)}
    forest, n = Forest(), {i: 0 for i, _ in rows}
    ids = sorted(units)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if len(units[a]) == len(units[b]) and units[a] @ units[b] >= least:
                n[a], n[b] = n[a] + 1, n[b] + 1
                forest.join(a, b)
    return {i: (n[i], forest.root(i)) for i, _ in rows}


def _usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("tile", [op.TILE, 20])
def test_links_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(op, "TILE", tile)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 24))
    rows = []
    for i in range(180):
        v = centres[i % 6] * rng.choice([1.0, 3.0]) + rng.standard_normal(24) * rng.choice([0.0, 0.05, 0.2, 0.35])
        rows.append((1000 - i, v.astype(np.float32).tolist()))
    rows += [(1, None), (2, [0.0] * 24), (3, [float("nan")] * 24), (4, [None] + [1.0] * 23), (5, [float("inf")] * 24), (6, []), (7, [1.0, 0.0]), (8, [1.0, 0.001])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in op.linked_vectors(df).collect()}
    assert got == _brute(rows)


def test_sample_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = op.linked_vectors(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == _brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert op.linked_vectors(df.limit(0)).count() == 0


def _coded(spark, rows):
    packed = spark.createDataFrame(rows, "vec_id long, _v array<double>").mapInArrow(op._packed(op.LEAST), "vec_id long, size long, code binary, data binary")
    return packed.filter("data is not null")


def test_vectors_are_held_once_and_not_shuffled_for_each_tile(spark, monkeypatch):
    monkeypatch.setattr(op, "TILE", 16)
    monkeypatch.setattr(op, "LEAST_TILE", 16)
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(64).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(50)] + [(2000, rng.standard_normal(64).tolist())]
    tiles = op.tiles_of(_coded(spark, rows))
    held = [r for t in tiles.collect() for r in np.frombuffer(t["ids"], np.int64).tolist()]
    assert sorted(held) == [*range(400), 2000] and tiles.count() >= 20
    assert "Exchange" not in plan_text(op.met(tiles, op.LEAST)).replace("BroadcastExchange", "")
    pairs = [frozenset((r.a_no, r.b_no)) for r in op.met(tiles, -1.0).select("a_no", "b_no").collect()]
    assert len(pairs) == len(set(pairs)) == tiles.count() * (tiles.count() + 1) // 2


def test_tiles_far_apart_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(op, "TILE", 32)
    monkeypatch.setattr(op, "LEAST_TILE", 32)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 16))
    tiles = op.tiles_of(_coded(spark, [(i, (centres[i % 20] + 0.02 * rng.standard_normal(16)).tolist()) for i in range(640)]))
    assert op.met(tiles, 0.95).count() < tiles.count() ** 2 / 4


def test_repeated_rows_long_and_extreme_vectors(spark):
    rng = np.random.default_rng(3)
    long = rng.standard_normal(700)
    rows = [(1, long.tolist()), (1, long.tolist()), (2, (long + 0.01).tolist()), (3, [1e200] * 3), (4, [1e-200] * 3), (5, [0.0, -0.0, 1.0]), (6, [-0.0, 0.0, 1.0]), (None, [0.0, 0.0, 1.0])]
    got = op.linked_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [
        (0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False)]
