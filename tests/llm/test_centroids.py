import hashlib

import numpy as np
import pytest

from zonetide.llm import centroids as op


def _brute(rows, clusters, rounds, size):
    kept = [(i, [int(np.floor(64 * np.float64(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    c = [v for _, v in seeds]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w))
    near = lambda v: min((far(v, w), k) for k, w in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for k in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own) if o == k]
            if mine:
                c[k] = [sum(x) // len(mine) for x in zip(*mine)]
    last = [near(v) for _, v in kept]
    names = [hashlib.sha256(",".join(map(str, w)).encode()).hexdigest() for w in c]
    of = [sum(d for d, k in last if k == j) for j in range(len(c))]
    return sorted(((i, k, d, of[k], sum(of), names[k]) for (i, _), (d, k) in zip(kept, last)), key=str)


def _plain(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("clusters,rounds", [(1, 2), (5, 0), (7, 3), (16, 6)])
def test_against_brute_force(spark, clusters, rounds):
    rng = np.random.default_rng(clusters)
    centres = rng.standard_normal((6, 8))
    rows = [(int(i), (centres[i % 6] + rng.standard_normal(8) * 0.3).astype(np.float32).tolist()) for i in range(240)]
    rows += [(i, [0.25] * 8) for i in range(300, 400)] + [(300, [0.25] * 8)]  # a third of all are equal, one row comes twice
    rows += [(500, None), (501, []), (502, [1.0] * 7), (503, [None] + [0.0] * 7), (504, [float("nan")] * 8), (505, [float("inf")] * 8), (None, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, v int, cluster int")
    assert _plain(op.clustered(df.repartition(4), clusters, rounds, 8)) == _brute(rows, clusters, rounds, 8)


def test_ties_empty_clusters_and_few_vectors(spark):
    grid = [(i, [float(i % 3) / 64, float(i // 3 % 3) / 64]) for i in range(27)]
    for rows, k in ((grid, 9), (grid[:3], 16), ([(1, [1e30, -1e30])], 2)):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = op.clustered(df, k, 3, 2)
        if abs(rows[0][1][0]) < 1e9:
            assert _plain(got) == _brute(rows, k, 3, 2)
        else:
            assert [(r.cluster, r.distance) for r in got.collect()] == [(0, 0)]
    none = op.clustered(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert none.collect() == [] and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_bounds_spare_work_and_never_fail():
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (8, 16))
    x = centres[rng.integers(0, 8, 4000)] + rng.integers(-60, 60, (4000, 16))
    history = centres[None] + rng.integers(-300, 300, (1, 8, 16))
    state, total = op.first_bounds(x, history[0]), 0
    for _ in range(6):
        means = np.array([np.floor(x[state["cluster"] == k].mean(axis=0)) if (state["cluster"] == k).any() else history[-1][k] for k in range(8)], np.int64)
        history = np.concatenate([history, means[None]])
        state, work = op.next_bounds(x, state, history)
        square = np.stack([op.exact(x, c) for c in history[-1]], axis=1)
        assert (state["cluster"] == square.argmin(axis=1)).all()
        moved = np.sqrt(((history[-1][None] - history) ** 2).sum(axis=2))
        assert (state["lower"] - moved[state["since"], np.arange(8)] <= np.sqrt(square) + op.SLACK).all()
        total += work
    assert total < 6 * 4000 * 8 / 10


def test_norm_of_the_sum_is_tighter_than_the_sum_of_norms():
    """A centroid that goes and comes back has not moved, so nothing is measured."""
    x = np.array([[0, 0], [10, 0]])
    history = np.array([[[0, 0], [10, 0]]])
    state = op.first_bounds(x, history[0])
    away, back = history[0] + [[0, 3], [0, -3]], history[0]
    out, _ = op.next_bounds(x, state, np.stack([history[0], away]))
    assert out["measured"].tolist() == [0, 0]
    out, work = op.next_bounds(x, out, np.stack([history[0], away, back]))
    assert work == 0 and out["cluster"].tolist() == [0, 1]
