import numpy as np
import pytest
from pyspark.sql import functions as F

from zonetide.llm import negatives as op
from zonetide.llm import rtree, skew


def _brute(rows, every, positives=5, negatives=5, low=80, high=100):
    points = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and None not in v:
            points[i] = min(points.get(i, (label, v)), (label, v))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (la, va) in points.items():
        if a % every:
            continue
        others = [(-dot(va, v), i, lb) for i, (lb, v) in points.items() if i != a and len(v) == len(va)]
        for s, p, _ in sorted(x for x in others if x[2] == la)[:positives]:
            inside = sorted(x for x in others if x[2] != la and low * -s <= 100 * -x[0] <= high * -s)
            out += [(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def _run(spark, rows, every, **more):
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<int>").withColumns({"q": F.lit(1), "tile": F.lit("t"), "c": F.lit(0), "size": F.lit(2)})
    got = op.hard_negatives(df.repartition(3), F.col("vec_id") % every == 0, **more)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


@pytest.mark.parametrize("tile,block", [(op.TILE, op.BLOCK), (40, 3)])
def test_against_brute_force(spark, monkeypatch, tile, block):
    for name, value in (("TILE", tile), ("BLOCK", block), ("BOXES", 5 if tile == 40 else op.BOXES)):
        monkeypatch.setattr(op, name, value)
    monkeypatch.setattr(skew, "SHARE", 20)
    rng = np.random.default_rng(5)
    centres = rng.integers(-40, 40, (5, 6))
    rows = [(i, int(i % 4), (centres[i % 5] + rng.integers(-15, 15, 6)).tolist()) for i in range(300)]
    rows += [(i, int(i % 2), [3, 3, 3, 3, 3, 3]) for i in range(300, 450)]  # a third of all are one vector of two labels
    rows += [(i, 9, [0] * 6) for i in range(450, 460)] + [(470, 1, [1, 2]), (480, 1, [2, 2]), (481, 2, [2, 1]), (490, 3, []), (491, 3, []), (492, 4, [])]
    rows += [(500, None, [1] * 6), (510, 2, None), (520, 2, [None] + [1] * 5), (None, 1, [1] * 6), (20, 7, [0] * 6), (10, 2, rows[10][2]), (530, 77, [1] * 6)]
    want = _brute(rows, 10)
    assert len(want) > 100
    assert _run(spark, rows, 10) == want
    if tile == 40:
        assert _run(spark, rows, 50, positives=2, negatives=9, low=30, high=150) == _brute(rows, 50, 2, 9, 30, 150)


def test_large_integers_and_empty(spark):
    big = 1 << 26
    rows = [(0, 1, [big] * 5), (1, 1, [big] * 4 + [big - 1]), (2, 1, [big] * 5), (3, 2, [big] * 4 + [big - 2]), (4, 2, [big - 1] * 5), (5, 2, [-big] * 5)]
    assert _run(spark, rows, 5) == _brute(rows, 5)
    assert _run(spark, [], 5) == [] and _run(spark, [(1, 1, [1])], 5) == [] and _run(spark, [(5, 1, [1]), (6, 1, [1])], 5) == []


def test_tree_search_prunes_and_is_exact():
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (60, 8))
    centre = rng.integers(0, 60, 20000)
    label = centre % 3
    x = (centres[centre] + rng.integers(-10, 10, (20000, 8))).astype(np.float64)
    ids = rng.permutation(20000).astype(np.int64)
    tree = rtree.Tree.of(x, ids, label)
    seen = []
    counted = rtree.intervals
    for q in range(20):
        a = x[q]
        nodes = [n for la, roots in tree.roots.items() if la != label[q] for n in roots]
        score = x @ a
        low, high = [int(score.max() * s) for s in (0.2, 0.5, 0.9)], [int(score.max() * s) for s in (0.6, 0.6, 1.0)]
        got = tree.search(a, nodes, low, high, [None, None, low[2]], 5)
        rtree.intervals = lambda *p: seen.append(len(p[1])) or counted(*p)
        try:
            assert tree.search(a, nodes, low[2:], high[2:], [None], 5) == got[2:]
        finally:
            rtree.intervals = counted
        for w in range(3):
            inside = [(int(-s), int(i)) for s, i, la in zip(score, ids, label) if la != label[q] and low[w] <= s <= high[w]]
            assert got[w] == [(-s, i) for s, i in sorted(inside)[:5]]
    assert sum(seen) < 20 * len(tree.lo) * 0.3
    assert (tree.end - tree.begin)[tree.leaf].max() <= rtree.LEAF


def test_boxes_hold_their_points():
    rng = np.random.default_rng(2)
    x, ids, label = rng.integers(-9, 9, (3000, 4)), np.arange(3000), rng.integers(0, 2, 3000)
    tree = rtree.Tree.of(x, ids, label)
    for node in range(len(tree.lo)):
        b, e = tree.begin[node], tree.end[node]
        inner = tree.x[b:e] if tree.leaf[node] else np.concatenate([tree.lo[b:e], tree.hi[b:e]])
        least = tree.ids[b:e] if tree.leaf[node] else tree.least[b:e]
        assert (inner.min(axis=0) == tree.lo[node]).all() and (inner.max(axis=0) == tree.hi[node]).all() and least.min() == tree.least[node]
    under = lambda n: tree.ids[tree.begin[n] : tree.end[n]].tolist() if tree.leaf[n] else [i for c in range(tree.begin[n], tree.end[n]) for i in under(c)]
    for la in (0, 1):
        assert sorted(i for n in tree.roots[la] for i in under(n)) == ids[label == la].tolist()
