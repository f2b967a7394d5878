"""Cosine edges and the exponential mean against their definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonetide.operators import forecast, graph
from zonetide.plans.audit import plan_text


def _vectors(rng, n, groups, spread, size=6):
    centres = rng.standard_normal((groups, size))
    return [(int(i), (centres[i % groups] + spread * rng.standard_normal(size)).tolist()) for i in range(n)]


def _cosines(rows):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and np.linalg.norm(v) > 0}
    return {(a, b): float(unit[a] @ unit[b]) for a in unit for b in unit if a != b}


@pytest.mark.parametrize("least,spread", [(0.3, 0.5), (0.9, 0.2), (-0.4, 1.0)])
def test_edges_equal_all_pairs(spark, least, spread):
    rows = _vectors(np.random.default_rng(4), 90, 5, spread) + [(500, [0.0] * 6), (501, None)]
    df = spark.createDataFrame(rows, "z int, v array<double>")
    got = {(r.src, r.dst): r.cosine for r in graph.cosine_edges(df, "z", "v", least).collect()}
    want = {p: c for p, c in _cosines(rows).items() if c > least}
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)


def test_fallback_is_exact(spark):
    rows = _vectors(np.random.default_rng(7), 60, 4, 0.6) + [(300, [1.0] * 6)]
    df = spark.createDataFrame(rows, "z int, v array<double>")
    got = {(r.src, r.dst) for r in graph.cosine_edges(df, "z", "v", 1.0, 3).collect()}
    cosines = _cosines(rows)
    for a, _ in rows:
        best = sorted((-c, b) for (x, b), c in cosines.items() if x == a)[:3]
        assert {b for x, b in got if x == a} == {b for _, b in best}
    assert graph.cosine_edges(df.limit(0), "z", "v").count() == 0 and graph.cosine_edges(df.limit(1), "z", "v").count() == 0


def test_clustered_vectors_meet_few_others(spark):
    rows = _vectors(np.random.default_rng(2), 400, 20, 0.05, 12)
    placed, reaches = graph._near_pivots(spark.createDataFrame(rows, "z int, v array<double>"), "z", "v")
    assert graph.cosine_candidates(placed, reaches, 0.9).count() < 400 * 399 / 4


@pytest.mark.parametrize("alpha", [0.02, 0.3, 0.9, 1.0])
def test_exponential_mean_over_blocks(spark, alpha):
    rng = np.random.default_rng(int(alpha * 100))
    rows = [(z, t, None if rng.uniform() < 0.1 and t > 3 else float(rng.normal(50, 30))) for z in (1, 2, None) for t in range(forecast.BLOCK * 3 + 17 if z != 2 else 5)]
    rows += [(4, 0, None), (4, 1, 7.0), (4, 2, None), (4, 3, None)]
    df = spark.createDataFrame(rows, "zone int, t int, y double")
    got = {(r.zone, r.t): r.ema for r in forecast.ema_baseline(df, "zone", "t", "y", alpha).collect()}
    assert len(got) == len(rows)
    for zone in (1, 2, None, 4):
        mean = None
        for z, t, y in rows:
            if z != zone:
                continue
            assert got[z, t] == (None if mean is None else pytest.approx(mean, rel=1e-12))
            if y is not None:
                mean = y if mean is None else mean * (1 - alpha) + y * alpha


def _crowd(spark):
    """Half of all points in one spot's cell, two with one id, some without coordinates or neighbours."""
    rng = np.random.default_rng(3)
    rows = [(i, *(rng.normal(0, 0.004 if i % 2 else 0.2, 2) + [-5, -40]).tolist()) for i in range(900)]
    rows += [(7, -5.0, -40.0), (2000, None, 1.0), (2001, 60.0, 179.999), (2002, 60.0, -179.999), (2003, -80.0, 0.0), (None, -5.0, -40.0)]
    return rows, spark.createDataFrame(rows, "id int, lat double, lon double").coalesce(1)


def test_crowded_cells_are_the_work_of_many(spark):
    rows, df = _crowd(spark)
    edges = graph.distance_edges(df, "id", "lat", "lon", 3.0)
    r = np.radians(np.array([x[1:] for x in rows if x[1] is not None and x[0] is not None]))
    ids = [x[0] for x in rows if x[1] is not None and x[0] is not None]
    lat, lon = r[:, :1], r[:, 1:]
    h = np.sin((lat - lat.T) / 2) ** 2 + np.cos(lat) * np.cos(lat.T) * np.sin((lon - lon.T) / 2) ** 2
    near = 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(h, 1))) < 3.0
    want = sorted((ids[i], ids[j]) for i, j in zip(*np.nonzero(near), strict=True) if ids[i] != ids[j])
    assert sorted((e.src, e.dst) for e in edges.select("src", "dst").collect()) == want and (2001, 2002) in want
    # the pairs are made by all tasks, though the table of points is one file
    shares = edges.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(shares) > 4 and max(s["count"] for s in shares) < len(want) / 2


def test_edges_are_neither_shuffled_for_degrees_nor_made_thrice(spark):
    _, df = _crowd(spark)
    edges = graph.inverse_weights(graph.distance_edges(df, "id", "lat", "lon", 3.0)).select("src", "dst", "weight")
    made = plan_text(edges).count("ASIN(")
    assert made
    assert plan_text(graph.normalise(edges)).count("ASIN(") <= made
    links = graph.attach_isolated(edges, df, "id", [0, 1])
    assert plan_text(links).count("ASIN(") <= made
    got = [(e.src, e.dst) for e in links.collect()]
    linked = {(e.src, e.dst) for e in edges.collect()}
    alone = {r.id for r in df.collect() if r.id is not None} - {a for e in linked for a in e}
    repair = {(a, b) for a in alone for b in (0, 1) if a != b}
    assert len(got) == len(set(got)) and set(got) == linked | repair | {(b, a) for a, b in repair} and 2003 in alone


def test_a_hop_meets_a_zone_once_for_all_its_days(spark):
    """Repeated rows count twice, nulls not at all, zones without a day or an edge are left out."""
    rows = [(z, d, float((z or 0) * 10 + (d or 0)), None if d == 2 else 1.0) for z in (1, 2, 3, None) for d in (0, 1, 2, None)] + [(2, 1, 5.0, 1.0), (9, 0, 1.0, 1.0)]
    panel = spark.createDataFrame(rows, "zone int, day int, n double, k double")
    links = [(1, 2, 0.5), (1, 3, 0.25), (1, 4, 1.0), (2, 3, 2.0), (3, None, 1.0), (None, 2, 1.0), (4, 1, None)]
    edges = spark.createDataFrame(links, "src int, dst int, weight double")
    done = graph.hop(panel, edges, "zone", "day", ["n", "k"])
    want = {}
    for s, d, w in links:
        for z, day, *values in rows:
            if z is not None and z == d:
                sums = want.setdefault((s, day), [None, None])
                for i, v in enumerate(values):
                    if v is not None and w is not None:
                        sums[i] = (sums[i] or 0.0) + w * v
    got = {(r.zone, r.day): [r.n, r.k] for r in done.collect()}
    assert got == {key: [None if v is None else pytest.approx(v) for v in sums] for key, sums in want.items()}
    assert "packed" in plan_text(done)


def _scattered(spark):
    """Crowds, lone points, keys in two places, rows that come twice, null keys and coordinates."""
    rng = np.random.default_rng(9)
    rows = [(int(i), float(-5 + 0.05 * rng.standard_normal()), float(-40 + 0.05 * rng.standard_normal())) for i in range(300)]
    rows += [(1000 + i, -5.0 + 0.5 * i, 20.0) for i in range(5)] + [(2000 + i, -5.0 + 0.02 * (i % 2), 60.0 + i // 2) for i in range(6)]
    rows += rows[:40] + [(i, rows[i + 9][1], rows[i + 9][2]) for i in range(20)] + [(3000, 10.0, 10.0), (3000, 10.0, 10.001)]
    rows += [(None, -5.0, -40.0), (4000, None, -40.0), (4001, -5.0, None)]
    return spark.createDataFrame(rows, "id long, lat double, lon double")


@pytest.mark.parametrize("block", [graph.BLOCK, 8])
def test_distinct_edges_and_linked_points(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "BLOCK", block)
    df = _scattered(spark)
    every = {}
    for r in graph.distance_edges(df, "id", "lat", "lon", 3.0).collect():
        every[r.src, r.dst] = min(r.km, every.get((r.src, r.dst), 9.0))
    got = graph.distance_edges(df, "id", "lat", "lon", 3.0, distinct=True).collect()
    assert len(got) == len(every) and {(r.src, r.dst): r.km for r in got} == every
    linked = [r.id for r in graph.linked_points(df, "id", "lat", "lon", 3.0).collect()]
    assert len(linked) == len(set(linked)) and set(linked) == {src for src, _ in every}
    fast = graph.attach_isolated(graph.distance_edges(df, "id", "lat", "lon", 3.0, True), df, "id", [0, 1], graph.linked_points(df, "id", "lat", "lon", 3.0), True)
    plain = graph.attach_isolated(graph.distance_edges(df, "id", "lat", "lon", 3.0), df, "id", [0, 1])
    key = lambda r: (r.src is None, r.src or 0, r.dst is None, r.dst or 0)
    assert sorted(fast.collect(), key=key) == sorted(plain.collect(), key=key)


def test_edges_of_keys_in_one_place_are_not_shuffled_to_be_distinct(spark, tmp_path):
    from zonetide.plans.catalog import run

    points = [(i, [float(x) for x in (0.1 * (i % 7), 0.01 * i)], 0) for i in range(60)]
    spark.createDataFrame(points, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    links = run("gr7_attach_isolated", spark, str(tmp_path))
    assert plan_text(links).count("hashpartitioning(src") == 1  # of the new links
    assert links.count() == links.distinct().count() > 60
