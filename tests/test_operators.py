"""Operators on small frames, against pandas, numpy and brute force."""

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from zonetide.operators import aggregates, forecast, graph, joins, matching, overlay, panel, ranking, spatial, study, windows

FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
D0 = date(2024, 1, 1)


def day(n):
    return D0 + timedelta(days=n)


@FEW
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 12), st.integers(1, 9)), min_size=1, max_size=20))
def test_densify_is_complete(spark, rows):
    counts = pd.DataFrame(rows, columns=["zone", "d", "n"]).groupby(["zone", "d"], as_index=False).n.sum()
    df = spark.createDataFrame([(int(r.zone), day(int(r.d)), int(r.n)) for r in counts.itertuples()], "zone int, date date, n bigint")
    got = panel.densify(df, "zone", "date", ["n"]).toPandas()
    span = counts.d.max() - counts.d.min() + 1
    assert len(got) == counts.zone.nunique() * span == len(got.drop_duplicates(["zone", "date"]))
    assert got.n.sum() == counts.n.sum()
    merged = got.merge(df.toPandas(), on=["zone", "date"], how="left", suffixes=("", "_want"))
    assert (merged.n == merged.n_want.fillna(0)).all()


def test_densify_months_and_bounds(spark):
    df = spark.createDataFrame([(1, date(2024, 1, 1), 2), (1, date(2024, 4, 1), 3), (1, date(2020, 1, 1), 9)], "zone int, month date, n bigint")
    lit = lambda s: F.lit(s).cast("date")
    got = panel.densify(df, "zone", "month", ["n"], lit("2023-12-01"), lit("2024-05-01"), "month").orderBy("month").collect()
    assert [r.n for r in got] == [0, 2, 0, 0, 3, 0]


@FEW
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(-4, 4)), min_size=1, max_size=60))
def test_ranks_and_quantiles(spark, rows):
    pdf = pd.DataFrame(rows, columns=["g", "v"]).assign(i=range(len(rows)))
    df = spark.createDataFrame(pdf)
    got = ranking.average_rank(df, "v", ["g"], percent=True).toPandas().sort_values("i")
    assert np.allclose(got["rank"], pdf.groupby("g").v.rank(pct=True))
    plain = ranking.average_rank(df, "v", ["g"], bounded=True).toPandas().sort_values("i")
    assert np.allclose(plain["rank"], pdf.groupby("g").v.rank())
    q = ranking.quantiles(df, "v", {"a": 0.25, "b": 0.9}, ["g"]).toPandas().set_index("g").sort_index()
    want = pdf.groupby("g").v.quantile([0.25, 0.9]).unstack()
    assert np.allclose(q[["a", "b"]], want)


def test_quantiles_with_a_hot_value(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id") * 1.0).alias("v"))
    values = df.toPandas().v
    row = ranking.quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.99}).first()
    assert list(row) == pytest.approx(list(values.quantile([0.1, 0.5, 0.99])))


def test_dense_ids(spark):
    names = [f"n{i % 37:02d}" for i in range(500)]
    got = ranking.dense_ids(spark.createDataFrame([(n,) for n in names], "name string"), "name").collect()
    assert {r.name: r.id for r in got} == {n: i for i, n in enumerate(sorted(set(names)))}


def test_top_k_ties(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 4), ("b", 9, 1)], "g string, k int, v int")
    got = ranking.top_k_per_group(df, ["g"], [F.col("v").desc(), F.col("k")], 2).collect()
    assert sorted((r.g, r.k) for r in got) == [("a", 1), ("a", 2), ("b", 9)]


def test_trailing_frames(spark):
    df = spark.createDataFrame([(1, day(i), 1) for i in range(10) if i != 4], "zone int, date date, n bigint")
    ex = {r.date: r.trailing for r in windows.trailing_count(df, "zone", "date", "n", 3).collect()}
    inc = {r.date: r.trailing for r in windows.trailing_count(df, "zone", "date", "n", 3, inclusive=True).collect()}
    assert (ex[day(0)], ex[day(3)], ex[day(5)]) == (0, 3, 2)
    assert (inc[day(0)], inc[day(3)], inc[day(5)]) == (1, 3, 2)


def test_label_changes_and_age(spark):
    sets = spark.createDataFrame([(1, day(0), ["a"]), (1, day(5), ["a"]), (1, day(10), ["b", "c"])], "zone int, date date, labels array<string>")
    got = windows.label_changes(sets, "zone", "date", "labels").collect()
    assert sorted((r.date, r.old_label, r.new_label) for r in got) == [(day(10), "a", "b"), (day(10), "a", "c")]
    flags = spark.createDataFrame([(1, day(i), int(i == 2)) for i in range(5)], "zone int, date date, changed int")
    ages = [r.days_since for r in windows.days_since_change(flags, "zone", "date", "changed").orderBy("date").collect()]
    assert ages == [365, 365, 0, 1, 2]


def test_as_of_takes_last_known(spark):
    rows = spark.createDataFrame([(1, day(i)) for i in range(4)] + [(2, day(0))], "zone int, date date")
    snaps = spark.createDataFrame([(1, day(1), "x"), (1, day(3), "y")], "zone int, date date, label string")
    got = {(r.zone, r.date): r.label for r in joins.as_of(rows, snaps, "zone", "date", "label").collect()}
    assert got == {(1, day(0)): None, (1, day(1)): "x", (1, day(2)): "x", (1, day(3)): "y", (2, day(0)): None}


def test_pairs_within_score(spark):
    scores = np.random.default_rng(3).uniform(-9, 9, 40)
    df = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "k int, s double")
    got = {(r.a, r.b) for r in joins.pairs_within_score(df, "k", "s", 1.3).collect()}
    assert got == {(i, j) for i in range(40) for j in range(i + 1, 40) if abs(scores[i] - scores[j]) < 1.3}


def km(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (*a, *b))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(h))


@pytest.mark.parametrize("south", [0.0, -62.0])
def test_distance_and_nearest_edges(spark, south):
    rng = np.random.default_rng(5)
    pts = [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(south + rng.normal(0, 0.2, 60), rng.normal(0, 0.2, 60), strict=True))]
    # a pile of copies and one far point
    pts += [(60 + i, south, 0.0) for i in range(25)] + [(99, south + 20.0, 40.0)]
    df = spark.createDataFrame(pts, "id int, lat double, lon double")
    d = {(a[0], b[0]): km(a[1:], b[1:]) for a in pts for b in pts if a[0] != b[0]}
    got = {(r.src, r.dst) for r in graph.distance_edges(df, "id", "lat", "lon", 9.0).collect()}
    assert got == {p for p, v in d.items() if v < 9.0}
    want = {a[0]: [x for _, x in sorted((d[a[0], b[0]], b[0]) for b in pts if b[0] != a[0])[:4]] for a in pts}
    near: dict = {}
    for r in graph.nearest_edges(df, "id", "lat", "lon", 4).orderBy("src", "pos").collect():
        near.setdefault(r.src, []).append(r.dst)
    assert near == want


def test_date_line_and_poles(spark):
    pts = [(0, 0.0, 179.99), (1, 0.0, -179.99), (2, 89.99, 0.0), (3, 89.99, 180.0), (4, None, 1.0), (5, -89.999, 70.0), (6, 0.0, 0.0)]
    df = spark.createDataFrame(pts, "id int, lat double, lon double")
    assert {(r.src, r.dst) for r in graph.distance_edges(df, "id", "lat", "lon", 3.0).collect()} == {(0, 1), (1, 0), (2, 3), (3, 2)}
    near = {r.src: r.dst for r in graph.nearest_edges(df, "id", "lat", "lon", 1).collect()}
    assert {k: near[k] for k in (0, 1, 2, 3)} == {0: 1, 1: 0, 2: 3, 3: 2} and 4 not in near
    site = {r.p: r.id for r in spatial.nearest_sites(df.select(F.col("id").alias("p"), "lat", "lon"), df.filter("id in (1, 3, 6)"), "p", "id", "lon", "lat").collect()}
    assert site == {0: 1, 1: 1, 2: 3, 3: 3, 5: site[5], 6: 6}
    assert {r.dst for r in graph.nearest_edges(df, "id", "lat", "lon", 50).filter("src = 6").collect()} == {0, 1, 2, 3, 5}


def test_centroid_and_dominance_of_parts_and_holes(spark):
    square = lambda x, y, w: [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
    kind = "zone int, ring array<struct<x:double,y:double>>, holes array<array<struct<x:double,y:double>>>"
    zones = spark.createDataFrame([(1, square(0.0, 0.0, 2.0), None), (1, square(6.0, 0.0, 2.0), None), (2, square(0.0, 10.0, 4.0), [square(0.0, 10.0, 2.0)])], kind)
    got = {r.zone: (r.x, r.y) for r in spatial.centroids(zones, "zone", "ring", "holes").collect()}
    assert got[1] == pytest.approx((4.0, 1.0)) and got[2] == pytest.approx(((16 * 2 - 4 * 1) / 12, (16 * 12 - 4 * 11) / 12))
    labels = spark.createDataFrame([("a", square(-1.0, -1.0, 2.0)), ("b", square(5.0, -1.0, 20.0)), ("c", square(-0.1, 9.9, 2.1))], "label string, ring array<struct<x:double,y:double>>")
    top = {r.zone: r for r in overlay.dominance(zones, "zone", labels, "label", "ring", holes="holes").collect()}
    assert (top[1].dominant, top[2].dominant) == ("b", "NEUTRO") and top[1].degree == pytest.approx(0.5, abs=1e-9)


def test_nearest_sites(spark):
    rng = np.random.default_rng(6)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-3, 3, (50, 2)))] + [(50, 170.0, 80.0)]
    sites = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-3, 3, (9, 2)))]
    got = spatial.nearest_sites(spark.createDataFrame(pts, "p int, x double, y double"), spark.createDataFrame(sites, "s int, x double, y double"), "p", "s", "x", "y")
    want = {p[0]: min((km((p[2], p[1]), (s[2], s[1])), s[0]) for s in sites)[1] for p in pts}
    assert {r.p: r.s for r in got.collect()} == want


def test_same_label_edges(spark):
    nodes = spark.createDataFrame([(i, "big" if i < 200 else "two" if i < 202 else "one") for i in range(203)], "id int, label string")
    a = graph.same_label_edges(nodes, "id", "label", 3).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, graph.same_label_edges(nodes, "id", "label", 3).collect()))
    per: dict = {}
    for r in a:
        assert r.src != r.dst
        per.setdefault(r.src, set()).add(r.dst)
    assert all(len(per[i]) == 3 and max(per[i]) < 200 for i in range(200))
    assert per[200] == {201} and per[201] == {200} and 202 not in per


def test_cosine_fallback_only_when_nothing_passes(spark):
    vecs = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.0, 0.0, 1.0])], "z int, v array<double>")
    assert {(r.src, r.dst) for r in graph.cosine_edges(vecs, "z", "v", 0.3, 1).collect()} == {(0, 1), (1, 0), (2, 0)}
    more = vecs.unionByName(spark.createDataFrame([(3, [1.0, 0.1, 0.0])], "z int, v array<double>"))
    assert {(r.src, r.dst) for r in graph.cosine_edges(more, "z", "v", 0.3, 1).collect()} == {(0, 3), (3, 0)}


# Hand-written narratives with their expected fields.
NARRATIVES = [
    ("02 presos com 1.5 kg de cocaína e 3 pistolas em -3.76,-38.58", 2, 1500.0, 3, -3.76, "operacao_rotina", 1.0),
    ("Patrulhamento sem novidade", 0, 0.0, 0, None, "patrulhamento", 0.0),
    ("Megaoperação: 4 detidos", 4, 0.0, 0, None, "megaoperacao", 0.25),
    ("apreendidas drogas pesando 250 g", 0, 250.0, 0, None, "operacao_rotina", 0.25),
    ("2 kg de maconha", 0, 2000.0, 0, None, "operacao_rotina", 0.25),
    (None, 0, 0.0, 0, None, "operacao_rotina", 0.0),
]


def test_narratives(spark):
    df = spark.createDataFrame([(i, n[0]) for i, n in enumerate(NARRATIVES)], "i int, story string")
    for r in matching.narrative_fields(df, "story").collect():
        _, people, grams, weapons, lat, kind, score = NARRATIVES[r.i]
        assert (r.people, r.grams, r.weapons, r.lat, r.kind, r.score) == (people, grams, weapons, lat, kind, score), NARRATIVES[r.i]


# Monthly totals of two series and their published correlations
# at lags 0, 1 and 3 rows.
MONTHLY_X = [
    1, 590, 536, 451, 566, 572, 515, 564, 535, 558, 558, 604, 590, 613, 616, 655, 674, 647, 629, 682, 724, 692, 582, 570, 636, 628, 611, 649, 635, 753,
    727, 687, 677, 746, 865, 771, 720, 770, 697, 690, 693, 695, 659, 618, 655, 717, 661, 699, 654, 719, 747, 756, 818, 817, 768, 717, 807, 899, 806,
]
MONTHLY_Y = [
    0, 10, 20, 10, 18, 14, 18, 16, 16, 13, 9, 23, 15, 9, 7, 18, 14, 18, 13, 15, 15, 16, 18, 20, 13, 11, 15, 13, 14, 13,
    21, 14, 9, 12, 27, 14, 14, 16, 23, 18, 19, 11, 17, 6, 11, 14, 15, 23, 9, 11, 19, 10, 17, 16, 20, 8, 16, 22, 15,
]


def test_lagged_correlation_counts_rows(spark):
    rows = [(i, x, y) for i, (x, y) in enumerate(zip(MONTHLY_X, MONTHLY_Y, strict=True))]
    df = spark.createDataFrame(rows, "t int, x int, y int")
    got = {r.lag: r.r for r in study.lagged_correlation(df, "t", ["x"], "y", [0, 1, 3]).collect()}
    want = {k: np.corrcoef(MONTHLY_X[: len(MONTHLY_X) - k], MONTHLY_Y[k:])[0, 1] for k in (0, 1, 3)}
    assert got == pytest.approx(want)


def test_autocorrelation(spark):
    y = np.random.default_rng(1).poisson(4, 90)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "t int, y int")
    got = {r.lag: r.acf for r in study.autocorrelation(df, "t", "y", 12).collect()}
    x = y - y.mean()
    assert got == pytest.approx({k: float((x[: len(x) - k] * x[k:]).sum() / (x * x).sum()) for k in range(13)})


def plain_df_t(y):
    d = np.diff(y)
    x = np.column_stack([np.ones(len(d)), y[:-1]])
    beta = np.linalg.solve(x.T @ x, x.T @ d)
    rest = d - x @ beta
    return beta[1] / np.sqrt(rest @ rest / (len(d) - 2) * np.linalg.inv(x.T @ x)[1, 1])


def test_unit_root_statistics(spark):
    # zones 0-5 are random walks, 6-11 white noise
    rng = np.random.default_rng(2)
    series = [rng.normal(0, 1, 200).cumsum() for _ in range(6)] + [rng.normal(0, 1, 200) for _ in range(6)]
    rows = [(z, i, float(v)) for z, s in enumerate(series) for i, v in enumerate(s)]
    df = spark.createDataFrame(rows, "zone int, t int, y double")
    want = {z: plain_df_t(s) for z, s in enumerate(series)}
    for got in (study.dickey_fuller(df, "zone", "t", "y"), study.augmented_dickey_fuller(df, "zone", "t", "y", max_lag=0)):
        rows = {r.zone: r for r in got.collect()}
        assert {z: r.t for z, r in rows.items()} == pytest.approx(want)
        assert {z: r.stationary for z, r in rows.items()} == {z: bool(t < -2.86) for z, t in want.items()}
    chosen = {r.zone: r for r in study.augmented_dickey_fuller(df, "zone", "t", "y").collect()}
    assert sum(chosen[z].stationary for z in range(6, 12)) >= 5 and all(0 <= chosen[z].lag <= 15 for z in range(6, 12))
    assert sum(chosen[z].stationary for z in range(6)) <= 2


def test_trend_card_missing_months(spark):
    df = spark.createDataFrame([(1, date(2024, 3, 1), 4), (1, date(2024, 1, 1), 9), (1, date(2023, 3, 1), 2)], "zone int, month date, y bigint")
    r = study.trend_card(df, "zone", "month", "y").first()
    assert (r.latest, r.prev_month, r.month_change, r.prev_year_month, r.year_month_change, r.last_year, r.prev_year) == (4, 0, None, 2, 1.0, 13, 2)


def test_ema(spark):
    vals = [3, 5, 2, 8]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(vals)], "zone int, t int, y int")
    got = [r.ema for r in forecast.ema_baseline(df, "zone", "t", "y", 0.5).orderBy("t").collect()]
    want = [None, *pd.Series(vals).ewm(alpha=0.5, adjust=False).mean().tolist()[:-1]]
    assert got == pytest.approx(want)


def test_column_profile_counts(spark):
    df = spark.createDataFrame([(1.0, None), (0.0, 2.0), (0.0, 9.0)], "a double, b double")
    got = {r["column"]: r for r in aggregates.column_profile(df, ["a", "b"], {"b": (0, 5)}).collect()}
    assert (got["a"].present, got["a"].zeros, got["a"].distinct) == (3, 2, 2)
    assert (got["b"].present, got["b"].missing, got["b"].outside, got["b"].max) == (2, 1, 1, 9.0)


def test_split_share_and_validation(spark):
    p = spark.createDataFrame([(z, day(i), i * z) for z in (0, 1) for i in range(10)], "zone int, date date, n bigint")
    got = {r.split: r["count"] for r in panel.temporal_split(p, "date", {"train": 0.8, "validation": 0.2}).groupBy("split").count().collect()}
    assert got == {"train": 16, "validation": 4}
    bad = panel.validation_report(p, "zone", "date", "n", spark.createDataFrame([(0, 7)], "src int, dst int"), 7).first()
    assert bad.status == "check" and bad.silent_zones == 1 and bad.windows == 4 and bad.stray_edge_ends == 1


def test_common_panel(spark):
    a = spark.createDataFrame([(1, day(0), 5), (1, day(3), 1), (2, day(9), 1)], "zone int, date date, x bigint")
    b = spark.createDataFrame([(1, day(2), 7), (1, day(9), 2)], "zone int, date date, y bigint")
    got = panel.common_panel(a, b, "zone", "date", ["x"], ["y"], lagged="y").orderBy("date").collect()
    assert [(r.date, r.x, r.y, r.y_before) for r in got][:3] == [(day(2), 0, 7, 0), (day(3), 1, 0, 7), (day(4), 0, 0, 0)]
    assert {r.zone for r in got} == {1} and len(got) == 8
