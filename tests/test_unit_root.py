"""The augmented unit-root test against plain least squares."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonetide.operators import study


def _fit(y, lag, skip):
    """(t, AIC) by least squares with ``lag`` differences, on the rows from ``skip`` on."""
    dy = np.diff(y)
    rows = np.arange(skip, len(dy))
    x = np.column_stack([np.ones(len(rows)), y[rows]] + [dy[rows - k] for k in range(1, lag + 1)])
    if len(rows) <= x.shape[1] or np.linalg.matrix_rank(x) < x.shape[1]:
        return None
    beta = np.linalg.lstsq(x, dy[rows], rcond=None)[0]
    rss = float(((dy[rows] - x @ beta) ** 2).sum())
    if rss <= 1e-12:
        return None
    cov = rss / (len(rows) - x.shape[1]) * np.linalg.inv(x.T @ x)
    return float(beta[1] / np.sqrt(cov[1, 1])), len(rows) * np.log(rss / len(rows)) + 2 * x.shape[1], len(rows) - x.shape[1]


def _best(y, max_lag=None):
    if max_lag is None:
        max_lag = max(0, min(math.ceil(12 * (len(y) / 100) ** 0.25), len(y) // 2 - 2))
    fits = {k: f for k in range(max_lag + 1) if (f := _fit(y, k, max_lag)) and f[2] > 1}
    if not fits:
        return None, None
    k = min(fits, key=lambda k: (fits[k][1], k))
    return _fit(y, k, k)[0], k


def _series():
    rng = np.random.default_rng(11)
    walk = lambda n: 1000 + rng.normal(0, 1, n).cumsum()
    ar = [0.0, 0.0, 0.0]
    for e in rng.normal(0, 1, 150):
        ar.append(0.5 * ar[-1] - 0.4 * ar[-3] + e)
    return {1: walk(200), 2: rng.normal(0, 1, 90), 3: np.array(ar), 4: rng.poisson(4, 60).astype(float), 5: walk(13), 6: np.full(40, 3.0), 7: np.array([1.0, 2.0]), 8: np.arange(30.0), None: walk(50)}


def test_orders_and_statistics_equal_least_squares(spark):
    series = _series()
    df = spark.createDataFrame([(z, i, float(v)) for z, s in series.items() for i, v in enumerate(s)], "zone int, t int, y double")
    for more in ({}, {"max_lag": 3}, {"lag": 2}):
        got = {r.zone: r for r in study.augmented_dickey_fuller(df.repartition(4), "zone", "t", "y", **more).collect()}
        assert got.keys() == series.keys()
        for zone, s in series.items():
            if "lag" in more:
                fit = _fit(s, 2, 2) if len(s) > 5 else None
                t, lag = (fit[0], 2) if fit and fit[2] > 0 else (None, None)
            else:
                t, lag = _best(s, more.get("max_lag"))
            assert got[zone].lag == lag
            assert got[zone].t == (None if t is None else pytest.approx(t, rel=1e-6))
            assert (got[zone].p is None) == (t is None) and got[zone].stationary == (None if t is None else got[zone].p < 0.05)


def test_p_values(spark):
    """Published critical points of the test, and the ends of the surface."""
    points = [(-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10), (-20.0, 0.0), (3.0, 1.0), (-1.61, 0.4777), (-1.0, 0.7533), (0.0, 0.9585)]
    df = spark.createDataFrame(points, "t double, p double").withColumn("got", study.unit_root_p(F.col("t")))
    for r in df.collect():
        assert r.got == pytest.approx(r.p, abs=1e-3)


def test_sums_come_from_the_jvm(spark):
    df = spark.createDataFrame([(1, i, float(i % 5)) for i in range(30)], "zone int, t int, y double")
    plan = study.augmented_dickey_fuller(df, "zone", "t", "y")._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan and "HashAggregate" in plan
