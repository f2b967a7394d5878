"""Guarded statistics as aggregate expressions, and the Student-t tail."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson r over the pairs where both are present; null when undefined."""
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    both = x.isNotNull() & y.isNotNull()
    x = F.when(both, x.cast("double"))
    y = F.when(both, y.cast("double"))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    # a constant column leaves rounding noise of the order of 1e-17
    return F.when(spread > 1e-12, F.try_divide(F.covar_pop(x, y), spread))


def stability(count: Column, mean: Column, sd: Column) -> Column:
    """1 / (1 + CV): 0.5 below two observations, 0 for a zero mean."""
    value = F.least(1 / (1 + F.try_divide(F.coalesce(sd, F.lit(0.0)), mean)), F.lit(1.0))
    return F.when(count < 2, 0.5).when(mean == 0, 0.0).otherwise(value)


def t_of_r(r: Column, n: Column) -> Column:
    """Test statistic of a correlation over n pairs; null when |r| is 1."""
    return F.try_divide(r * F.sqrt(F.greatest(n - 2, F.lit(0)).cast("double")), F.sqrt(F.greatest(1 - r * r, F.lit(0.0))))


def _nodes(n: int = 64) -> list[tuple[float, float]]:
    """Gauss-Legendre nodes and weights on [0, 1]."""
    x, w = np.polynomial.legendre.leggauss(n)
    return list(zip(((x + 1) / 2).tolist(), (w / 2).tolist()))


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p-value of Student's t, for any number of degrees from 1 on.

    With u = sqrt(df log(1 + t^2 / df)) the density of t is a bell curve in u times
    a smooth factor, so one quadrature of fixed length gives its tail and its whole,
    and their ratio is the p-value.  The range ends where the density has fallen by
    exp(-40) from its start.
    """
    d = df.cast("double")
    start = F.sqrt(d * F.log1p(t * t / d))
    nodes = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in _nodes()])

    def tail(low: Column) -> Column:
        width = F.sqrt(low * low + 80.0) - low

        def value(n: Column) -> Column:
            u2 = (low + width * n["x"]) * (low + width * n["x"])
            return n["w"] * F.exp(-u2 * (d - 1) / (2 * d)) * F.sqrt(u2 / d / F.expm1(u2 / d))

        return width * F.aggregate(nodes, F.lit(0.0), lambda total, n: total + value(n))

    return F.when((df >= 1) & t.isNotNull(), F.least(tail(start) / tail(F.lit(0.0)), F.lit(1.0)))
