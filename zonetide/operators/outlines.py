"""Simplified outlines of polygons."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALVINGS = 40


def _far(x: np.ndarray, y: np.ndarray, a: int, b: int) -> np.ndarray:
    """Distances of the vertices between a and b from the segment that joins them."""
    dx, dy = x[b] - x[a], y[b] - y[a]
    px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
    length = dx * dx + dy * dy
    t = np.clip((px * dx + py * dy) / length, 0, 1) if length else np.zeros(len(px))
    return np.hypot(px - t * dx, py - t * dy)


def _split(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas and Peucker on a ring given with its first vertex repeated at the end."""
    n = len(x) - 1
    start = 1 + int(np.hypot(x[1:n] - x[0], y[1:n] - y[0]).argmax())
    keep = np.zeros(n + 1, bool)
    keep[[0, start, n]] = True
    todo = [(0, start), (start, n)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        far = _far(x, y, a, b)
        if far.max() > tolerance:
            k = a + 1 + int(far.argmax())
            keep[k] = True
            todo += [(a, k), (k, b)]
    kept = np.flatnonzero(keep[:n])
    if len(kept) < 3:  # a flat ring keeps the vertex that gives it an area
        rest = np.concatenate([_far(x, y, 0, start), [-1.0], _far(x, y, start, n)])
        kept = np.array(sorted({0, start, 1 + int(rest.argmax())}))
    return kept


def _crosses(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sides of the ring that are not neighbours cross."""
    n = len(x)
    x2, y2 = np.roll(x, -1), np.roll(y, -1)

    def side(ax, ay, bx, by, px, py):
        return np.sign((bx - ax) * (py - ay) - (by - ay) * (px - ax))

    for i in range(n - 2):
        j = np.arange(i + 2, n - 1 if i == 0 else n)
        if not len(j):
            continue
        one = side(x[i], y[i], x2[i], y2[i], x[j], y[j]) * side(x[i], y[i], x2[i], y2[i], x2[j], y2[j])
        two = side(x[j], y[j], x2[j], y2[j], x[i], y[i]) * side(x[j], y[j], x2[j], y2[j], x2[i], y2[i])
        if ((one < 0) & (two < 0)).any():
            return True
    return False


def corners_kept(x: np.ndarray, y: np.ndarray, tolerance: float) -> list[int]:
    """Positions of the vertices of an open ring that stay."""
    n = len(x)
    if n < 4 or not np.isfinite(x).all() or not np.isfinite(y).all():
        return list(range(n))
    cx, cy = np.append(x, x[0]), np.append(y, y[0])
    for _ in range(HALVINGS):
        kept = _split(cx, cy, tolerance)
        if len(kept) == n or not _crosses(x[kept], y[kept]):
            return kept.tolist()
        tolerance /= 2
    return list(range(n))


def _kept_of_all(tolerance: float):
    @F.pandas_udf("array<array<int>>")
    def kept(xs: pd.Series, ys: pd.Series) -> pd.Series:
        def rings(x, y):
            if x is None:
                return None
            return [corners_kept(np.asarray(a, float), np.asarray(b, float), tolerance) for a, b in zip(x, y)]

        return pd.Series([rings(x, y) for x, y in zip(xs, ys)], dtype=object)

    return kept


def simplified(polygons: DataFrame, ring: str, tolerance: float, holes: str | None = None) -> DataFrame:
    """``polygons`` with outlines of fewer vertices, each ring on its own.

    No vertex that goes lies further than ``tolerance`` from the outline that stays (Douglas
    and Peucker, from the first vertex and the one furthest from it).  A ring keeps three
    corners at least, stays closed if it was, and does not cross itself unless it did before:
    its tolerance is halved until it does not.  Rings of three corners and null rings stay
    as they are.
    """
    inner = F.slice(F.array(F.col(ring)), 1, 0) if holes is None else F.coalesce(F.col(holes), F.slice(F.array(F.col(ring)), 1, 0))
    every = F.concat(F.array(F.col(ring)), inner)
    is_closed = lambda r: (F.size(r) > 1) & (F.element_at(r, 1) == F.element_at(r, -1))
    opened = F.transform(every, lambda r: F.when(is_closed(r), F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r))
    rows = polygons.withColumn("_rings", F.when(F.col(ring).isNotNull(), every)).withColumn("_open", F.when(F.col(ring).isNotNull(), opened))
    axis = lambda c: F.transform("_open", lambda r: F.transform(r, lambda p: p[c]))
    rows = rows.withColumn("_kept", _kept_of_all(tolerance)(axis("x"), axis("y")))

    def rebuilt(was: Column, i: Column) -> Column:
        corners = F.transform(F.get("_kept", i), lambda k: F.get(F.get("_open", i), k))
        return F.when(is_closed(was), F.concat(corners, F.slice(corners, 1, 1))).otherwise(corners)

    rows = rows.withColumn("_rings", F.transform("_rings", rebuilt))
    out = {ring: F.get("_rings", F.lit(0))}
    if holes is not None:
        out[holes] = F.when(F.col(holes).isNotNull() & F.col("_rings").isNotNull(), F.slice("_rings", F.lit(2), F.greatest(F.size("_rings"), F.lit(1)))).otherwise(F.col(holes))
    return rows.withColumns(out).drop("_rings", "_open", "_kept")
