"""Overlay areas against a sweep over triangles, and simplified outlines against their definition."""

import numpy as np
import pytest

from zonetide.operators import outlines, overlay

RING = "array<struct<x:double,y:double>>"


def square(x, y, w, h=None):
    return [(x, y), (x + w, y), (x + w, y + (h or w)), (x, y + (h or w))]


def _shoelace(p):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])) / 2


def _clip(p, q):
    """Sutherland and Hodgman for a convex counter-clockwise clipper."""
    for a, b in zip(q, q[1:] + q[:1]):
        side = lambda c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])  # noqa: B023, E731
        out = []
        for c, d in zip(p, p[1:] + p[:1]):
            sc, sd = side(c), side(d)
            if sc >= 0:
                out.append(c)
            if (sc > 0 > sd) or (sc < 0 < sd):
                t = sc / (sc - sd)
                out.append((c[0] + t * (d[0] - c[0]), c[1] + t * (d[1] - c[1])))
        p = out
        if not p:
            return 0.0
    return abs(_shoelace(p))


def _star(rng, n, x, y, r):
    """A ring around (x, y) that is not convex; its fan of triangles covers it once."""
    turn = np.sort(rng.uniform(0, 2 * np.pi, n)) if n > 6 else np.linspace(0, 2 * np.pi, n, endpoint=False)
    far = rng.uniform(0.3, 1, n) * r
    return [(float(x + a), float(y + b)) for a, b in zip(far * np.cos(turn), far * np.sin(turn))]


def _fan(ring, x, y):
    return [[(x, y), a, b] for a, b in zip(ring, ring[1:] + ring[:1])]


def _signed(triangle):
    return (1, triangle) if _shoelace(triangle) > 0 else (-1, triangle[::-1])


def test_areas_against_clipped_triangles(spark):
    rng = np.random.default_rng(8)
    left = [(int(i % 5), 10 * rng.uniform(), 10 * rng.uniform(), 1 + 3 * rng.uniform()) for i in range(12)]
    right = [("abc"[i % 3], 10 * rng.uniform(), 10 * rng.uniform(), 1 + 6 * rng.uniform()) for i in range(7)]
    a = [(k, x, y, _star(rng, int(rng.integers(4, 14)), x, y, r)) for k, x, y, r in left]
    b = [(k, x, y, _star(rng, int(rng.integers(4, 14)), x, y, r)) for k, x, y, r in right]
    want: dict = {}
    for k, x, y, p in a:
        for m, u, v, q in b:
            area = 0.0
            for s, t in map(_signed, _fan(p, x, y)):
                for z, w in map(_signed, _fan(q, u, v)):
                    area += s * z * _clip(t, w)
            want[k, m] = want.get((k, m), 0.0) + area
    rows = lambda t: [(k, p[::-1] if i % 2 else [*p, p[0]]) for i, (k, _, _, p) in enumerate(t)]
    df_a = spark.createDataFrame([*rows(a), (9, None), (9, [(0.0, 0.0), (1.0, 1.0)])], f"zone int, ring {RING}")
    df_b = spark.createDataFrame(rows(b), f"label string, ring {RING}")
    got = {(r.zone, r.label): r.area for r in overlay.overlay_areas(df_a, "zone", df_b, "label", "ring").collect()}
    for key in want.keys() | got.keys():
        assert got.get(key, 0.0) == pytest.approx(want.get(key, 0.0), abs=1e-9)


def test_holes_parts_and_borders(spark):
    kind = f"zone int, ring {RING}, holes array<{RING}>"
    zones = spark.createDataFrame([
        (1, square(0.0, 0.0, 4.0), [square(1.0, 1.0, 2.0)[::-1]]), (1, square(10.0, 0.0, 2.0), []), (2, square(-5.0, 0.0, 5.0), None), (3, square(50.0, 50.0, 1.0), None), (4, None, None),
    ], kind)
    labels = spark.createDataFrame([("in", square(1.5, 1.5, 1.0), None), ("ring", square(0.0, 0.0, 4.0), [square(0.5, 0.5, 3.0)]), ("DISPUTA", square(10.0, 0.0, 1.5, 2.0), None)], kind.replace("zone int", "label string"))
    areas = {(r.zone, r.label): r.area for r in overlay.overlay_areas(zones, "zone", labels, "label", "ring", "holes", "holes").collect()}
    assert areas[1, "ring"] == pytest.approx(7.0, abs=1e-9) and areas[1, "DISPUTA"] == pytest.approx(3.0, abs=1e-9)
    assert areas.get((1, "in"), 0.0) == pytest.approx(0.0, abs=1e-9)
    got = {r.zone: (r.dominant, r.degree) for r in overlay.dominance(zones, "zone", labels, "label", "ring", holes="holes", label_holes="holes").collect()}
    assert got[1] == ("ring", pytest.approx(7 / 16, abs=1e-9)) and got[2] == got[3] == got[4] == ("NEUTRO", 0.0)
    half = spark.createDataFrame([("a", square(0.0, 0.0, 2.0, 4.0), None), ("DISPUTA", square(2.0, 0.0, 1.5, 4.0), None)], kind.replace("zone int", "label string"))
    one = spark.createDataFrame([(1, square(0.0, 0.0, 4.0), None)], kind)
    assert overlay.dominance(one, "zone", half, "label", "ring").first()["dominant"] == "DISPUTA"
    assert overlay.dominance(one, "zone", half.limit(0), "label", "ring").first()["dominant"] == "NEUTRO" and overlay.dominance(one.limit(0), "zone", half, "label", "ring").count() == 0


def _off(p, a, b):
    (x, y), (ax, ay), (bx, by) = p, a, b
    dx, dy = bx - ax, by - ay
    t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
    return float(np.hypot(x - ax - t * dx, y - ay - t * dy))


@pytest.mark.parametrize("tolerance", [0.0, 0.05, 0.4, 50.0])
def test_outlines_stay_near(spark, tolerance):
    rng = np.random.default_rng(3)
    rings = [_star(rng, int(rng.integers(3, 60)), 0.0, 0.0, 3.0) for _ in range(12)]
    dense = [(float(np.cos(t)), float(np.sin(t))) for t in np.linspace(0, 2 * np.pi, 5000, endpoint=False)]
    rings += [dense, dense + dense[:1], [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (3.0, 1e-6)], square(0.0, 0.0, 1.0)]
    df = spark.createDataFrame([(i, r, [r, square(0.0, 0.0, 1.0)]) for i, r in enumerate(rings)] + [(99, None, None)], f"id int, ring {RING}, holes array<{RING}>")
    got = {r.id: r for r in outlines.simplified(df, "ring", tolerance, "holes").collect()}
    assert got[99].ring is None and got[99].holes is None
    for i, ring in enumerate(rings):
        kept = [tuple(p) for p in got[i].ring]
        closed = ring[0] == ring[-1]
        assert (kept[0] == kept[-1]) == closed and [tuple(p) for p in got[i].holes[0]] == kept and len(got[i].holes[1]) >= 3
        corners = kept[:-1] if closed else kept
        assert len(corners) >= 3 and not outlines._crosses(*np.array(corners).T)
        at = [ring.index(p) for p in corners]
        assert at == sorted(at)
        for k, p in enumerate(ring):
            b = next((j for j in at if j >= k), at[0])
            a = max((j for j in at if j <= k), default=at[-1])
            assert _off(p, ring[a], ring[b]) <= tolerance + 1e-12
    if tolerance == 0.05:
        assert 10 < len(got[12].ring) < 40


def test_a_ring_that_would_cross_itself_keeps_more():
    """A thin spike reaches into a bulge: cutting the bulge would cut the spike."""
    bulge = [(4.0, 0.0), (4.9, -0.9), (5.1, -0.9), (6.0, 0.0)]
    spike = [(5.05, 10.0), (5.0, -0.5), (4.95, 10.0)]
    ring = [(0.0, 0.0), *bulge, (10.0, 0.0), (10.0, 10.0), *spike, (0.0, 10.0)]
    x, y = map(np.array, zip(*ring))
    assert not outlines._crosses(x, y)
    for tolerance in (0.1, 0.5, 1.0, 2.0):
        kept = outlines.corners_kept(x, y, tolerance)
        assert not outlines._crosses(x[kept], y[kept])
    assert len(outlines._split(np.append(x, x[0]), np.append(y, y[0]), 1.0)) < len(kept)
