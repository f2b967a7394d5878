"""Point-in-polygon, nearest, adjacency and vertices.

Polygons are rows ``(id, ring)``.  A join never compares every point with every
polygon: polygons are spread over the grid cells of their bounding box and meet
the points of those cells through an equi-join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonetide.functions import geo
from zonetide.operators.ranking import keep_first
from zonetide.session import cut_lineage


def _cell(col: Column, size: float) -> Column:
    return F.floor(col / F.lit(float(size)))


LEVELS = 24  # cells of the unit sphere from 2 wide down to about a metre


def sphere_cells(unit: Column, level: Column, reach: int = 0) -> Column:
    """The cells of the level that lie within ``reach`` of a unit vector's own cell."""
    def axis(v: Column) -> Column:
        own = F.floor(v / (F.lit(2.0) / F.pow(F.lit(2.0), level)))
        return F.sequence(own - reach, own + reach)

    xs, ys, zs = axis(unit["x"]), axis(unit["y"]), axis(unit["z"])
    return F.flatten(F.transform(xs, lambda x: F.flatten(F.transform(ys, lambda y: F.transform(zs, lambda z: F.struct(x.alias("x"), y.alias("y"), z.alias("z")))))))


def cells_around(cell: Column) -> Column:
    """A cell and the 26 that touch it."""
    axis = lambda v: F.sequence(v - 1, v + 1)
    xs, ys, zs = axis(cell["x"]), axis(cell["y"]), axis(cell["z"])
    return F.flatten(F.transform(xs, lambda x: F.flatten(F.transform(ys, lambda y: F.transform(zs, lambda z: F.struct(x.alias("x"), y.alias("y"), z.alias("z")))))))


def level_of(reach: Column) -> Column:
    """The finest level whose cells are ``reach`` wide or wider; 0 if that is unknown."""
    fit = F.floor(F.log2(F.lit(2.0) / reach))
    return F.coalesce(F.when(fit < 0, 0).when(fit > LEVELS - 1, LEVELS - 1).otherwise(fit), F.lit(0)).cast("int")


def at_all_levels(places: DataFrame, unit: str) -> DataFrame:
    """One row per place and level with its cell."""
    rows = places.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))))
    return rows.withColumn("_cell", F.element_at(sphere_cells(F.col(unit), F.col("_k")), 1))


def typical_cell(polygons: DataFrame, ring: str) -> float:
    """Half the median longer side of the bounding boxes."""
    xs = F.transform(F.col(ring), lambda p: p["x"])
    ys = F.transform(F.col(ring), lambda p: p["y"])
    side = F.greatest(F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))
    median = polygons.select(F.percentile_approx(side, 0.5)).first()[0]
    return float(median) / 2 if median else 1.0


def cell_cover(polygons: DataFrame, poly_id: str, ring: str, size: float, holes: str | None = None) -> DataFrame:
    """(poly_id, _edges, _cx, _cy): one row per grid cell under the bounding box.

    A cell keeps only the edges a ray to the right from inside it can meet, so a
    long border is not repeated whole in every cell; cells no ray leaves through
    an edge lie outside and are dropped.
    """
    xs = F.transform(F.col(ring), lambda p: p["x"])
    ys = F.transform(F.col(ring), lambda p: p["y"])
    boxed = polygons.select(
        poly_id,
        geo.polygon_edges(F.col(ring), None if holes is None else F.col(holes)).alias("_all"),
        F.sequence(_cell(F.array_min(xs), size), _cell(F.array_max(xs), size)).alias("_xs"),
        F.sequence(_cell(F.array_min(ys), size), _cell(F.array_max(ys), size)).alias("_ys"),
    )
    cells = boxed.withColumn("_cx", F.explode("_xs")).withColumn("_cy", F.explode("_ys"))
    slack = size * 1e-6
    left, low = F.col("_cx") * size - slack, F.col("_cy") * size - slack
    high = (F.col("_cy") + 1) * size + slack
    near = F.filter(
        "_all",
        lambda e: (F.greatest(e["y1"], e["y2"]) >= low) & (F.least(e["y1"], e["y2"]) <= high) & (F.greatest(e["x1"], e["x2"]) >= left),
    )
    return cells.select(poly_id, near.alias("_edges"), "_cx", "_cy").filter(F.size("_edges") > 0)


def points_in_polygons(
    points: DataFrame, polygons: DataFrame, poly_id: str, ring: str, x: str, y: str, size: float | None = None, how: str = "inner",
    holes: str | None = None,
) -> DataFrame:
    """Points with the polygon they lie strictly inside of.

    Overlapping polygons give one row each.  With ``how='left'`` points outside
    every polygon keep a null id.  A hot cell is split by the adaptive skew join.
    The cell size follows the polygons unless given; ``holes`` may name a column
    of inner rings.
    """
    size = typical_cell(polygons, ring) if size is None else size
    cover = cell_cover(polygons, poly_id, ring, size, holes)
    celled = points.withColumn("_cx", _cell(F.col(x), size)).withColumn("_cy", _cell(F.col(y), size))
    hit = geo.within(F.col("_edges"), F.col(x), F.col(y))
    if how == "inner":
        return celled.join(cover, ["_cx", "_cy"]).filter(hit).drop("_cx", "_cy", "_edges")
    # the predicate belongs to the join condition, so misses survive as nulls
    cover = cover.withColumnsRenamed({"_cx": "_px", "_cy": "_py"})
    on = (F.col("_cx") == F.col("_px")) & (F.col("_cy") == F.col("_py")) & hit
    return celled.join(cover, on, "left").drop("_cx", "_cy", "_px", "_py", "_edges")


def nearest_sites(points: DataFrame, sites: DataFrame, point_id: str, site_id: str, x: str, y: str) -> DataFrame:
    """The nearest site of each point by great-circle distance (ties: smaller id).

    Cells of the unit sphere of all sizes hold one site each as a representative;
    the nearest of those around a point bounds the distance, and the cells of that
    size next to the point hold every site within the bound.  Points and sites
    without coordinates are left out.
    """
    unit = geo.unit_vector(F.col("_sy"), F.col("_sx"))
    seats = sites.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("_sx"), F.col(y).alias("_sy")).agg(F.min(site_id).alias(site_id))
    seats = at_all_levels(seats.withColumn("_u", unit), "_u").drop("_u")
    km = geo.haversine_km(F.col(y), F.col(x), F.col("_sy"), F.col("_sx"))
    known = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(point_id, x, y)
    spots = known.select(x, y).distinct().withColumn("_u", geo.unit_vector(F.col(y), F.col(x)))
    heads = seats.groupBy("_k", "_cell").agg(F.min(F.struct(site_id, "_sx", "_sy")).alias("_h")).select("_k", "_cell", "_h._sx", "_h._sy")
    bound = at_all_levels(spots, "_u").join(heads, ["_k", "_cell"], "left").groupBy(x, y).agg(F.min(km).alias("_bound"))
    around = bound.withColumn("_u", geo.unit_vector(F.col(y), F.col(x))).withColumn("_k", level_of(geo.chord(F.col("_bound"))))
    around = around.withColumn("_cell", F.explode(sphere_cells(F.col("_u"), F.col("_k"), 1))).drop("_u", "_bound")
    best = around.join(seats, ["_k", "_cell"]).groupBy(x, y).agg(F.min(F.struct(km.alias("km"), site_id)).alias("_b"))
    return known.join(best, [x, y]).select(point_id, F.col(f"_b.{site_id}").alias(site_id), F.col("_b.km").alias("km"))


def first_zone(points: DataFrame, polygons: DataFrame, point_id: str, poly_id: str, ring: str, x: str, y: str, default: str) -> DataFrame:
    """One polygon per point, the smallest id where several overlap, and a
    default where there is none."""
    hits = points_in_polygons(points, polygons, poly_id, ring, x, y, how="left")
    return hits.groupBy(point_id).agg(F.coalesce(F.min(poly_id).cast("string"), F.lit(default)).alias(poly_id))


def assign_zones(points: DataFrame, polygons: DataFrame, point_id: str, poly_id: str, ring: str, x: str, y: str) -> DataFrame:
    """(point_id, poly_id, fallback): the polygon around each point, else the one
    with the nearest centroid; a point without coordinates has none."""
    hits = cut_lineage(points_in_polygons(points.select(point_id, x, y), polygons, poly_id, ring, x, y, how="left"), "hits")
    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    inside = hits.filter(F.col(poly_id).isNotNull() | ~known).select(point_id, poly_id, F.lit(False).alias("fallback"))
    lost = hits.filter(F.col(poly_id).isNull() & known).select(point_id, x, y)
    seats = centroids(polygons, poly_id, ring).select(poly_id, F.col("x").alias(x), F.col("y").alias(y))
    near = nearest_sites(lost, seats, point_id, poly_id, x, y).select(point_id, poly_id, F.lit(True).alias("fallback"))
    return inside.unionByName(near)


def centroids(polygons: DataFrame, poly_id: str, ring: str, holes: str | None = None) -> DataFrame:
    """Area centroid of each polygon; parts (rows of one id) add up, holes count against it."""
    def piece(r: Column, sign: float) -> Column:
        cx, cy = geo.centroid(r)
        area = F.abs(geo.signed_area(r)) * sign
        return F.struct(area.alias("a"), (cx * area).alias("x"), (cy * area).alias("y"))

    pieces = F.array(piece(F.col(ring), 1.0))
    if holes is not None:
        inner = F.transform(holes, lambda h: piece(h, -1.0))
        pieces = F.concat(pieces, F.coalesce(inner, F.slice(pieces, 1, 0)))
    sums = polygons.select(poly_id, F.explode(pieces).alias("p")).groupBy(poly_id).agg(F.sum("p.a").alias("a"), F.sum("p.x").alias("x"), F.sum("p.y").alias("y"))
    return sums.select(poly_id, F.try_divide("x", "a").alias("x"), F.try_divide("y", "a").alias("y"))


def touching(polygons: DataFrame, poly_id: str, ring: str, mode: str = "vertex", digits: int = 7) -> DataFrame:
    """Pairs of polygons that share a vertex, a whole border edge, or any stretch of border.

    Vertices and edges are rounded and matched by an equi-join.  In mode ``border``
    edges are matched by the line they lie on, and pairs whose stretches overlap
    touch, whether or not they share a vertex.  Both directions are returned.
    """
    if mode == "border":
        return _along_borders(polygons, poly_id, ring, digits)

    def point(px: Column, py: Column) -> Column:
        return F.struct(F.round(px, digits).alias("x"), F.round(py, digits).alias("y"))

    parts = polygons.select(poly_id, F.explode(geo.edges(F.col(ring))).alias("e"))
    a, b = point(F.col("e.x1"), F.col("e.y1")), point(F.col("e.x2"), F.col("e.y2"))
    mark = a if mode == "vertex" else F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    marks = parts.select(poly_id, mark.alias("mark")).distinct()
    left = marks.select(F.col(poly_id).alias("src"), "mark")
    right = marks.select(F.col(poly_id).alias("dst"), "mark")
    return left.join(right, "mark").filter(F.col("src") != F.col("dst")).select("src", "dst").distinct()


def _along_borders(polygons: DataFrame, poly_id: str, ring: str, digits: int) -> DataFrame:
    unit = 10.0 ** -digits
    e = polygons.select(poly_id, F.explode(geo.edges(F.col(ring))).alias("e")).select(poly_id, "e.*")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    e = e.withColumn("_len", F.hypot(dx, dy)).filter(F.col("_len") > unit)
    # one direction for both ways along a line; near-vertical lines point up
    turn = F.when((dx < -unit) | ((F.abs(dx) <= unit) & (dy < 0)), -1.0).otherwise(1.0)
    e = e.withColumn("_ux", turn * dx / F.col("_len")).withColumn("_uy", turn * dy / F.col("_len"))
    along = lambda x, y: F.col(x) * F.col("_ux") + F.col(y) * F.col("_uy")
    lines = e.select(
        poly_id, F.round("_ux", 4).alias("_a"), F.round("_uy", 4).alias("_b"), F.floor((F.col("y1") * F.col("_ux") - F.col("x1") * F.col("_uy")) / (unit * 1000)).alias("_c"),
        (F.col("y1") * F.col("_ux") - F.col("x1") * F.col("_uy")).alias("off"), F.least(along("x1", "y1"), along("x2", "y2")).alias("lo"), F.greatest(along("x1", "y1"), along("x2", "y2")).alias("hi"),
    )
    left = lines.select(F.col(poly_id).alias("src"), "_a", "_b", F.explode(F.array(F.col("_c") - 1, F.col("_c"), F.col("_c") + 1)).alias("_c"), F.col("off").alias("_o"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    # directions may round to either side
    step = F.array(F.lit(-1e-4), F.lit(0.0), F.lit(1e-4))
    left = left.withColumn("_a", F.explode(F.transform(step, lambda d: F.round(F.col("_a") + d, 4)))).withColumn("_b", F.explode(F.transform(step, lambda d: F.round(F.col("_b") + d, 4))))
    right = lines.withColumnRenamed(poly_id, "dst")
    shared = F.least("hi", "_hi") - F.greatest("lo", "_lo")
    return (
        left.join(right, ["_a", "_b", "_c"]).filter((F.col("src") != F.col("dst")) & (F.abs(F.col("off") - F.col("_o")) <= unit * 10) & (shared > unit * 10))
        .select("src", "dst").distinct()
    )


def vertices(polygons: DataFrame, poly_id: str, ring: str) -> DataFrame:
    return polygons.select(poly_id, F.posexplode(ring).alias("pos", "p")).select(
        poly_id, "pos", F.col("p.x").alias("x"), F.col("p.y").alias("y")
    )


def thin_vertices(polygons: DataFrame, poly_id: str, ring: str, tolerance: float) -> DataFrame:
    """Drop vertices closer than ``tolerance`` degrees to the last one kept."""

    def add(kept: Column, p: Column) -> Column:
        last = F.element_at(kept, -1)
        return F.when(F.hypot(p["x"] - last["x"], p["y"] - last["y"]) >= tolerance, F.concat(kept, F.array(p))).otherwise(kept)

    rows = polygons.select(poly_id, F.col(ring).alias("_ring"), F.transform(ring, lambda p, i: F.struct(i.alias("pos"), p["x"].alias("x"), p["y"].alias("y"))).alias("_v"))
    rows = rows.filter(F.size("_v") > 0).withColumn("_kept", F.aggregate(F.slice("_v", F.lit(2), F.size("_v")), F.slice("_v", 1, 1), add))
    return rows.select(poly_id, F.explode("_kept").alias("p")).select(poly_id, "p.pos", "p.x", "p.y")


def with_point(df: DataFrame, x: str, y: str, out: str = "point") -> DataFrame:
    return df.withColumn(out, F.struct(F.col(x).alias("x"), F.col(y).alias("y")))


def in_box(df: DataFrame, lat: str, lon: str, box: Sequence[float]) -> DataFrame:
    """Open bounds: south < lat < north and west < lon < east."""
    south, north, west, east = box
    a, o = F.col(lat), F.col(lon)
    return df.filter((a > south) & (a < north) & (o > west) & (o < east))
