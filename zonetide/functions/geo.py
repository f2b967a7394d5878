"""Coordinates: parsing, distance, ring predicates, area, centroid.

A ring is ``array<struct<x:double,y:double>>``, closed or open.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = math.pi * EARTH_KM / 180

# The degree-minute-second layout, latitude then longitude.
DMS_PATTERN = r"""(-?\d+)°(\d+)'([\d.]+)["']?([NSEW])?,?(-?\d+)°(\d+)'([\d.]+)["']?([NSEW])?"""


def _in_range(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def parse_lat_lon(col: Column | str) -> tuple[Column, Column]:
    """``"lat,lon"``, with or without brackets; both null when out of range."""
    col = F.col(col) if isinstance(col, str) else col
    parts = F.split(F.regexp_replace(col, r"[\[\]()]", ""), ",")
    lat = F.trim(F.try_element_at(parts, F.lit(1))).try_cast("double")
    lon = F.trim(F.try_element_at(parts, F.lit(2))).try_cast("double")
    good = _in_range(lat, lon)
    return F.when(good, lat), F.when(good, lon)


def parse_coordinates(col: Column | str) -> tuple[Column, Column]:
    """Decimal pair, else degrees-minutes-seconds; a S or W letter negates."""
    col = F.trim(F.col(col) if isinstance(col, str) else col)
    dec_lat, dec_lon = parse_lat_lon(F.when(~col.contains("°"), col))

    def group(i: int) -> Column:
        return F.regexp_extract(col, DMS_PATTERN, i)

    def decimal(first: int) -> Column:
        value = (
            group(first).try_cast("double")
            + group(first + 1).try_cast("double") / 60
            + group(first + 2).try_cast("double") / 3600
        )
        return F.when(group(first + 3).isin("S", "W"), -value).otherwise(value)

    lat, lon = decimal(1), decimal(5)
    good = _in_range(lat, lon)
    return F.coalesce(dec_lat, F.when(good, lat)), F.coalesce(dec_lon, F.when(good, lon))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null where a coordinate is missing."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    a = F.sin(half_lat) * F.sin(half_lat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def unit_vector(lat: Column, lon: Column) -> Column:
    """The point on the unit sphere; cells of it know neither date line nor poles."""
    a, o = F.radians(lat), F.radians(lon)
    return F.struct((F.cos(a) * F.cos(o)).alias("x"), (F.cos(a) * F.sin(o)).alias("y"), F.sin(a).alias("z"))


def chord(km: Column) -> Column:
    """Straight distance on the unit sphere of two points ``km`` apart, rounded up."""
    half = F.when(km > math.pi * EARTH_KM, math.pi / 2).otherwise(km / (2 * EARTH_KM))
    return F.sin(half) * (2 + 1e-9) + 1e-12


def closed(ring: Column) -> Column:
    """The ring with its first vertex repeated at the end."""
    first = F.element_at(ring, 1)
    return F.when(F.element_at(ring, -1) == first, ring).otherwise(F.concat(ring, F.array(first)))


def edges(ring: Column) -> Column:
    """Array of (x1, y1, x2, y2) along a ring."""
    ring = closed(ring)
    n = F.size(ring)
    return F.zip_with(
        F.slice(ring, F.lit(1), n - 1),
        F.slice(ring, F.lit(2), n - 1),
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")),
    )


def polygon_edges(ring: Column, holes: Column | None = None) -> Column:
    """Edges of the outer ring and of any holes; parity tells them apart."""
    outer = edges(ring)
    if holes is None:
        return outer
    inner = F.flatten(F.transform(holes, lambda h: edges(h)))
    return F.concat(outer, F.coalesce(inner, F.slice(outer, 1, 0)))


def crosses(edge: Column, x: Column, y: Column) -> Column:
    """Whether a ray from (x, y) to the right meets the edge; no division."""
    up = edge["y2"] > edge["y1"]
    straddles = (edge["y1"] > y) != (edge["y2"] > y)
    cross = (edge["x2"] - edge["x1"]) * (y - edge["y1"]) - (x - edge["x1"]) * (edge["y2"] - edge["y1"])
    return straddles & F.when(up, cross > 0).otherwise(cross < 0)


def touches_edge(edge: Column, x: Column, y: Column) -> Column:
    """Whether the point lies exactly on the edge."""
    cross = (edge["x2"] - edge["x1"]) * (y - edge["y1"]) - (x - edge["x1"]) * (edge["y2"] - edge["y1"])
    return (
        (cross == 0)
        & x.between(F.least(edge["x1"], edge["x2"]), F.greatest(edge["x1"], edge["x2"]))
        & y.between(F.least(edge["y1"], edge["y2"]), F.greatest(edge["y1"], edge["y2"]))
    )


def within(edge_list: Column, x: Column, y: Column) -> Column:
    """Strictly inside by even-odd parity; holes may share the edge list."""
    crossings = F.size(F.filter(edge_list, lambda e: crosses(e, x, y)))
    on_border = F.exists(edge_list, lambda e: touches_edge(e, x, y))
    return (crossings % 2 == 1) & ~on_border


def signed_area(ring: Column) -> Column:
    """Shoelace area, positive when counter-clockwise."""
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + e["x1"] * e["y2"] - e["x2"] * e["y1"]) / 2


def centroid(ring: Column) -> tuple[Column, Column]:
    """Area centroid, computed relative to the first vertex for accuracy."""
    x0, y0 = F.element_at(ring, 1)["x"], F.element_at(ring, 1)["y"]
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"))

    def add(s: Column, e: Column) -> Column:
        ax, ay, bx, by = e["x1"] - x0, e["y1"] - y0, e["x2"] - x0, e["y2"] - y0
        w = ax * by - bx * ay
        return F.struct(
            (s["a"] + w).alias("a"), (s["cx"] + (ax + bx) * w).alias("cx"), (s["cy"] + (ay + by) * w).alias("cy")
        )

    sums = F.aggregate(edges(ring), zero, add)
    return x0 + F.try_divide(sums["cx"], 3 * sums["a"]), y0 + F.try_divide(sums["cy"], 3 * sums["a"])
