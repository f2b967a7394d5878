"""Exact overlay areas of polygons, with holes and any number of parts.

A polygon is the signed sum of the regions below its edges: an edge with the inside
below it counts plus, one with the inside above it minus, and holes count the other way.
So the common area of two polygons is the sum, over pairs of edges, of the product of
signs and the integral of the lower edge over their common stretch of x.  Nothing is
clipped: polygons whose boxes meet are paired through grid cells, edges of a pair are
joined by strips of x, and the rest is a grouped sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonetide.functions import geo
from zonetide.operators.ranking import keep_first
from zonetide.session import cut_lineage

LEAST_SHARE = 1e-9  # common areas below this share of a zone are rounding


def _lengths(ring: str) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)


def polygon_area(ring: Column, holes: Column | None = None) -> Column:
    """Area of the outer ring without its holes, whichever way they run."""
    area = F.abs(geo.signed_area(ring))
    if holes is None:
        return area
    return area - F.coalesce(F.aggregate(holes, F.lit(0.0), lambda s, h: s + F.abs(geo.signed_area(h))), F.lit(0.0))


def _signed_edges(ring: Column, holes: Column | None) -> Column:
    """Edges that are not vertical, from left to right, with the sign of the region below."""

    def signed(r: Column, inner: bool) -> Column:
        turn = F.signum(geo.signed_area(r)) * (-1.0 if inner else 1.0)

        def edge(e: Column) -> Column:
            back = e["x1"] > e["x2"]
            pick = lambda a, b: F.when(back, e[a]).otherwise(e[b])
            return F.struct(
                pick("x2", "x1").alias("xl"), pick("y2", "y1").alias("yl"), pick("x1", "x2").alias("xr"), pick("y1", "y2").alias("yr"),
                (turn * F.when(back, 1.0).otherwise(-1.0)).alias("s"),
            )

        return F.transform(F.filter(geo.edges(r), lambda e: e["x1"] != e["x2"]), edge)

    outer = signed(ring, False)
    if holes is None:
        return outer
    return F.concat(outer, F.coalesce(F.flatten(F.transform(holes, lambda h: signed(h, True))), F.slice(outer, 1, 0)))


def _numbered(polygons: DataFrame, key: str, ring: str, holes: str | None, name: str) -> DataFrame:
    """Polygons with a number, their box and their signed edges, written once."""
    x0, x1, y0, y1 = _lengths(ring)
    rows = polygons.filter(F.size(ring) >= 3).select(
        F.col(key).alias(name), F.monotonically_increasing_id().alias("_id"), x0.alias("_x0"), x1.alias("_x1"), y0.alias("_y0"), y1.alias("_y1"),
        _signed_edges(F.col(ring), None if holes is None else F.col(holes)).alias("_e"),
    )
    return cut_lineage(rows, "polygons")


def _width(polygons: DataFrame, length: Column) -> float:
    median = polygons.select(F.percentile_approx(length, 0.5)).first()[0]
    return float(median) or 1.0 if median is not None else 1.0


def _pieces(polygons: DataFrame, strip: float) -> DataFrame:
    """Edges cut at the borders of strips."""
    e = polygons.select("_id", F.explode("_e").alias("e")).select("_id", "e.*")
    e = e.withColumn("_strip", F.explode(F.sequence(F.floor(F.col("xl") / strip), F.floor(F.col("xr") / strip))))
    lo, hi = F.greatest("xl", F.col("_strip") * F.lit(strip)), F.least("xr", (F.col("_strip") + 1) * F.lit(strip))
    at = lambda x: F.col("yl") + (F.col("yr") - F.col("yl")) * ((x - F.col("xl")) / (F.col("xr") - F.col("xl")))
    return e.select("_id", "_strip", lo.alias("xl"), at(lo).alias("yl"), hi.alias("xr"), at(hi).alias("yr"), "s").filter("xr > xl")


def overlay_areas(
    left: DataFrame, left_key: str, right: DataFrame, right_key: str, ring: str, left_holes: str | None = None, right_holes: str | None = None,
) -> DataFrame:
    """(left_key, right_key, area) of the keys whose polygons share area.

    Rows of one key add up, so overlapping polygons of one key count once each.  Rings
    may run either way and be closed or open; they do not cross themselves.  Null rings
    and rings of fewer than three corners have no area.
    """
    a, b = _numbered(left, left_key, ring, left_holes, "_ka"), _numbered(right, right_key, ring, right_holes, "_kb")
    wide, high = F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0")
    cell = max(_width(a, F.greatest(wide, high)), _width(b, F.greatest(wide, high)))
    boxes = ["_id", "_x0", "_x1", "_y0", "_y1"]

    def spread(p: DataFrame) -> DataFrame:
        cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
        return p.select(*boxes).withColumn("_cx", F.explode(cells("_x0", "_x1"))).withColumn("_cy", F.explode(cells("_y0", "_y1")))

    other = spread(b).select("_cx", "_cy", *(F.col(c).alias(f"{c}b") for c in boxes))
    meet = (F.col("_x0") < F.col("_x1b")) & (F.col("_x0b") < F.col("_x1")) & (F.col("_y0") < F.col("_y1b")) & (F.col("_y0b") < F.col("_y1"))
    pairs = spread(a).join(other, ["_cx", "_cy"]).filter(meet).select("_id", "_idb", F.greatest("_y0", "_y0b").alias("_base")).distinct()

    strip = max(_width(a, wide), _width(b, wide)) / 4
    mine, theirs = _pieces(a, strip), _pieces(b, strip).select("_strip", *(F.col(c).alias(f"{c}b") for c in ("_id", "xl", "yl", "xr", "yr", "s")))
    both = pairs.join(mine, "_id").join(theirs, ["_idb", "_strip"])
    lo, hi = F.greatest("xl", "xlb"), F.least("xr", "xrb")
    both = both.withColumn("_lo", lo).withColumn("_hi", hi).filter("_hi > _lo")

    def height(x: str, t: str) -> Column:
        return F.col(f"yl{t}") + (F.col(f"yr{t}") - F.col(f"yl{t}")) * ((F.col(x) - F.col(f"xl{t}")) / (F.col(f"xr{t}") - F.col(f"xl{t}"))) - F.col("_base")

    both = both.select("_id", "_idb", (F.col("s") * F.col("sb") * (F.col("_hi") - F.col("_lo"))).alias("w"), height("_lo", "").alias("a0"), height("_hi", "").alias("a1"), height("_lo", "b").alias("b0"), height("_hi", "b").alias("b1"))
    # the lower of two lines: their mean less half the mean distance, which has a corner where they cross
    d0, d1 = F.col("a0") - F.col("b0"), F.col("a1") - F.col("b1")
    apart = F.when(d0 * d1 >= 0, (F.abs(d0) + F.abs(d1)) / 2).otherwise((d0 * d0 + d1 * d1) / (2 * (F.abs(d0) + F.abs(d1))))
    lower = (F.col("a0") + F.col("a1") + F.col("b0") + F.col("b1")) / 4 - apart / 2
    per_pair = both.groupBy("_id", "_idb").agg(F.sum(F.col("w") * lower).alias("_area"))
    named = per_pair.join(a.select("_id", F.col("_ka").alias(left_key)), "_id").join(b.select(F.col("_id").alias("_idb"), F.col("_kb").alias(right_key)), "_idb")
    return named.groupBy(left_key, right_key).agg(F.sum("_area").alias("area"))


def dominance(
    zones: DataFrame, zone: str, labels: DataFrame, label: str, ring: str, neutral: str = "NEUTRO", dispute: str = "DISPUTA",
    holes: str | None = None, label_holes: str | None = None,
) -> DataFrame:
    """(zone, dominant, degree): the label with the largest common area and its share of the zone.

    A zone that shares no area with a label is neutral; one of which the disputed area
    is more than half the largest is in dispute.  Equal areas go to the smaller label.
    Zones without area are neutral.
    """
    size = polygon_area(F.col(ring), None if holes is None else F.col(holes))
    sizes = zones.groupBy(zone).agg(F.sum(F.coalesce(size, F.lit(0.0))).alias("_total"))
    areas = overlay_areas(zones, zone, labels, label, ring, holes, label_holes)
    shares = areas.join(sizes, zone).withColumn("_n", F.col("area") / F.col("_total")).filter(F.col("_n") > LEAST_SHARE).select(zone, label, F.round("_n", 12).alias("_n"))
    shares = cut_lineage(shares, "shares")
    dispute_n = shares.filter(F.col(label) == dispute).select(zone, F.col("_n").alias("_d"))
    top = keep_first(shares, [zone], [F.col("_n").desc(), F.col(label)])
    picked = F.when(F.col("_n").isNull(), neutral).when(F.coalesce("_d", F.lit(0.0)) > F.col("_n") * 0.5, dispute).otherwise(F.col(label))
    return sizes.join(top, zone, "left").join(dispute_n, zone, "left").select(zone, picked.alias("dominant"), F.coalesce("_n", F.lit(0.0)).alias("degree"))
