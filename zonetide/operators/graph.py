"""Zone graphs: edges, weights, repair, normalisation and one-hop sums."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonetide.functions import geo
from zonetide.functions.numbers import ratio
from zonetide.operators.joins import pairs_within_score
from zonetide.operators.spatial import at_all_levels, cells_around, level_of, sphere_cells
from zonetide.session import cut_lineage, spread_by


BLOCK = 256  # points of one cell that stand together


def _blocks(points: DataFrame, key: str, lat: str, lon: str, km: float, *kinds: str) -> DataFrame:
    """(_cell, _s, kinds, _b): points in blocks of about ``BLOCK``, written; ``kinds`` are columns on which the points of a block agree."""
    known = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn("_u", geo.unit_vector(F.col(lat), F.col(lon)))
    placed = known.withColumn("_cell", F.element_at(sphere_cells(F.col("_u"), level_of(geo.chord(F.lit(float(km))))), 1))
    crowds = placed.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_m"))
    point = F.struct(F.col(key).alias("id"), F.col(lat).alias("la"), F.col(lon).alias("lo"), "_u.x", "_u.y", "_u.z")
    dealt = placed.join(crowds, "_cell").withColumn("_s", F.floor(F.rand(7) * F.col("_m")))
    return cut_lineage(dealt.groupBy("_cell", "_s", *kinds).agg(F.collect_list(point).alias("_b")), "blocks")


def _within(a: Column, b: Column, km: float) -> Column:
    """Whether two points of blocks have an edge; far from ``km`` the straight distance tells."""
    reach = geo.chord(F.lit(float(km)))
    surely = F.greatest(reach * (1 - 2e-9) - 2e-12, F.lit(0.0))
    straight = sum((a[c] - b[c]) * (a[c] - b[c]) for c in "xyz")
    gap = geo.haversine_km(a["la"], a["lo"], b["la"], b["lo"])
    return (a["id"] != b["id"]) & (straight <= reach * reach) & ((straight < surely * surely) | (gap < km))


def _meet(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """Edges (src, dst, km) from the points of some blocks to those of others."""
    near = left.select(F.col("_cell").alias("_home"), F.col("_s").alias("_t"), F.col("_b").alias("_a"), F.explode(cells_around(F.col("_cell"))).alias("_cell"))
    pairs = spread_by(near.join(right.select("_cell", "_b"), "_cell"), "_home", "_t")
    met = pairs.select(F.explode("_a").alias("a"), "_b").select("a", F.explode("_b").alias("b"))
    gap = geo.haversine_km(F.col("a.la"), F.col("a.lo"), F.col("b.la"), F.col("b.lo"))
    return met.filter(_within(F.col("a"), F.col("b"), km)).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), gap.alias("km"))


def distance_edges(points: DataFrame, key: str, lat: str, lon: str, km: float, distinct: bool = False) -> DataFrame:
    """Directed edges between points less than ``km`` apart.

    Points meet in cells of the unit sphere as wide as the threshold; points without
    coordinates have no edge.  A cell is cut into blocks of about ``BLOCK`` points, and
    blocks are dealt over all tasks, so a crowded cell is the work of many and all edges of
    a point are made in one task.

    If ``distinct``, two keys have one edge each way, the shortest.  Keys that stand in one
    place, however often, can give no edge twice; only the edges of the others are grouped.
    """
    if not distinct:
        blocks = _blocks(points, key, lat, lon, km)
        return _meet(blocks, blocks, km)
    places = points.filter(F.col(key).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(key, lat, lon).distinct()
    moved = places.groupBy(key).agg((F.count(F.lit(1)) > 1).alias("_moved"))
    blocks = _blocks(places.join(moved, key), key, lat, lon, km, "_moved")
    still, rest = blocks.filter("not _moved"), blocks.filter("_moved")
    edges = _meet(still, still, km)
    if not rest.limit(1).count():
        return edges
    others = _meet(rest, blocks, km).unionByName(_meet(still, rest, km))
    return edges.unionByName(others.groupBy("src", "dst").agg(F.min("km").alias("km")))


def linked_points(points: DataFrame, key: str, lat: str, lon: str, km: float) -> DataFrame:
    """The keys of points with an edge of :func:`distance_edges`, without making the edges.

    A point looks for a first partner in its own block, and only if there is none in the
    other blocks of its cell and the cells around.
    """
    blocks = _blocks(points, key, lat, lon, km)
    partner = lambda a: F.coalesce(F.exists("_b", lambda b: _within(a, b, km)), F.lit(False))
    inside = F.transform("_b", lambda a: F.struct(a.alias("a"), partner(a).alias("hit")))
    looked = cut_lineage(blocks.select("_cell", F.inline(inside)), "looked")
    rest = looked.filter("not hit").select("_cell", "a").distinct()
    around = rest.select("a", F.explode(cells_around(F.col("_cell"))).alias("_cell")).join(blocks.select("_cell", "_b"), "_cell").filter(partner(F.col("a")))
    return looked.filter("hit").unionByName(around, allowMissingColumns=True).select(F.col("a.id").alias(key)).distinct()


def nearest_edges(points: DataFrame, key: str, lat: str, lon: str, k: int) -> DataFrame:
    """Directed edges to the k nearest points (ties: smaller id), exactly.

    Points with equal coordinates are first folded into one site that keeps its
    k + 1 smallest ids, so a pile of copies cannot produce all its pairs.  The
    smallest cell of the unit sphere around a site that holds k + 1 ids bounds the
    distance; the next larger cells around it hold everything within the bound.
    Points without coordinates have no edge.
    """
    rows = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(key).alias("_id"), F.col(lat).alias("_la"), F.col(lon).alias("_lo"))
    first = Window.partitionBy("_la", "_lo").orderBy("_id")
    kept = rows.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k + 1)
    sites = kept.groupBy("_la", "_lo").agg(F.array_sort(F.collect_list("_id")).alias("_ids")).withColumn("_u", geo.unit_vector(F.col("_la"), F.col("_lo")))
    placed = cut_lineage(at_all_levels(sites, "_u").drop("_u"), "sites")
    full = placed.groupBy("_k", "_cell").agg(F.sum(F.size("_ids")).alias("_n")).filter(F.col("_n") >= k + 1).drop("_n")
    # a cell is at most sqrt(3) wide across, so one level up its neighbours reach far enough
    level = placed.join(full, ["_k", "_cell"], "left_semi").groupBy("_la", "_lo").agg((F.max("_k") - 1).alias("_k"))
    start = placed.filter("_k = 0").select("_la", "_lo").join(level, ["_la", "_lo"], "left").withColumn("_k", F.greatest(F.coalesce("_k", F.lit(0)), F.lit(0)))
    ring = start.withColumn("_u", geo.unit_vector(F.col("_la"), F.col("_lo"))).withColumn("_cell", F.explode(sphere_cells(F.col("_u"), F.col("_k"), 1))).drop("_u")
    seats = placed.select("_k", "_cell", F.col("_la").alias("_lb"), F.col("_lo").alias("_lp"), "_ids")
    gap = geo.haversine_km(F.col("_la"), F.col("_lo"), F.col("_lb"), F.col("_lp"))
    nearest = Window.partitionBy("_la", "_lo").orderBy("_km", "_dst")
    done = (
        ring.join(seats, ["_k", "_cell"]).withColumn("_km", gap)
        .select("_la", "_lo", "_km", F.explode("_ids").alias("_dst"))
        # one more than k: the point itself is among the candidates
        .withColumn("_r", F.row_number().over(nearest)).filter(F.col("_r") <= k + 1)
        .groupBy("_la", "_lo").agg(F.array_sort(F.collect_list(F.struct("_km", "_dst"))).alias("_near"))
    )
    near = rows.join(done, ["_la", "_lo"])
    others = F.slice(F.filter("_near", lambda e: e["_dst"] != F.col("_id")), 1, k)
    return near.select(F.col("_id").alias("src"), F.posexplode(others).alias("_p", "e")).select(
        "src", F.col("e._dst").alias("dst"), F.col("e._km").alias("km"), (F.col("_p") + 1).alias("pos")
    )


def inverse_weights(edges: DataFrame, km: str = "km") -> DataFrame:
    return edges.withColumn("weight", 1 / (1 + F.col(km)))


def with_self_loops(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    return edges.select("src", "dst").unionByName(nodes.select(F.col(key).alias("src"), F.col(key).alias("dst")))


def same_label_edges(nodes: DataFrame, key: str, label: str, k: int = 3, seed: int = 7) -> DataFrame:
    """Up to k reproducible pseudo-random partners inside each label group.

    Members of a label stand on a ring in the order of a seeded hash and link to
    the next k on it, so a group of any size has k links per node and never its
    pairs.  The ring is cut into 256 arcs that are ordered by separate tasks; an
    arc passes over to the first members of the arcs that follow.
    """
    spot = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))
    arc = F.conv(F.substring(spot, 1, 2), 16, 10).cast("int")
    placed = nodes.filter(F.col(label).isNotNull()).select(F.col(key).alias("src"), F.col(label).alias("label"), spot.alias("_h"), arc.alias("_a"))
    order = Window.partitionBy("label", "_a").orderBy("_h", "src")
    heads = placed.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).select("label", "_a", "_r", "src")
    # at most 256 * k heads per label, laid out twice so the ring closes
    turns = heads.withColumn("_turn", F.explode(F.array(F.lit(0), F.lit(256))))
    spots = F.struct((F.col("_a") + F.col("_turn")).alias("at"), F.col("_r").alias("r"), F.col("src").alias("id"))
    rings = turns.groupBy("label").agg(F.array_sort(F.collect_list(spots)).alias("_ring"))
    after = F.transform(F.slice(F.filter("_ring", lambda e: e["at"] > F.col("_a")), 1, k), lambda e: e["id"])
    beyond = heads.select("label", "_a").distinct().join(rings, "label").select("label", "_a", after.alias("_beyond"))
    own = F.collect_list("src").over(order.rowsBetween(1, k))
    linked = placed.withColumn("_own", own).join(beyond, ["label", "_a"])
    others = F.array_distinct(F.filter(F.slice(F.concat("_own", "_beyond"), 1, k), lambda s: s != F.col("src")))
    return linked.select("src", F.explode(others).alias("dst"), "label")


def score_edges(nodes: DataFrame, key: str, score: str, least: float = 0.3) -> DataFrame:
    """Both directions where 1 / (1 + |difference|) is above ``least``."""
    pairs = pairs_within_score(nodes, key, score, 1 / least - 1)
    weight = 1 / (1 + F.abs(F.col("sa") - F.col("sb")))
    pairs = pairs.withColumn("weight", weight).filter(F.col("weight") > least)
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight").unionByName(
        pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "weight")
    )


def mean_vectors(vectors: DataFrame, zone: str, vector: str) -> DataFrame:
    """Mean vector per zone, averaged element by element."""
    cells = vectors.select(zone, F.posexplode(vector).alias("i", "v"))
    means = cells.groupBy(zone, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return means.groupBy(zone).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("vector"))


PIVOTS = 64  # at most so many vectors stand for the others
SAMPLED = 8  # vectors looked at for each pivot


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)


def _angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))


ROUNDING = 1e-6  # of an angle


def _spread(units: list[list[float]], wanted: int) -> list[list[float]]:
    """Vectors far from one another: each next one is the furthest from those chosen."""
    x = np.array(units)
    chosen = [0] if units else []
    while len(chosen) < min(wanted, len(units)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    return [units[i] for i in chosen]


def _near_pivots(zone_vectors: DataFrame, zone: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Unit vectors with their nearest pivot and the angles to all, and (pivot, reach) of the pivots.

    Pivots are the root of the number of vectors but at most ``PIVOTS``, each the furthest
    from those before it among ``SAMPLED`` times as many vectors picked by a hash;
    ``reach`` is the angle of the furthest vector nearest to a pivot.
    """
    norm = F.sqrt(_dot(F.col(vector), F.col(vector)))
    base = zone_vectors.select(F.col(zone).alias("_id"), vector, norm.alias("_n")).filter("_n > 0")
    base = cut_lineage(base.select("_id", F.transform(vector, lambda x: x / F.col("_n")).alias("_u")), "units")
    wanted = max(1, min(PIVOTS, int(base.count() ** 0.5)))
    picked = _spread([r["_u"] for r in base.orderBy(F.xxhash64("_id"), "_id").limit(wanted * SAMPLED).collect()], wanted)
    pivots = F.array(*(F.array(*(F.lit(x) for x in u)) for u in picked)) if picked else F.array().cast("array<array<double>>")
    placed = base.withColumn("_angles", F.transform(pivots, lambda p: _angle(_dot(F.col("_u"), p))))
    placed = cut_lineage(placed.withColumn("_p", F.array_position("_angles", F.array_min("_angles")).cast("int")), "placed")
    return placed, placed.groupBy("_p").agg(F.max(F.array_min("_angles")).alias("_reach"), F.count(F.lit(1)).alias("_m"))


def _met(visits: DataFrame, placed: DataFrame) -> DataFrame:
    """Pairs of visitors and the vectors whose pivot they visit."""
    home = placed.select("_p", F.col("_id").alias("dst"), F.col("_u").alias("_w"))
    pairs = visits.join(home, "_p").filter(F.col("_id") != F.col("dst"))
    return pairs.select(F.col("_id").alias("src"), "dst", _dot(F.col("_u"), F.col("_w")).alias("cosine"))


def cosine_candidates(placed: DataFrame, reaches: DataFrame, least: float) -> DataFrame:
    """Pairs (src, dst, cosine) that the angles to the pivots allow to be as near as ``least``."""
    widest = F.acos(F.lit(float(max(-1.0, min(1.0, least))))) + ROUNDING
    toward = placed.select("_id", "_u", F.posexplode("_angles").alias("_i", "_a")).withColumn("_p", F.col("_i") + 1)
    return _met(toward.join(reaches, "_p").filter(F.col("_a") - F.col("_reach") <= widest), placed)


def cosine_edges(zone_vectors: DataFrame, zone: str, vector: str, least: float = 0.3, fallback_k: int = 5) -> DataFrame:
    """Both directions where the cosine of two zones is above ``least``.

    By the triangle inequality of angles a vector only visits the pivots near enough to
    have a partner nearest to them.  Where no pair passes, each zone links to its
    ``fallback_k`` most similar ones, ties to the smaller: those nearest to its own
    pivot bound what else has to be visited.  Vectors that are null or zero have no edge.
    """
    placed, reaches = _near_pivots(zone_vectors, zone, vector)
    edges = cut_lineage(cosine_candidates(placed, reaches, least).filter(F.col("cosine") > least), "edges")
    if edges.limit(1).count():
        return edges
    best = Window.partitionBy("src").orderBy(F.col("cosine").desc(), "dst")
    first = _met(placed.select("_id", "_u", "_p"), placed).withColumn("_r", F.row_number().over(best)).filter(F.col("_r") == fallback_k)
    bounds = cut_lineage(first.select(F.col("src").alias("_id"), (_angle(F.col("cosine")) + ROUNDING).alias("_bound")), "bounds")
    toward = placed.join(bounds, "_id", "left").select("_id", "_u", "_bound", F.posexplode("_angles").alias("_i", "_a")).withColumn("_p", F.col("_i") + 1)
    near = toward.join(reaches, "_p").filter(F.col("_bound").isNull() | (F.col("_a") - F.col("_reach") <= F.col("_bound")))
    return _met(near.select("_id", "_u", "_p"), placed).withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= fallback_k).drop("_r")


def attach_isolated(edges: DataFrame, nodes: DataFrame, key: str, roots: Sequence, linked: DataFrame | None = None, distinct: bool = False) -> DataFrame:
    """Link nodes without any edge to the given root nodes, both ways; distinct links.

    The ends of all edges come from one pass, each edge giving an array of two, unless
    ``linked`` has them as (key); they are written.  ``distinct`` says that no edge comes
    twice, so that the edges need not be shuffled to tell.  A new link has an end without
    any edge, so it is not among the edges.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias(key)).distinct() if linked is None else linked.select(key)
    seen = cut_lineage(ends, "seen")
    alone = nodes.select(key).distinct().join(seen, key, "left_anti")
    repair = alone.select(F.col(key).alias("src"), F.explode(F.array(*[F.lit(r) for r in roots])).alias("dst")).filter(F.col("src") != F.col("dst"))
    both = repair.unionByName(repair.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    links = edges.select("src", "dst")
    return (links if distinct else links.distinct()).unionByName(both.distinct())


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def graph_stats(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """One row: nodes, edges, density, mean degree and the weight range."""
    n = nodes.select(F.count_distinct(key)).scalar()
    return edges.agg(
        F.count(F.lit(1)).alias("edges"), F.min("weight").alias("min_weight"),
        F.max("weight").alias("max_weight"), F.avg("weight").alias("mean_weight"),
    ).withColumn("nodes", n).withColumn("density", ratio(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1))).withColumn(
        "mean_degree", ratio(F.col("edges"), F.col("nodes"))
    )


def normalise(edges: DataFrame, eps: float = 1e-8) -> DataFrame:
    """weight / sqrt((d_src + eps) (d_dst + eps)) with row sums as degrees.

    The degrees are written, so that their known size decides whether the edges have to
    be shuffled for them; the edges, far more, are not.
    """
    d = cut_lineage(edges.groupBy(F.col("src").alias("_k")).agg(F.sum("weight").alias("_d")), "degrees")
    src = d.select(F.col("_k").alias("src"), F.col("_d").alias("_ds"))
    dst = d.select(F.col("_k").alias("dst"), F.col("_d").alias("_dd"))
    scale = F.sqrt(F.col("_ds") + eps) * F.sqrt(F.coalesce(F.col("_dd"), F.lit(0.0)) + eps)
    return edges.join(src, "src").join(dst, "dst", "left").select("src", "dst", (F.col("weight") / scale).alias("weight"))


def hop(panel: DataFrame, edges: DataFrame, zone: str, date: str, values: Sequence[str]) -> DataFrame:
    """Weighted sum over the neighbours of each zone, per date.

    The panel is written with one row per zone, so that its known size decides whether the
    edges have to be shuffled to meet it, and so that they meet it once, not once per date.
    """
    days = F.collect_list(F.struct(date, *values)).alias("_days")
    packed = cut_lineage(panel.groupBy(F.col(zone).alias("dst")).agg(days), "packed")
    return (
        edges.join(packed, "dst").select("src", "weight", F.inline("_days"))
        .groupBy("src", date)
        .agg(*[F.sum(F.col("weight") * F.col(v)).alias(v) for v in values])
        .withColumnRenamed("src", zone)
    )


def hops(panel: DataFrame, edges: DataFrame, zone: str, date: str, values: Sequence[str], k: int) -> DataFrame:
    """The one-hop sum applied k times; lineage is cut between the rounds."""
    for _ in range(k):
        panel = cut_lineage(hop(panel, edges, zone, date, values), "hop")
    return panel


def slice_edges(edges: DataFrame, keep: DataFrame, key: str) -> DataFrame:
    """Edges with both ends among the kept nodes."""
    src = keep.select(F.col(key).alias("src")).distinct()
    dst = keep.select(F.col(key).alias("dst")).distinct()
    return edges.join(src, "src", "left_semi").join(dst, "dst", "left_semi")
