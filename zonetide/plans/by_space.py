"""X* and GR*: geometry and zone graphs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from zonetide.functions import geo
from zonetide.operators import graph, outlines, overlay, spatial
from zonetide.plans.registry import query
from zonetide.plans.views import with_sql

KM = "2 * 6371.0 * asin(sqrt(least(1, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))))"
KM_AB = KM.format(a="a.", b="b.")


@query("x1_point_in_polygon", with_sql("pip", "SELECT id, poly FROM pip"))
def _(v):
    return spatial.points_in_polygons(v.point(), v.polygon(), "poly", "ring", "lon", "lat").select("id", "poly")


@query("x1_point_in_polygon_left", with_sql("pip", "SELECT pt.id, coalesce(pip.poly, -1) AS poly FROM pt LEFT JOIN pip ON pip.id = pt.id"))
def _(v):
    hits = spatial.points_in_polygons(v.point(), v.polygon(), "poly", "ring", "lon", "lat", how="left")
    return hits.select("id", F.coalesce("poly", F.lit(-1)).alias("poly"))


@query("x1_first_match_default", with_sql("pip", "SELECT pt.id, coalesce(min(CAST(pip.poly AS VARCHAR)), 'SEM_AID') AS poly FROM pt LEFT JOIN pip ON pip.id = pt.id GROUP BY pt.id"))
def _(v):
    return spatial.first_zone(v.point(), v.polygon(), "id", "poly", "ring", "lon", "lat", "SEM_AID")


@query(
    "x2_nearest_fallback",
    with_sql(
        "pip cen",
        f"SELECT a.id, coalesce(pip.poly, n.poly) AS poly, pip.poly IS NULL AS fallback FROM pt a LEFT JOIN pip ON pip.id = a.id JOIN (SELECT a.id, arg_min(b.poly, ({KM_AB.replace('b.lat', 'b.y').replace('b.lon', 'b.x')}, b.poly)) AS poly FROM pt a CROSS JOIN cen b GROUP BY a.id) n ON n.id = a.id",
    ),
)
def _(v):
    return spatial.assign_zones(v.point(), v.polygon(), "id", "poly", "ring", "lon", "lat")


@query("x2_nearest_site", with_sql("pt cen", f"SELECT id, poly, km FROM (SELECT a.id, b.poly, {KM_AB.replace('b.lat', 'b.y').replace('b.lon', 'b.x')} AS km, row_number() OVER (PARTITION BY a.id ORDER BY {KM_AB.replace('b.lat', 'b.y').replace('b.lon', 'b.x')}, b.poly) AS rn FROM pt a CROSS JOIN cen b) WHERE rn = 1", "km"))
def _(v):
    seats = spatial.centroids(v.polygon(), "poly", "ring").select("poly", F.col("x").alias("lon"), F.col("y").alias("lat"))
    return spatial.nearest_sites(v.point(), seats, "id", "poly", "lon", "lat")


_LOST = "p0 AS (SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE lon END AS lon, CASE WHEN id % 11 = 0 THEN NULL ELSE lat END AS lat FROM pt)"


@query(
    "x2_nearest_missing_coordinates",
    with_sql(
        "pip cen",
        f"SELECT a.id, CASE WHEN a.lon IS NULL OR a.lat IS NULL THEN NULL ELSE coalesce(pip.poly, n.poly) END AS poly, CASE WHEN a.lon IS NULL OR a.lat IS NULL THEN FALSE ELSE pip.poly IS NULL END AS fallback FROM p0 a LEFT JOIN pip ON pip.id = a.id JOIN (SELECT a.id, arg_min(b.poly, ({KM_AB.replace('b.lat', 'b.y').replace('b.lon', 'b.x')}, b.poly)) AS poly FROM pt a CROSS JOIN cen b GROUP BY a.id) n ON n.id = a.id",
        extra=_LOST,
    ),
)
def _(v):
    """Points without a coordinate are in no zone and near none."""
    lost = v.point().withColumn("lon", F.when(F.col("id") % 7 != 0, F.col("lon"))).withColumn("lat", F.when(F.col("id") % 11 != 0, F.col("lat")))
    return spatial.assign_zones(lost, v.polygon(), "id", "poly", "ring", "lon", "lat")


@query("x3_centroid", with_sql("cen", "SELECT poly, x, y FROM cen", "x y"))
def _(v):
    return spatial.centroids(v.polygon(), "poly", "ring")


# Areas by horizontal slabs: between two heights at which anything changes, the width both
# polygons share is linear, so its middle gives the area.  The polygons are convex.
_LABEL_EDGES = (
    "lc AS (SELECT CASE WHEN r_regionkey = 2 THEN 'DISPUTA' ELSE r_name END AS label, c.pos, x0 + (x1 - x0) * (r_regionkey + c.st) / 5.0 + (x1 - x0) * c.lean AS x, CASE WHEN c.top THEN y1 ELSE y0 END AS y FROM region, box, (VALUES (0, 0, 0.1, FALSE), (1, 1, 0.1, FALSE), (2, 1, -0.1, TRUE), (3, 0, -0.1, TRUE)) c(pos, st, lean, top)), "
    "le AS (SELECT a.label, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM lc a JOIN lc b ON a.label = b.label AND b.pos = (a.pos + 1) % 4)"
)
_AREAS = _LABEL_EDGES + (
    ", xx AS (SELECT e.poly, l.label, e.y1, e.y2, (l.x1 - e.x1) * (l.y2 - l.y1) - (l.y1 - e.y1) * (l.x2 - l.x1) AS num, (e.x2 - e.x1) * (l.y2 - l.y1) - (e.y2 - e.y1) * (l.x2 - l.x1) AS den FROM edge e, le l), "
    "cross_y AS (SELECT poly, label, y1 + (y2 - y1) * num / den AS y, num / den AS t FROM xx WHERE abs(den) > 1e-15), "
    "lev AS (SELECT poly, label, y1 AS y FROM edge, (SELECT DISTINCT label FROM le) UNION SELECT poly, label, le.y1 FROM le, (SELECT DISTINCT poly FROM edge) UNION SELECT poly, label, y FROM cross_y WHERE t >= 0 AND t <= 1), "
    "slab AS (SELECT poly, label, y AS lo, lead(y) OVER (PARTITION BY poly, label ORDER BY y) AS hi FROM lev), "
    "zs AS (SELECT s.poly, s.label, lo, hi, min(x1 + (x2 - x1) * ((lo + hi) / 2 - y1) / (y2 - y1)) AS zl, max(x1 + (x2 - x1) * ((lo + hi) / 2 - y1) / (y2 - y1)) AS zr FROM slab s JOIN edge e ON e.poly = s.poly AND (y1 > (lo + hi) / 2) <> (y2 > (lo + hi) / 2) WHERE hi > lo GROUP BY ALL), "
    "bs AS (SELECT z.*, min(x1 + (x2 - x1) * ((lo + hi) / 2 - y1) / (y2 - y1)) AS ll, max(x1 + (x2 - x1) * ((lo + hi) / 2 - y1) / (y2 - y1)) AS lr FROM zs z JOIN le e ON e.label = z.label AND (y1 > (lo + hi) / 2) <> (y2 > (lo + hi) / 2) GROUP BY ALL), "
    "ar AS (SELECT poly, label, sum((hi - lo) * greatest(0, least(zr, lr) - greatest(zl, ll))) AS area FROM bs GROUP BY 1, 2)"
)


@query("x4_overlay_area", with_sql("edge", "SELECT poly, label, area FROM ar WHERE area > 1e-6", "area", extra=_AREAS))
def _(v):
    return overlay.overlay_areas(v.polygon(), "poly", v.label_polygon(), "label", "ring").filter("area > 1e-6")


@query(
    "x4_dominance",
    with_sql(
        "edge",
        "SELECT z.poly, CASE WHEN tp.area IS NULL THEN 'NEUTRO' WHEN coalesce(d.area, 0) > tp.area * 0.5 THEN 'DISPUTA' ELSE tp.label END AS dominant, coalesce(tp.area / z.total, 0) AS degree FROM "
        "(SELECT poly, abs(sum(x1 * y2 - x2 * y1)) / 2 AS total FROM edge GROUP BY poly) z LEFT JOIN (SELECT poly, label, area FROM ar WHERE area > 1e-9 QUALIFY row_number() OVER (PARTITION BY poly ORDER BY area DESC, label) = 1) tp ON tp.poly = z.poly "
        "LEFT JOIN ar d ON d.poly = z.poly AND d.label = 'DISPUTA'",
        "degree",
        extra=_AREAS,
    ),
)
def _(v):
    return overlay.dominance(v.polygon(), "poly", v.label_polygon(), "label", "ring")


@query("x5_touching_vertex", with_sql("cor", "SELECT DISTINCT a.poly AS src, b.poly AS dst FROM cor a JOIN cor b ON round(a.x, 7) = round(b.x, 7) AND round(a.y, 7) = round(b.y, 7) AND a.poly <> b.poly"))
def _(v):
    return spatial.touching(v.polygon(), "poly", "ring", "vertex")


@query(
    "x5_touching_edge",
    with_sql("edge", "SELECT DISTINCT a.poly AS src, b.poly AS dst FROM edge a JOIN edge b ON round(a.x1, 7) = round(b.x2, 7) AND round(a.y1, 7) = round(b.y2, 7) AND round(a.x2, 7) = round(b.x1, 7) AND round(a.y2, 7) = round(b.y1, 7) AND a.poly <> b.poly"),
)
def _(v):
    return spatial.touching(v.polygon(), "poly", "ring", "edge")


# Bricks of width 2: every second row is shifted by half, so borders meet in T shapes.
_BRICKS = "br AS (SELECT n_nationkey AS poly, 2.0 * (n_nationkey % 5) + (n_nationkey // 5) % 2 AS bx, 1.0 * (n_nationkey // 5) AS byy FROM nation)"


def _bricks(v):
    k = F.col("n_nationkey")
    x, y = (k % 5) * 2.0 + F.floor(k / 5) % 2, F.floor(k / 5) * 1.0
    corner = lambda dx, dy: F.struct((x + dx).cast("double").alias("x"), (y + dy).cast("double").alias("y"))
    return v.table("nation").select(k.alias("poly"), F.array(corner(0, 0), corner(2, 0), corner(2, 1), corner(0, 1)).alias("ring"))


@query(
    "x5_touching_border",
    with_sql("", "WITH " + _BRICKS + " SELECT a.poly AS src, b.poly AS dst FROM br a JOIN br b ON a.poly <> b.poly AND ((a.byy = b.byy AND abs(a.bx - b.bx) = 2) OR (abs(a.byy - b.byy) = 1 AND abs(a.bx - b.bx) < 2))"),
)
def _(v):
    return spatial.touching(_bricks(v), "poly", "ring", "border")


def _bands(v, edge):
    """Two labels: everything below a height and everything above it."""
    box = lambda y0, y1: F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-5.0, y0), (50.0, y0), (50.0, y1), (-5.0, y1))])
    both = F.array(F.struct(F.lit("low").alias("label"), box(-5.0, edge).alias("ring")), F.struct(F.lit("high").alias("label"), box(edge, 50.0).alias("ring")))
    return v.table("region").filter("r_regionkey = 0").select(F.explode(both).alias("l")).select("l.*")


def _band_sql(edge: float, hole: float) -> str:
    """Areas of bricks with a hole of ``hole`` by ``hole`` in the middle, below and above a height."""
    low = f"2 * greatest(0, least(1, {edge} - byy)) - {hole} * greatest(0, least({hole}, {edge} - byy - {(1 - hole) / 2}))"
    return (
        f"WITH {_BRICKS}, a AS (SELECT CAST(poly % 5 AS BIGINT) AS zone, sum({low}) AS low, sum(2 - {hole * hole}) AS total FROM br GROUP BY 1) "
        "SELECT zone, CASE WHEN low > total - low THEN 'low' ELSE 'high' END AS dominant, round(greatest(low, total - low) / total, 6) + 0.0 AS degree FROM a"
    )


@query("x4_dominance_of_parts", with_sql("", _band_sql(1.9, 0)))
def _(v):
    """Zones of five parts, one per row of bricks, against two labels."""
    zones = _bricks(v).select((F.col("poly") % 5).cast("bigint").alias("zone"), "ring")
    return overlay.dominance(zones, "zone", _bands(v, 1.9), "label", "ring")


@query("x4_dominance_with_holes", with_sql("", _band_sql(3.6, 0.5)))
def _(v):
    """The same zones with a hole in every brick; the band ends inside the holes of one row."""
    corner = lambda dx, dy: F.struct((F.col("ring")[0]["x"] + dx).alias("x"), (F.col("ring")[0]["y"] + dy).alias("y"))
    hole = F.array(corner(0.75, 0.25), corner(1.25, 0.25), corner(1.25, 0.75), corner(0.75, 0.75))
    zones = _bricks(v).select((F.col("poly") % 5).cast("bigint").alias("zone"), "ring", F.array(hole).alias("holes"))
    return overlay.dominance(zones, "zone", _bands(v, 3.6), "label", "ring", holes="holes")


@query("x6_haversine", with_sql("pip cen", f"SELECT a.id, {KM_AB.replace('b.lat', 'b.y').replace('b.lon', 'b.x')} AS km FROM pt a JOIN pip ON pip.id = a.id JOIN cen b ON b.poly = pip.poly", "km"))
def _(v):
    polys = v.polygon()
    hits = spatial.points_in_polygons(v.point(), polys, "poly", "ring", "lon", "lat")
    rows = hits.join(spatial.centroids(polys, "poly", "ring"), "poly")
    return rows.select("id", geo.haversine_km(F.col("lat"), F.col("lon"), F.col("y"), F.col("x")).alias("km"))


@query("x7_point_struct", with_sql("pt", "SELECT id, lon AS px, lat AS py FROM pt", "px py"))
def _(v):
    return spatial.with_point(v.point(), "lon", "lat").select("id", F.col("point.x").alias("px"), F.col("point.y").alias("py"))


@query(
    "x8_thin_vertices",
    with_sql(
        "cor",
        "SELECT poly, CAST(pos AS INTEGER) AS pos, x, y FROM kept WHERE keep",
        "x y",
        extra="kept AS (SELECT poly, pos, x, y, x AS kx, y AS ky, TRUE AS keep FROM cor WHERE pos = 0 UNION ALL SELECT c.poly, c.pos, c.x, c.y, CASE WHEN far THEN c.x ELSE kx END, CASE WHEN far THEN c.y ELSE ky END, far "
        "FROM (SELECT c.*, k.kx, k.ky, sqrt(pow(c.x - k.kx, 2) + pow(c.y - k.ky, 2)) >= 0.14 AS far FROM kept k JOIN cor c ON c.poly = k.poly AND c.pos = k.pos + 1) c)",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
)
def _(v):
    return spatial.thin_vertices(v.polygon(), "poly", "ring", 0.14)


# A ring per label: its vectors in order of their ids, at equal angles, as far out as their first component says.
_STAR = (
    "vx AS (SELECT poly, pos, n, (1 + e) * cos(2 * pi() * pos / n) AS x, (1 + e) * sin(2 * pi() * pos / n) AS y FROM (SELECT label AS poly, CAST(embedding[1] AS DOUBLE) AS e, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY label) AS n FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))), "
    "cl AS (SELECT poly, pos, x, y FROM vx UNION ALL SELECT poly, n, x, y FROM vx WHERE pos = 0), "
)
_OFF = "sqrt(pow(c.x - (s.ax + t * (s.bx - s.ax)), 2) + pow(c.y - (s.ay + t * (s.by - s.ay)), 2))"
_SPLIT = _STAR + (
    "st AS (SELECT poly, arg_max(pos, (d, -pos)) AS f, any_value(n) AS n FROM (SELECT v.poly, v.pos, v.n, pow(v.x - o.x, 2) + pow(v.y - o.y, 2) AS d FROM vx v JOIN vx o ON o.poly = v.poly AND o.pos = 0 WHERE v.pos > 0) GROUP BY poly), "
    "seg AS (SELECT poly, CAST(0 AS BIGINT) AS a, f AS b FROM st UNION ALL SELECT poly, f, n FROM st UNION ALL "
    "SELECT poly, unnest([a, k]) AS a, unnest([k, b]) AS b FROM (SELECT poly, a, b, -w.k AS k FROM (SELECT poly, a, b, max({'d': d, 'k': -pos}) AS w FROM (SELECT s.poly, s.a, s.b, c.pos, "
    "greatest(0, least(1, ((c.x - s.ax) * (s.bx - s.ax) + (c.y - s.ay) * (s.by - s.ay)) / (pow(s.bx - s.ax, 2) + pow(s.by - s.ay, 2)))) AS t, " + _OFF + " AS d "
    "FROM (SELECT g.poly, g.a, g.b, p.x AS ax, p.y AS ay, q.x AS bx, q.y AS by FROM seg g JOIN cl p ON p.poly = g.poly AND p.pos = g.a JOIN cl q ON q.poly = g.poly AND q.pos = g.b) s JOIN cl c ON c.poly = s.poly AND c.pos > s.a AND c.pos < s.b) GROUP BY poly, a, b HAVING max(d) > 0.12)))"
)


@query(
    "x8_simplified_outline",
    "WITH RECURSIVE " + _SPLIT + " SELECT DISTINCT seg.poly, CAST(seg.a AS INTEGER) AS pos, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM seg JOIN cl ON cl.poly = seg.poly AND cl.pos = seg.a",
)
def _(v):
    e = v.table("embeddings")
    place = Window.partitionBy("label").orderBy("vec_id")
    rows = e.select(F.col("label").alias("poly"), (F.row_number().over(place) - 1).alias("pos"), F.count(F.lit(1)).over(Window.partitionBy("label")).alias("n"), F.col("embedding")[0].cast("double").alias("e"))
    turn, out = 2 * F.pi() * F.col("pos") / F.col("n"), 1 + F.col("e")
    corners = rows.select("poly", F.struct("pos", (out * F.cos(turn)).alias("x"), (out * F.sin(turn)).alias("y")).alias("c"))
    rings = corners.groupBy("poly").agg(F.sort_array(F.collect_list("c")).alias("ring"))
    return outlines.simplified(rings, "ring", 0.12).select("poly", F.explode("ring").alias("c")).select("poly", "c.pos", "c.x", "c.y")


_D = f"de AS (SELECT a.id AS src, b.id AS dst, {KM_AB} AS km FROM pt a JOIN pt b ON a.id <> b.id WHERE {KM_AB} < 3.0), we AS (SELECT src, dst, 1 / (1 + km) AS weight FROM de) "


def _edges(v, distinct=False):
    return graph.inverse_weights(graph.distance_edges(v.point(), "id", "lat", "lon", 3.0, distinct)).select("src", "dst", "weight")


def _g(body: str, rnd: str = "", needs: str = "pt") -> str:
    return with_sql(needs, body, rnd, extra=_D)


@query("gr1_distance_edges", _g("SELECT src, dst, km FROM de", "km"))
def _(v):
    return graph.distance_edges(v.point(), "id", "lat", "lon", 3.0)


@query("gr2_nearest_edges", with_sql("pt", f"SELECT src, dst, km, CAST(pos AS INTEGER) AS pos FROM (SELECT a.id AS src, b.id AS dst, {KM_AB} AS km, row_number() OVER (PARTITION BY a.id ORDER BY {KM_AB}, b.id) AS pos FROM pt a JOIN pt b ON a.id <> b.id) WHERE pos <= 5", "km"))
def _(v):
    return graph.nearest_edges(v.point(), "id", "lat", "lon", 5)


@query("gr3_inverse_weights", _g("SELECT src, dst, weight FROM we", "weight"))
def _(v):
    return _edges(v)


@query("gr4_border_adjacency", with_sql("cor", "SELECT DISTINCT a.poly AS src, b.poly AS dst FROM cor a JOIN cor b ON round(a.x, 7) = round(b.x, 7) AND round(a.y, 7) = round(b.y, 7)"))
def _(v):
    return graph.with_self_loops(spatial.touching(v.polygon(), "poly", "ring"), v.polygon(), "poly")


@query(
    "gr5_same_label_edges",
    "WITH r AS (SELECT c_custkey AS id, c_mktsegment AS label, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(CAST(c_custkey AS VARCHAR) || '-7'), c_custkey) AS pos, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) "
    "SELECT a.id AS src, b.id AS dst, a.label FROM r a JOIN r b ON b.label = a.label AND b.id <> a.id AND (b.pos - a.pos + a.n) % a.n BETWEEN 1 AND 3",
)
def _(v):
    return graph.same_label_edges(v.table("customer"), "c_custkey", "c_mktsegment", 3)


@query("gr5_same_label_degree", "SELECT c_mktsegment AS label, count(*) AS nodes, count(*) * 3 AS links FROM customer GROUP BY 1")
def _(v):
    e = graph.same_label_edges(v.table("customer"), "c_custkey", "c_mktsegment", 3)
    per = e.filter(F.col("src") != F.col("dst")).groupBy("src", "label").agg(F.count_distinct("dst").alias("k"))
    return per.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"), F.sum("k").alias("links"))


_ZS = "zs AS (SELECT s_nationkey AS zone, avg(s_acctbal) / 100 AS score FROM supplier GROUP BY 1) "


@query("gr6_score_edges", "WITH " + _ZS + "SELECT a.zone AS src, b.zone AS dst, round(1 / (1 + abs(a.score - b.score)), 6) AS weight FROM zs a JOIN zs b ON a.zone <> b.zone WHERE 1 / (1 + abs(a.score - b.score)) > 0.3")
def _(v):
    scores = v.table("supplier").groupBy(F.col("s_nationkey").alias("zone")).agg((F.avg("s_acctbal") / 100).alias("score"))
    return graph.score_edges(scores, "zone", "score")


_MV = (
    "mv AS (SELECT label AS zone, i, avg(CAST(e AS DOUBLE)) AS x FROM (SELECT label, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2), "
    "cs AS (SELECT a.zone AS src, b.zone AS dst, sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) AS cosine FROM mv a JOIN mv b ON a.i = b.i AND a.zone <> b.zone GROUP BY 1, 2) "
)


@query("gr6_cosine_edges", "WITH " + _MV + "SELECT src, dst, round(cosine, 6) + 0.0 AS cosine FROM cs WHERE cosine > 0.3 OR ((SELECT count(*) FROM cs WHERE cosine > 0.3) = 0 AND (SELECT count(*) FROM cs c WHERE c.src = cs.src AND (c.cosine > cs.cosine OR (c.cosine = cs.cosine AND c.dst < cs.dst))) < 5)")
def _(v):
    return graph.cosine_edges(graph.mean_vectors(v.table("embeddings"), "label", "embedding"), "label", "vector")


@query(
    "gr7_attach_isolated",
    _g("SELECT src, dst FROM de UNION SELECT id, r FROM pt, (VALUES (0), (1)) t(r) WHERE id NOT IN (SELECT src FROM de) AND id <> r UNION SELECT r, id FROM pt, (VALUES (0), (1)) t(r) WHERE id NOT IN (SELECT src FROM de) AND id <> r"),
)
def _(v):
    linked = graph.linked_points(v.point(), "id", "lat", "lon", 3.0)
    return graph.attach_isolated(_edges(v, distinct=True), v.point(), "id", [0, 1], linked, distinct=True)


@query("gr8_degrees", _g("SELECT src, count(*) AS degree, sum(weight) AS strength FROM we GROUP BY src", "strength"))
def _(v):
    return graph.degrees(_edges(v))


@query(
    "gr8_graph_stats",
    _g("SELECT count(*) AS edges, (SELECT count(*) FROM pt) AS nodes, min(weight) AS min_weight, max(weight) AS max_weight, avg(weight) AS mean_weight, count(*) / ((SELECT count(*) FROM pt) * ((SELECT count(*) FROM pt) - 1)) AS density, count(*) / (SELECT count(*) FROM pt) AS mean_degree FROM we",
       "min_weight max_weight mean_weight density mean_degree"),
)
def _(v):
    return graph.graph_stats(_edges(v), v.point(), "id")


_DEG = "(SELECT src AS k, sum(weight) + 1e-8 AS d FROM we GROUP BY src)"


@query("gr9_normalise", _g(f"SELECT w.src, w.dst, w.weight / (sqrt(s.d) * sqrt(t.d)) AS weight FROM we w JOIN {_DEG} s ON s.k = w.src JOIN {_DEG} t ON t.k = w.dst", "weight"))
def _(v):
    return graph.normalise(_edges(v))


@query(
    "gr10_one_hop",
    _g(f"SELECT w.src AS zone, p.date, sum(w.weight / (sqrt(s.d) * sqrt(t.d)) * p.n) AS n, sum(w.weight / (sqrt(s.d) * sqrt(t.d)) * p.click) AS click FROM we w JOIN {_DEG} s ON s.k = w.src JOIN {_DEG} t ON t.k = w.dst JOIN panel p ON p.zone = w.dst GROUP BY 1, 2", "n click", "pt panel"),
)
def _(v):
    return graph.hop(v.panel().select("zone", "date", "n", "click"), graph.normalise(_edges(v)), "zone", "date", ["n", "click"])


@query(
    "gr10_border_hop",
    with_sql(
        "cor oe",
        "SELECT t.src AS zone, count(*) AS n FROM (SELECT DISTINCT a.poly AS src, b.poly AS dst FROM cor a JOIN cor b ON round(a.x, 7) = round(b.x, 7) AND round(a.y, 7) = round(b.y, 7)) t JOIN oe ON oe.zone = t.dst GROUP BY 1",
    ),
)
def _(v):
    e = graph.with_self_loops(spatial.touching(v.polygon(), "poly", "ring"), v.polygon(), "poly").withColumn("weight", F.lit(1))
    counts = v.outcome_daily().groupBy("zone").agg(F.sum("n").alias("n")).withColumn("date", F.lit(0))
    return graph.hop(counts, e, "zone", "date", ["n"]).drop("date")




_NB = (
    "nb AS (SELECT DISTINCT a.poly AS src, b.poly AS dst FROM cor a JOIN cor b ON round(a.x, 7) = round(b.x, 7) AND round(a.y, 7) = round(b.y, 7)), "
    "dg AS (SELECT src AS k, count(*) + 1e-8 AS d FROM nb GROUP BY 1), nw AS (SELECT nb.src, nb.dst, 1 / (sqrt(s.d) * sqrt(t.d)) AS weight FROM nb JOIN dg s ON s.k = nb.src JOIN dg t ON t.k = nb.dst), "
    "h0 AS (SELECT zone, month, CAST(y AS DOUBLE) AS y FROM om), h1 AS (SELECT nw.src AS zone, h0.month, sum(weight * h0.y) AS y FROM nw JOIN h0 ON h0.zone = nw.dst GROUP BY 1, 2) "
)


@query(
    "gr10_two_hops",
    with_sql("cor om", "SELECT nw.src AS zone, h1.month, sum(weight * h1.y) AS y FROM nw JOIN h1 ON h1.zone = nw.dst GROUP BY 1, 2", "y", extra=_NB),
)
def _(v):
    border = graph.with_self_loops(spatial.touching(v.polygon(), "poly", "ring"), v.polygon(), "poly").withColumn("weight", F.lit(1.0))
    return graph.hops(v.outcome_m(), graph.normalise(border), "zone", "month", ["y"], 2)
