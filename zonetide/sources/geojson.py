"""GeoJSON features and dated snapshot folders."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(properties: Sequence[str]) -> T.StructType:
    props = T.StructType([T.StructField(p, T.StringType()) for p in properties])
    # coordinates are kept as text: their depth depends on the geometry type
    plain = [T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]
    geometry = T.StructType([*plain, T.StructField("geometries", T.ArrayType(T.StructType(plain)))])
    feature = T.StructType([T.StructField("properties", props), T.StructField("geometry", geometry)])
    return T.StructType([T.StructField("features", T.ArrayType(feature))])


# Geometry types, whether they are several, and how deep a single one nests points.
KINDS = {"Point": (False, 0), "MultiPoint": (True, 0), "LineString": (False, 1), "MultiLineString": (True, 1), "Polygon": (False, 2), "MultiPolygon": (True, 2)}
_POINT = "struct<x:double,y:double>"
PARTS = f"array<struct<member:int,kind:string,rings:array<array<{_POINT}>>>>"


def _rings_of(depth: int) -> Callable[[Column], Column]:
    """Rings out of the coordinates of a single geometry."""
    point = lambda c: F.struct(F.get(c, F.lit(0)).alias("x"), F.get(c, F.lit(1)).alias("y"))
    run = lambda r: F.transform(r, point)
    return [lambda c: F.array(F.array(point(c))), lambda c: F.array(run(c)), lambda c: F.transform(c, run)][depth]


def _coordinates_of(depth: int) -> Callable[[Column], Column]:
    """Coordinates of a single geometry out of its part."""
    pair = lambda p: F.array(p["x"], p["y"])
    run = lambda r: F.transform(r, pair)
    first = lambda p: F.get(p["rings"], F.lit(0))
    return [lambda p: pair(F.get(first(p), F.lit(0))), lambda p: run(first(p)), lambda p: F.transform(p["rings"], run)][depth]


def _parts(member: Column, i: Column) -> Column:
    """Parts of one geometry: points and lines are polygons of one ring, of one corner or open."""
    out = None
    for kind, (several, depth) in KINDS.items():
        levels = depth + several
        parsed = F.from_json(member["coordinates"], "array<" * (levels + 1) + "double" + ">" * (levels + 1))
        rings = _rings_of(depth)
        each = F.transform(parsed, rings) if several else F.when(parsed.isNotNull(), F.array(rings(parsed)))
        out = F.when(member["type"] == kind, each) if out is None else out.when(member["type"] == kind, each)
    return F.transform(out, lambda r: F.struct(i.cast("int").alias("member"), member["type"].alias("kind"), r.alias("rings")))


def read_geometries(spark: SparkSession, path: str, properties: Sequence[str], with_path: bool = False, multi_line: bool = True) -> DataFrame:
    """One row per feature of any geometry: properties, ``type`` and ``parts``.

    A part is one point, line or polygon: ``kind`` names the geometry it comes from,
    ``member`` its place in a collection (0 elsewhere), and ``rings`` holds its corners: one
    of a point, one run of a line, outer ring and holes of a polygon.  A feature without
    geometry has neither type nor parts; collections in collections and heights are
    left out.
    """
    docs = spark.read.schema(_schema(properties)).option("multiLine", multi_line).json(path)
    extra = [F.col("_metadata.file_path").alias("file_path")] if with_path else []
    rows = docs.select(*extra, F.explode("features").alias("f"))
    g = F.col("f.geometry")
    alone = F.array(F.struct(g["type"].alias("type"), g["coordinates"].alias("coordinates")))
    members = F.when(g["type"] == "GeometryCollection", g["geometries"]).when(g["type"].isNotNull(), alone)
    parts = F.flatten(F.transform(members, lambda m, i: F.coalesce(_parts(m, i), F.array().cast(PARTS))))
    return rows.select(*([F.col("file_path")] if with_path else []), "f.properties.*", g["type"].alias("type"), parts.alias("parts"))


def read_features(spark: SparkSession, path: str, properties: Sequence[str], with_path: bool = False, multi_line: bool = True) -> DataFrame:
    """One row per polygon part, also of collections: properties, ``part`` number, outer
    ``ring`` and ``holes`` (inner rings, possibly none); ``read_geometries`` gives the other features."""
    rows = read_geometries(spark, path, properties, with_path, multi_line)
    keep = [c for c in rows.columns if c not in ("type", "parts")]
    polygons = F.filter("parts", lambda p: p["kind"].isin("Polygon", "MultiPolygon") & (F.size(p["rings"]) > 0))
    parts = rows.select(*keep, F.posexplode(polygons).alias("part", "p"))
    return parts.select(*keep, "part", F.get("p.rings", F.lit(0)).alias("ring"), F.slice("p.rings", F.lit(2), F.size("p.rings")).alias("holes"))


def _coordinates(kind: Column, parts: Column) -> Column:
    """Coordinates of one geometry as text, out of its parts."""
    out = None
    for name, (several, depth) in KINDS.items():
        single = _coordinates_of(depth)
        text = F.to_json(F.transform(parts, single) if several else single(F.get(parts, F.lit(0))))
        out = F.when(kind == name, text) if out is None else out.when(kind == name, text)
    return F.coalesce(out, F.lit("[]"))


def _geometry_text(kind: Column, parts: Column) -> Column:
    quoted = lambda k: F.concat(F.lit('{"type":"'), k, F.lit('",'))
    plain = lambda k, ps: F.concat(quoted(k), F.lit('"coordinates":'), _coordinates(k, ps), F.lit("}"))
    members = F.array_distinct(F.transform(parts, lambda p: F.struct(p["member"], p["kind"])))
    inside = F.transform(members, lambda m: plain(m["kind"], F.filter(parts, lambda p: p["member"] == m["member"])))
    collection = F.concat(quoted(kind), F.lit('"geometries":['), F.array_join(inside, ","), F.lit("]}"))
    return F.when(kind.isNull(), F.lit("null")).when(kind == "GeometryCollection", collection).otherwise(plain(kind, parts))


def write_geometries(df: DataFrame, path: str, properties: Sequence[str], kind: str = "type", parts: str = "parts", per_file: Sequence[str] = ()) -> None:
    """Features as ``read_geometries`` gives them, as feature collections, one document per line.

    Nothing is lost: holes, parts, members of collections and missing geometries come
    back as they were.  ``per_file`` columns become folders.
    """
    fields = F.to_json(F.struct(*[F.col(p).cast("string").alias(p) for p in properties]), {"ignoreNullFields": "false"})
    feature = F.concat(F.lit('{"type":"Feature","properties":'), fields, F.lit(',"geometry":'), _geometry_text(F.col(kind), F.col(parts)), F.lit("}"))
    lines = df.select(*per_file, F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit("]}")).alias("value"))
    writer = lines.write
    if per_file:
        writer = writer.partitionBy(*per_file)
    writer.text(path)


def write_features(df: DataFrame, path: str, properties: Sequence[str], ring: str, per_file: Sequence[str] = (), holes: str | None = None) -> None:
    """Polygons, with their holes, as feature collections, one document per line."""
    rings = F.array(F.col(ring))
    if holes is not None:
        rings = F.concat(rings, F.coalesce(F.col(holes), F.slice(rings, 1, 0)))
    part = F.struct(F.lit(0).alias("member"), F.lit("Polygon").alias("kind"), rings.alias("rings"))
    write_geometries(df.withColumns({"_type": F.lit("Polygon"), "_parts": F.array(part)}), path, properties, "_type", "_parts", per_file)


# Snapshot folder and label file names.
SNAPSHOT_DATE = r"faccoes_(\d{2}_\d{2}_\d{4})"
SNAPSHOT_LABEL = r"([^/=]+?)(?:\.geojson|\.json)?(?:/[^/]*)?$"


def snapshot_columns(df: DataFrame, label_pattern: str = SNAPSHOT_LABEL) -> DataFrame:
    """Date from the folder and label from the file, out of ``file_path``."""
    day = F.try_to_date(F.regexp_extract("file_path", SNAPSHOT_DATE, 1), "dd_MM_yyyy")
    return df.withColumn("date", day).withColumn("label", F.regexp_extract("file_path", label_pattern, 1)).drop("file_path")


def read_snapshots(spark: SparkSession, root: str, properties: Sequence[str], label_pattern: str = SNAPSHOT_LABEL, multi_line: bool = True) -> DataFrame:
    files = read_features(spark, root, properties, with_path=True, multi_line=multi_line)
    return snapshot_columns(files, label_pattern)
