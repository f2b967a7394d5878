"""S*: readers and writers, each writing real tables and reading them back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonetide.operators.joins import merge_by_id
from zonetide.operators.panel import array_export
from zonetide.plans.registry import query
from zonetide.plans.views import with_sql
from zonetide.session import scratch_path
from zonetide.sources import files, geojson, wrapped


@query("s1_read_wrapped_json", "SELECT event_id, user_id, event_type, value FROM events")
def _(v):
    path = scratch_path(v.spark, "wrapped")
    cols = ["event_id", "user_id", "event_type", "value"]
    wrapped.write_wrapped_json(v.table("events").select(*cols), path, "events")
    rows = wrapped.read_wrapped_json(v.spark, path, cols, table="events", multi_line=False)
    return rows.select(
        F.col("event_id").cast("bigint"), F.col("user_id").cast("bigint"), "event_type", F.col("value").cast("double")
    )


@query("s2_read_json_folder", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def _(v):
    cols = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    orders, row = v.table("orders").select(*cols), F.struct(*cols)
    layouts = {
        "list": ("F", F.to_json(F.array(row))),
        "data": ("O", F.to_json(F.struct(F.array(row).alias("data")))),
        "features": ("P", F.to_json(F.struct(F.array(F.struct(row.alias("properties"))).alias("features")))),
    }
    paths = {}
    for name, (status, text) in layouts.items():
        paths[name] = scratch_path(v.spark, name)
        orders.filter(F.col("o_orderstatus") == status).select(text.alias("value")).write.text(paths[name])
    schema = T.StructType([f for f in orders.schema.fields])
    return wrapped.read_json_folder(v.spark, paths, schema, multi_line=False)


@query("s3_read_csv_text", "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def _(v):
    path = scratch_path(v.spark, "csv")
    cols = ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"]
    v.table("customer").select(*cols).write.option("header", True).csv(path)
    rows = files.read_csv_text(v.spark, path, cols)
    return rows.select(F.col("c_custkey").cast("bigint"), "c_name", "c_mktsegment", F.col("c_acctbal").cast("double"))


@query("s4_read_newest_parquet", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(v):
    names = [f"{v.sf_dir}/supplier_{n}.parquet" for n in ("v3", "v2", "v1")] + [f"{v.sf_dir}/supplier.parquet"]
    return files.read_newest_parquet(v.spark, names).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query("s5_read_geojson", with_sql("cor", "SELECT CAST(poly AS BIGINT) AS poly, CAST(pos AS INTEGER) AS pos, x, y FROM cor", "x y"))
def _(v):
    path = scratch_path(v.spark, "geojson")
    geojson.write_features(v.polygon(), path, ["poly"], "ring")
    rows = geojson.read_features(v.spark, path, ["poly"], multi_line=False)
    return rows.select(F.col("poly").cast("bigint").alias("poly"), F.posexplode("ring").alias("pos", "p")).select("poly", "pos", "p.x", "p.y")


@query(
    "s5_read_all_geometries",
    with_sql(
        "cor",
        "SELECT CAST(k.poly AS BIGINT) AS poly, kind, CAST(part AS INTEGER) AS part, CAST(ring AS INTEGER) AS ring, n FROM (SELECT poly, CASE poly % 4 WHEN 0 THEN 'Polygon' WHEN 1 THEN 'MultiPoint' WHEN 2 THEN 'GeometryCollection' END AS kind FROM (SELECT DISTINCT poly FROM cor)) k "
        "LEFT JOIN (VALUES (0, 0, 0, 4), (0, 0, 1, 3), (1, 0, 0, 1), (1, 1, 0, 1), (1, 2, 0, 1), (1, 3, 0, 1), (2, 0, 0, 4), (2, 1, 0, 1)) v(m, part, ring, n) ON v.m = k.poly % 4",
    ),
)
def _(v):
    """Polygons with a hole, points, collections of a polygon and a point, and features without geometry, written and read back."""
    path = scratch_path(v.spark, "geometries")
    ring, m = F.col("ring"), F.col("poly") % 4
    part = lambda member, kind, *rings: F.struct(F.lit(member).alias("member"), F.lit(kind).alias("kind"), F.array(*rings).alias("rings"))
    parts = F.when(m == 0, F.array(part(0, "Polygon", ring, F.slice(ring, 1, 3)))).when(
        m == 1, F.transform(ring, lambda p: F.struct(F.lit(0).alias("member"), F.lit("MultiPoint").alias("kind"), F.array(F.array(p)).alias("rings")))
    ).when(m == 2, F.array(part(0, "Polygon", ring), part(1, "Point", F.slice(ring, 1, 1))))
    kind = F.when(m == 0, "Polygon").when(m == 1, "MultiPoint").when(m == 2, "GeometryCollection")
    geojson.write_geometries(v.polygon().select("poly", kind.alias("type"), parts.alias("parts")), path, ["poly"])
    rows = geojson.read_geometries(v.spark, path, ["poly"], multi_line=False)
    flat = rows.select(F.col("poly").cast("bigint").alias("poly"), F.col("type").alias("kind"), F.posexplode_outer("parts").alias("part", "p"))
    return flat.select("poly", "kind", "part", F.posexplode_outer("p.rings").alias("ring", "r")).select("poly", "kind", "part", "ring", F.when(F.col("r").isNotNull(), F.size("r")).alias("n"))


@query("s6_read_snapshots", with_sql("snap", "SELECT zone, date, label FROM snap"))
def _(v):
    path = scratch_path(v.spark, "snapshots")
    square = F.array(*[F.struct((F.col("zone") + dx).cast("double").alias("x"), F.lit(dy).alias("y")) for dx, dy in ((0, 0.0), (1, 0.0), (1, 1.0))])
    rows = v.snapshot().withColumn("folder", F.concat(F.lit("faccoes_"), F.date_format("date", "dd_MM_yyyy"))).withColumn("ring", square)
    geojson.write_features(rows.withColumn("stem", F.col("label")), path, ["zone"], "ring", ["folder", "stem"])
    back = geojson.read_snapshots(v.spark, path, ["zone"], r"stem=([^/]+)/", multi_line=False)
    return back.select(F.col("zone").cast("bigint"), "date", "label")


@query("s7_tally_json_key", "SELECT json_extract_string(props, '$.k') AS value, count(*) AS n FROM events GROUP BY 1")
def _(v):
    return wrapped.tally_key(v.table("events"), "props", "k")


@query("s7_tally_key_spellings", "SELECT lower(event_type) AS value, count(*) AS n FROM events GROUP BY 1")
def _(v):
    """Two spellings with a dot, blanks and capitals, beside a key that only looks alike."""
    name = F.when(F.col("event_id") % 2 == 0, "tipo.x").otherwise("Tipo.X")
    text = F.concat(F.lit('[{"tipo_x": "no", "n": {"'), name, F.lit('": " '), F.upper("event_type"), F.lit(' "}}]'))
    return wrapped.tally_key(v.table("events").select(text.alias("doc")), "doc", ["tipo.x", "Tipo.X"])


@query(
    "s8_read_nested_rows",
    "SELECT l_orderkey, l_linenumber, 'quantity' AS name, l_quantity AS value FROM lineitem "
    "UNION ALL SELECT l_orderkey, l_linenumber, 'price', l_extendedprice FROM lineitem",
)
def _(v):
    path = scratch_path(v.spark, "nested")
    cell = lambda name, col: F.struct("l_orderkey", "l_linenumber", F.lit(name).alias("name"), F.col(col).alias("value"))
    v.table("lineitem").select(F.array(cell("quantity", "l_quantity"), cell("price", "l_extendedprice")).alias("data")).write.parquet(path)
    return files.explode_rows(v.spark.read.parquet(path), "data")


@query(
    "s9_write_formats",
    with_sql("", "SELECT f.format, count(*) AS n, round(sum(value), 2) AS total FROM events, (VALUES ('csv'), ('json'), ('parquet')) f(format) GROUP BY 1"),
)
def _(v):
    events = v.table("events").select("event_id", "value")
    out = None
    for fmt in ("csv", "json", "parquet"):
        path = scratch_path(v.spark, fmt)
        writer = events.write.format(fmt)
        if fmt == "parquet":
            writer = writer.option("compression", "gzip")
        writer.save(path)
        back = v.spark.read.schema(events.schema).format(fmt).load(path).withColumn("format", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out.groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("s10_csv_to_wrapped_json", "SELECT p_partkey, p_name, p_brand, p_size FROM part")
def _(v):
    csv, out = scratch_path(v.spark, "csv"), scratch_path(v.spark, "wrapped")
    cols = ["p_partkey", "p_name", "p_brand", "p_size"]
    v.table("part").select(*cols).write.option("header", True).csv(csv)
    wrapped.write_wrapped_json(files.read_csv_text(v.spark, csv, cols), out, "part", rows_per_document=500)
    rows = wrapped.read_wrapped_json(v.spark, out, cols, table="part", multi_line=False)
    return rows.select(F.col("p_partkey").cast("bigint"), "p_name", "p_brand", F.col("p_size").cast("int"))


@query(
    "s11_update_by_id",
    "SELECT d.doc_id, coalesce('q' || CAST(l.quality AS VARCHAR), d.source) AS source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def _(v):
    path = scratch_path(v.spark, "merged")
    fresh = v.table("labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("source"))
    merge_by_id(v.table("documents").select("doc_id", "source"), fresh, "doc_id", "source").write.parquet(path)
    return v.spark.read.parquet(path)


@query(
    "s11_update_wrapped_records",
    "SELECT d.doc_id, d.lang, coalesce('q' || CAST(l.quality AS VARCHAR), d.source) AS source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def _(v):
    """The same update inside wrapped documents, whose wrapper and order stay."""
    path, out = scratch_path(v.spark, "wrapped"), scratch_path(v.spark, "updated")
    wrapped.write_wrapped_json(v.table("documents").select("doc_id", "lang", "source"), path, "documents", rows_per_document=300)
    fresh = v.table("labels").select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("source"))
    wrapped.update_wrapped_json(v.spark, path, out, "doc_id", "source", fresh, multi_line=False)
    rows = wrapped.read_wrapped_json(v.spark, out, ["doc_id", "lang", "source"], table="documents", multi_line=False)
    return rows.select(F.col("doc_id").cast("bigint"), "lang", "source")


@query(
    "s12_write_partitioned",
    with_sql("zd", "SELECT c_mktsegment AS label, region, count(*) AS n FROM customer JOIN zd ON c_nationkey = zone GROUP BY 1, 2"),
)
def _(v):
    path = scratch_path(v.spark, "parts")
    dim = v.zone_dim().select(F.col("zone").alias("c_nationkey"), "region")
    rows = v.table("customer").join(dim, "c_nationkey").select("c_custkey", F.col("c_mktsegment").alias("label"), "region")
    files.write_partitioned(rows, path, ["label", "region"], files_per_partition=2)
    return v.spark.read.parquet(path).groupBy("label", "region").agg(F.count(F.lit(1)).alias("n"))


@query(
    "s13_metadata_row",
    with_sql(
        "dz",
        "SELECT count(*) AS rows, min(date) AS first_date, max(date) AS last_date, quantile_cont(click, 0.5) AS click_p50, quantile_cont(click, 0.99) AS click_p99, "
        "quantile_cont(view, 0.5) AS view_p50, quantile_cont(view, 0.99) AS view_p99 FROM dz",
        "click_p50 click_p99 view_p50 view_p99",
    ),
)
def _(v):
    return files.metadata_row(v.daily_zone(), "date", ["click", "view"], {"p50": 0.5, "p99": 0.99})


@query(
    "s14_panel_export",
    with_sql("panel", "SELECT date, zone // 50 AS chunk, count(*) AS cells, CAST(sum(n) AS BIGINT) AS total, min(zone) AS first_zone, max(zone) AS last_zone FROM panel GROUP BY 1, 2"),
)
def _(v):
    path = scratch_path(v.spark, "tensor")
    cells = array_export(v.panel(), ["date"], "zone", ["n", "click"], chunk=F.floor(F.col("zone") / 50))
    cells.write.parquet(path)
    total = F.aggregate("cells", F.lit(0).cast("bigint"), lambda s, c: s + c["n"])
    return v.spark.read.parquet(path).select(
        "date", "chunk", F.size("cells").cast("bigint").alias("cells"), total.alias("total"),
        F.element_at("cells", 1)["zone"].alias("first_zone"), F.element_at("cells", -1)["zone"].alias("last_zone"),
    )


