"""File layouts on hand-written documents."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonetide.operators import spatial
from zonetide.session import scratch_path
from zonetide.sources import files, geojson, wrapped

ROWS = [{"id": "1", "data": "2024-01-01", "x": "a"}, {"id": "2", "data": None, "x": "b"}]


@pytest.mark.parametrize(
    "doc",
    [
        [{"type": "header", "version": "5"}, {"type": "table", "name": "t", "data": ROWS}],
        {"records": ROWS},
        {"operacoes": ROWS},
        [{"id": r["id"], "x": r["x"]} for r in ROWS],
    ],
)
def test_wrapped_layouts(spark, tmp_path, doc):
    (tmp_path / "doc.json").write_text(json.dumps(doc, indent=1))
    got = wrapped.read_wrapped_json(spark, str(tmp_path), ["id", "x"])
    assert sorted(map(tuple, got.collect())) == [("1", "a"), ("2", "b")]


@pytest.mark.parametrize("wrap", [lambda rows: [{"type": "header"}, {"type": "table", "name": "t", "data": rows}], lambda rows: {"data": rows}, lambda rows: rows])
def test_row_fields_named_like_the_wrapper(spark, tmp_path, wrap):
    rows = [{"Data": "2024-01-01", "Natureza": "A", "type": "x"}, {"Data": "2024-01-02", "Natureza": None, "type": "y"}]
    (tmp_path / "doc.json").write_text(json.dumps(wrap(rows)))
    got = wrapped.read_wrapped_json(spark, str(tmp_path), ["Data", "Natureza", "type"])
    assert sorted(map(str, got.collect())) == sorted(str(T.Row(**r)) for r in rows)


def test_wrapped_named_table(spark, tmp_path):
    doc = [{"type": "table", "name": "t", "data": ROWS}, {"type": "table", "name": "u", "data": [{"id": "9", "x": "z"}]}]
    (tmp_path / "doc.json").write_text(json.dumps(doc))
    assert [tuple(r) for r in wrapped.read_wrapped_json(spark, str(tmp_path), ["id", "x"], table="u").collect()] == [("9", "z")]


def test_csv_bad_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,a\n2,b,extra\n3,c\n")
    good = files.read_csv_text(spark, str(tmp_path), ["id", "v"])
    assert sorted(r.id for r in good.select("id", "v").collect() if r.v in ("a", "c")) == ["1", "3"]
    audit = files.read_csv_text(spark, str(tmp_path), ["id", "v"], audit=True).cache()
    assert [r["_corrupt_record"] for r in audit.filter(F.col("_corrupt_record").isNotNull()).collect()] == ["2,b,extra"]


def test_newest_parquet(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "v2"))
    assert files.read_newest_parquet(spark, [str(tmp_path / "v3"), str(tmp_path / "v2")]).count() == 3
    with pytest.raises(FileNotFoundError):
        files.read_newest_parquet(spark, [str(tmp_path / "v9")])


def test_geojson_multipolygon(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    doc = {"features": [
        {"properties": {"name": "p"}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"properties": {"name": "m"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}},
    ]}
    (tmp_path / "z.geojson").write_text(json.dumps(doc))
    got = geojson.read_features(spark, str(tmp_path), ["name"]).select("name", "part", F.size("ring").alias("k")).collect()
    assert sorted(map(tuple, got)) == [("m", 0, 4), ("m", 1, 4), ("p", 0, 4)]


def test_holes_are_outside(spark, tmp_path):
    outer, hole = [[0, 0], [9, 0], [9, 9], [0, 9], [0, 0]], [[3, 3], [6, 3], [6, 6], [3, 6], [3, 3]]
    doc = {"features": [
        {"properties": {"name": "ring"}, "geometry": {"type": "Polygon", "coordinates": [outer, hole]}},
        {"properties": {"name": "full"}, "geometry": {"type": "Polygon", "coordinates": [[[x + 20, y] for x, y in outer]]}},
    ]}
    (tmp_path / "z.geojson").write_text(json.dumps(doc))
    polys = geojson.read_features(spark, str(tmp_path), ["name"])
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 4.5, 4.5), (3, 8.0, 4.5), (4, 24.5, 4.5), (5, 12.0, 1.0)], "id int, x double, y double")
    for size in (None, 1.0, 40.0):
        got = spatial.points_in_polygons(pts, polys, "name", "ring", "x", "y", size, holes="holes")
        assert {(r.id, r.name) for r in got.collect()} == {(1, "ring"), (3, "ring"), (4, "full")}


def test_snapshot_folders(spark, tmp_path):
    folder = tmp_path / "faccoes_05_02_2024"
    folder.mkdir()
    doc = {"features": [{"properties": {"name": "p"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1]]]}}]}
    (folder / "alpha.geojson").write_text(json.dumps(doc))
    row = geojson.read_snapshots(spark, str(tmp_path) + "/*/*.geojson", ["name"], r"/([^/]+)\.geojson$").first()
    assert (str(row.date), row.label, row.name) == ("2024-02-05", "alpha", "p")


def test_tally_nested_keys(spark):
    docs = spark.createDataFrame([('{"a": {"tipo": "X"}, "b": [{"tipo": "Y"}, {"tipo": "X", "n": 1}]}',), ('{"tipo": 3}',)], "t string")
    assert {r.value: r.n for r in wrapped.tally_key(docs, "t", "tipo").collect()} == {"x": 2, "y": 1, "3": 1}


def test_alias_order(spark):
    df = spark.createDataFrame([(None, 2.0, 3.0)], "Latitude double, lat_geo double, LNG double")
    assert tuple(files.rename_aliases(df).first()) == (2.0, 3.0)
    assert files.detect_columns(["id", "geo_lat", "lng", "dt_data"]) == {"lat": "geo_lat", "lon": "lng", "date": "dt_data", "name": "id", "zone": None, "city": None}
    found = files.detect_columns(["BairroOcor", "CidadeOcor", "Data"])
    assert (found["zone"], found["city"], found["date"]) == ("BairroOcor", "CidadeOcor", "Data")


def test_partitioned_write_keeps_rows(spark):
    path = scratch_path(spark, "test-parts")
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    files.write_partitioned(df, path, ["k"], 4)
    assert spark.read.schema(T.StructType(df.schema.fields)).parquet(path).count() == 100


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    from zonetide.streaming.flows import run_to_table

    folder, sink = str(tmp_path / "in"), str(tmp_path / "sink")
    spark.range(3).write.parquet(folder)
    stream = lambda: spark.readStream.schema("id long").parquet(folder)
    assert run_to_table(stream(), "ids", sink=sink).count() == 3
    spark.range(3, 8).write.mode("append").parquet(folder)
    assert sorted(r.id for r in run_to_table(stream(), "ids", sink=sink).collect()) == list(range(8))


def test_features_of_all_types_come_back(spark, tmp_path):
    square, hole = [[0, 0], [9, 0], [9, 9], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]
    shapes = [
        {"type": "Point", "coordinates": [1.5, -2]}, {"type": "MultiPoint", "coordinates": [[0, 0], [1, 1]]}, {"type": "LineString", "coordinates": [[0, 0], [1, 1], [2, 0]]},
        {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[5, 5], [6, 6]]]}, {"type": "Polygon", "coordinates": [square, hole]}, {"type": "MultiPolygon", "coordinates": [[square], [square, hole]]},
        {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [3, 4]}, {"type": "MultiPolygon", "coordinates": [[square, hole], [square]]}, {"type": "Polygon", "coordinates": [square]}]},
        {"type": "GeometryCollection", "geometries": []}, {"type": "Polygon", "coordinates": []}, None,
    ]
    doc = {"features": [{"type": "Feature", "properties": {"name": f"f{i}", "note": None if i % 2 else 'a "b"'}, "geometry": g} for i, g in enumerate(shapes)]}
    (tmp_path / "z.geojson").write_text(json.dumps(doc))
    rows = geojson.read_geometries(spark, str(tmp_path / "z.geojson"), ["name", "note"])
    assert rows.count() == len(shapes)
    out = str(tmp_path / "out")
    geojson.write_geometries(rows, out, ["name", "note"])
    back = [json.loads(r.value)["features"][0] for r in spark.read.text(out).collect()]
    plain = lambda g: json.loads(json.dumps(g), parse_int=float)
    assert {f["properties"]["name"]: (f["properties"]["note"], plain(f["geometry"])) for f in back} == {
        f["properties"]["name"]: (f["properties"]["note"], plain(f["geometry"])) for f in doc["features"]}
    polygons = geojson.read_features(spark, str(tmp_path / "z.geojson"), ["name"]).collect()
    assert sorted((r.name, r.part, len(r.holes)) for r in polygons) == [("f4", 0, 1), ("f5", 0, 0), ("f5", 1, 1), ("f6", 0, 1), ("f6", 1, 0), ("f6", 2, 0)]
    geojson.write_features(geojson.read_features(spark, str(tmp_path / "z.geojson"), ["name"]), str(tmp_path / "p"), ["name"], "ring", holes="holes")
    assert sorted(len(r.holes) for r in geojson.read_features(spark, str(tmp_path / "p"), ["name"], multi_line=False).collect()) == [0, 0, 0, 1, 1, 1]


def test_update_inside_wrapped_documents(spark, tmp_path):
    rows = [{"id": i, "b": "old", "deep": {"b": [1, None, 2.5]}, "é": "ü"} for i in range(7)] + [{"b": "no id"}, {"id": "7", "x": None}, "text", None]
    docs = {
        "list": rows, "tables": [{"type": "header", "v": 1}, {"type": "table", "name": "t", "data": rows}, {"type": "table", "name": "u", "data": rows[:2]}, {"type": "end"}],
        "object": {"meta": {"data": 3}, "records": rows, "z": [1]}, "none": {"data": []}, "other": {"k": 1}, "bare": [],
    }
    folder = tmp_path / "in"
    folder.mkdir()
    for name, doc in docs.items():
        (folder / f"{name}.json").write_text(json.dumps(doc, ensure_ascii=False, indent=1))
    updates = spark.createDataFrame([("2", "new"), ("2", "alt"), ("7", "seven"), ("5", ""), ("6", None), (None, "lost"), ("99", "none")], "id string, b string")
    wrapped.update_wrapped_json(spark, str(folder), str(tmp_path / "out"), "id", "b", updates)

    def change(row):
        new = {"2": "new", "7": "seven"}.get(str(row.get("id"))) if isinstance(row, dict) else None
        return row | {"b": new} if new else row

    want = [[change(r) for r in rows], {"meta": {"data": 3}, "records": [change(r) for r in rows], "z": [1]}, {"data": []}, {"k": 1}, []]
    want.append([docs["tables"][0], docs["tables"][1] | {"data": [change(r) for r in rows]}, docs["tables"][2] | {"data": [change(r) for r in rows[:2]]}, docs["tables"][3]])
    got = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(json.dumps(d, ensure_ascii=False) for d in want)
