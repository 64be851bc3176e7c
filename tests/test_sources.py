"""Reading, writing, listing and streaming with real files."""

import json

import pyarrow as pa
import pytest
from pyarrow import parquet as pq
from pyspark.sql import functions as F

from geoquarry.functions import geometry as geo
from geoquarry.functions.wkb import to_wkb
from geoquarry.operators.prepare import prepare, with_unique_id
from geoquarry.operators.profile import file_statistics
from geoquarry.plans.view import ViewSpec, build_view
from geoquarry.sources import inventory, readers, sinks
from geoquarry.streaming import ingest


def layer(spark, n=200):
    df = spark.range(n).select(
        F.concat(F.lit("0."), "id").alias("_unique_id"), (F.col("id") % 20).cast("double").alias("minx"), (F.col("id") / 20).alias("miny")
    )
    df = df.withColumns({"maxx": F.col("minx"), "maxy": F.col("miny")})
    return df.withColumn("geometry", to_wkb(geo.point(F.col("minx"), F.col("miny"))))


def test_corrupt_and_empty_files_are_passed_over(spark, tmp_path):
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "d"))
    (tmp_path / "d" / "broken.parquet").write_bytes(b"not parquet at all")
    (tmp_path / "d" / "empty.parquet").write_bytes(b"")
    df = readers.read_parquet(spark, str(tmp_path / "d"))
    assert df.count() == 5 and df.filter("__file_path LIKE '/%part-0%.parquet'").count() == 5


def test_row_slices_cover_each_file_once(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(str(tmp_path / "d"))
    df = readers.read_parquet(spark, str(tmp_path / "d"))
    slices = [[r["id"] for r in readers.row_slice(df, 4, i).collect()] for i in range(3)]
    assert slices == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]


def test_unique_ids_over_files(spark, tmp_path):
    spark.range(30).repartition(3).write.parquet(str(tmp_path / "d"))
    df = with_unique_id(readers.read_parquet(spark, str(tmp_path / "d")))
    ids = {r["_unique_id"] for r in df.collect()}
    assert len(ids) == 30 and {i.split(".")[0] for i in ids} == {"0", "1", "2"}


def test_geojson_collection(spark, tmp_path):
    shapes = [
        {"type": "Point", "coordinates": [10.5, 59.5]},
        {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]]]},
        {"type": "MultiPoint", "coordinates": [[0, 0], [3, 1]]},
        {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[5, 5], [6, 7]]]},
        {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]},
        {"type": "LineString", "coordinates": [[1, 2, 99], [4, 3, 99]]},
        None,
    ]
    features = [{"type": "Feature", "properties": {"name": f"f{i}"}, "geometry": g} for i, g in enumerate(shapes)]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    df = readers.read_geojson(spark, str(tmp_path / "a.geojson"), "name string")
    found = {r["name"]: (r["area"], r["minx"], r["maxy"]) for r in df.collect()}
    assert found == {
        "f0": (0.0, 10.5, 59.5), "f1": (2.0, 0.0, 2.0), "f2": (0.0, 0.0, 1.0), "f3": (0.0, 0.0, 7.0),
        "f4": (0.5, 0.0, 1.0), "f5": (0.0, 1.0, 3.0), "f6": (None, None, None),
    }


def test_footers(spark, tmp_path):
    geo_meta = {"primary_column": "geom", "columns": {"geom": {"crs": {"id": {"authority": "EPSG", "code": 25833}}, "bbox": [1, 2, 3, 4]}}}
    table = pa.table({"geom": pa.array([b"x", b"y"])}).replace_schema_metadata({"geo": json.dumps(geo_meta)})
    pq.write_table(table, tmp_path / "a.parquet")
    pq.write_table(pa.table({"v": [1]}), tmp_path / "b.parquet")
    (tmp_path / "c.parquet").write_bytes(b"no")
    files = inventory.list_files(spark, str(tmp_path))
    rows = {r["__file_path"].rsplit("/")[-1]: r for r in readers.read_footers(spark, files).collect()}
    assert tuple(rows["a.parquet"])[1:3] == (2, "geom") and tuple(rows["a.parquet"])[4:8] == (1, 2, 3, 4)
    assert rows["a.parquet"]["crs"] == "EPSG:25833" and rows["a.parquet"]["error"] is None
    assert rows["b.parquet"]["n_rows"] == 1 and rows["b.parquet"]["minx"] is None
    assert rows["c.parquet"]["n_rows"] is None and rows["c.parquet"]["error"]


def test_footer_boxes(spark):
    rows = [
        ("a", "EPSG:25833", 262000.0, 6649000.0, 263000.0, 6650000.0),
        ("e", "EPSG:2056", 1.0, 2.0, 3.0, 4.0),
        ("f", "unknown", 1.0, 2.0, 3.0, 4.0),
        ("g", "OGC:CRS84", 1.0, 2.0, 3.0, 4.0),
        ("b", None, 1.0, 2.0, 3.0, 4.0),
        ("c", "EPSG:3857", 0.0, 0.0, 111319.49079327358, 0.0),
        ("d", "EPSG:3857", None, None, None, None),
    ]
    schema = "__file_path string, crs string, minx double, miny double, maxx double, maxy double"
    found = {r[0]: r for r in readers.footer_boxes(spark.createDataFrame(rows, schema)).collect()}
    assert 10 < found["a"]["minx"] < found["a"]["maxx"] < 11
    assert tuple(found["b"])[2:] == (1, 2, 3, 4)
    assert found["c"]["maxx"] == pytest.approx(1.0) and found["d"]["minx"] is None
    assert found["e"]["minx"] is None and found["f"]["maxy"] is None and found["g"]["maxx"] == 3


def test_pruned_read(spark, tmp_path):
    target = str(tmp_path / "layer")
    sinks.write_layer(layer(spark), target, cell=4.0, files=6)
    stats = file_statistics(readers.read_parquet(spark, target))
    kept = readers.surviving_files(stats, (0, 0, 1, 1)).count()
    assert 0 < kept < stats.count()
    view = (0, 0, 3, 2)
    whole = layer(spark).filter("minx <= 3 AND miny <= 2").count()
    assert readers.read_in_bounds(spark, target, stats, view).count() == whole
    assert readers.read_in_bounds(spark, target, stats, (500, 500, 501, 501)).count() == 0


def test_bounding_boxes_in_degrees(spark):
    stats = spark.createDataFrame([("a", 262000.0, 6649000.0, 263000.0, 6650000.0)], "__file_path string, minx double, miny double, maxx double, maxy double")
    row = readers.stats_to_4326(stats, 25833).first()
    assert 10 < row["minx"] < row["maxx"] < 11 and 59 < row["miny"] < row["maxy"] < 60


def test_tables_by_suffix(spark, tmp_path):
    df = spark.range(3).withColumn("name", F.lit("x"))
    df.write.json(str(tmp_path / "t.json"))
    df.write.orc(str(tmp_path / "t.orc"))
    for suffix in ("json", "orc"):
        found = readers.read_table(spark, str(tmp_path / f"t.{suffix}"))
        assert found.count() == 3 and found.filter("area IS NULL AND minx IS NULL").count() == 3
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "t.xlsx"))


def test_listing(spark, tmp_path):
    (tmp_path / "a.parquet").mkdir()
    for name in ("a.parquet/p1.parquet", "a.parquet/p2.parquet", "note.md", "t.csv"):
        (tmp_path / name).write_text("x" * 10)
    root = str(tmp_path)
    listing = inventory.with_directories(inventory.list_files(spark, root), root)
    names = lambda df: sorted(r["name"].removeprefix(root) for r in df.collect())
    assert names(inventory.level_of(listing, root)) == ["/a.parquet", "/note.md", "/t.csv"]
    assert names(inventory.search(listing, "", path=root)) == ["/a.parquet", "/a.parquet/p1.parquet", "/a.parquet/p2.parquet", "/t.csv"]
    sizes = inventory.dataset_sizes(inventory.list_files(spark, root)).collect()
    assert [(r["dataset"].removeprefix(root), r["size"]) for r in sizes] == [("/a.parquet", 20)]
    loadable = {r["name"].removeprefix(root): r["is_loadable"] for r in inventory.loadable(listing).collect()}
    assert loadable["/a.parquet"] and loadable["/note.md"]
    assert names(inventory.layer_files(listing, f"{root}/a.parquet")) == ["/a.parquet/p1.parquet", "/a.parquet/p2.parquet"]
    assert names(inventory.layer_files(listing, f"{root}/t.csv")) == ["/t.csv"]
    assert inventory.layer_files(listing, "https://x.y/z.json").first()["size"] == 0


def test_empty_dataset_has_epoch(spark):
    rows = [("/d/a.parquet/x.txt", 5)]
    listing = spark.createDataFrame(rows, "name string, size long").withColumns({"updated": F.current_timestamp(), "type": F.lit("file")})
    row = inventory.dataset_sizes(listing).withColumn("seconds", F.unix_timestamp("updated")).first()
    assert (row["size"], row["seconds"]) == (0, 0)


def test_schema_catalogue(spark):
    layers = {"a": spark.sql("SELECT 1 AS k, 5 AS area"), "b": spark.sql("SELECT 'x' AS k, 1D AS area")}
    conflicts = inventory.schema_conflicts(inventory.schema_catalogue(layers)).collect()
    assert [(r["column"], r["types"]) for r in conflicts] == [("k", ["int", "string"])]
    assert inventory.has_column(layers, "k") and not inventory.has_column(layers, "zz")
    with pytest.raises(ValueError, match="Several"):
        inventory.column_type(layers, "k")
    with pytest.raises(ValueError, match="No column"):
        inventory.column_type(layers, "zz")


def test_ingest_goes_on_where_it_stopped(spark, tmp_path):
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    df = spark.range(20).withColumn("v", F.col("id") * 2)
    df.repartition(4).write.parquet(source)

    def run():
        stream = ingest.stream_files(spark, source, df.schema, max_files=1)
        return ingest.ingest(stream, target, mark, lambda rows: rows.filter("v >= 10"))

    first = run()
    assert len(first.recentProgress) >= 4 and spark.read.parquet(target).count() == 15
    spark.range(100, 103).withColumn("v", F.col("id")).write.mode("append").parquet(source)
    run()
    assert spark.read.parquet(target).count() == 18


def test_stream_of_prepared_rows(spark, tmp_path):
    source = layer(spark, 30).select("_unique_id", "geometry")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.stream_layer(spark, str(tmp_path / "in"), source.schema, crs=3857, max_files=2)
    ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "mark"))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() == 30 and found.filter("minx BETWEEN 0 AND 0.001 AND area = 0").count() == 30
    assert found.select("__file_path").distinct().count() == 3


def test_attributes_and_colour_folders(spark, tmp_path):
    df = layer(spark, 10).withColumn("_color", F.when(F.col("minx") > 4, "#ff0000"))
    sinks.write_by_color(df, str(tmp_path / "c"))
    assert {p.name for p in (tmp_path / "c").glob("_color=*")} == {"_color=%23ff0000", "_color=__HIVE_DEFAULT_PARTITION__"}
    sinks.write_attributes(df, str(tmp_path / "t"))
    assert set(spark.read.json(str(tmp_path / "t")).columns) == {"id", "_color"}


def test_files_to_drawn_view(spark, tmp_path):
    """Two layers in metres on disk: prepare, number, join in SQL, colour, draw."""
    grid = spark.range(100).select(
        "id",
        F.concat(F.lit("c"), (F.col("id") % 4).cast("string")).alias("county"),
        F.element_at(F.array(F.lit("rail"), F.lit("bus"), F.lit("air")), (F.col("id") % 3 + 1).cast("int")).alias("kind"),
        (262000.0 + F.col("id") * 10).alias("x"),
        F.lit(6649000.0).alias("y"),
    )
    point = to_wkb(geo.point(F.col("x"), F.col("y")))
    grid.select("county", "kind", point.alias("geometry")).repartition(3).write.parquet(str(tmp_path / "stops.parquet"))
    areas = spark.range(4).select(
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("county"),
        F.concat(F.lit("County "), F.col("id").cast("string")).alias("name"),
        to_wkb(geo.box(F.lit(262000.0), F.lit(6648000.0), F.lit(263000.0) + F.col("id"), F.lit(6650000.0))).alias("geometry"),
    )
    areas.coalesce(1).write.parquet(str(tmp_path / "counties.parquet"))
    stops, counties = (str(tmp_path / n) for n in ("stops.parquet", "counties.parquet"))

    def load(path):
        rows = prepare(readers.read_parquet(spark, path), crs=25833)
        return with_unique_id(rows, inventory.search(inventory.list_files(spark, path), ".parquet"))

    spec = ViewSpec(
        layers={
            stops: "SELECT _unique_id, kind, county, name FROM df JOIN counties USING (county) WHERE kind != 'air'",
            counties: None,
        },
        column="kind",
        color_dict={"rail": "darkgreen"},
        bounds=[10.0, 59.0, 11.5, 60.5],
        max_rows=30,
    )
    view = build_view(spec, load)
    rows = view.features.collect()
    assert len(rows) == 30 + 4
    assert {r["_color"] for r in rows if r["kind"] == "rail"} == {"#006400"}
    assert {r["area"] for r in rows if r["layer"] == "counties"} == {2e6, 2002000.0, 2004000.0, 2006000.0}
    assert all(r["name"].startswith("County") for r in rows if r["layer"] == "stops")
    assert {r["label"] for r in view.legend.collect()} == {"rail", "bus", "Missing"}
    sinks.write_geojson_lines(view.features, str(tmp_path / "features"))
    drawn = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "features")).collect()]
    assert {d["geometry"]["type"] for d in drawn} == {"Point", "Polygon"}
    x, y = next(d for d in drawn if d["geometry"]["type"] == "Point")["geometry"]["coordinates"]
    assert 10 < x < 11.5 and 59 < y < 60.5


def test_files_of_other_types_and_columns_lose_nothing(spark, tmp_path):
    target = tmp_path / "my data"
    target.mkdir()
    pq.write_table(pa.table({"a": [1, 2, 3], "b": ["x", "y", "z"]}), target / "1.parquet")
    pq.write_table(pa.table({"a": ["4", "5", "6", "7"], "extra": [1.5] * 4}), target / "2.parquet")
    (target / "3.parquet").write_bytes(b"no parquet at all")
    (target / "4.parquet").write_bytes(b"")
    df = readers.read_parquet(spark, str(target))
    assert sorted(r["a"] for r in df.collect()) == list("1234567")
    assert df.filter("extra = 1.5").count() == 4 and df.filter("b IS NOT NULL").count() == 3
    skipped = readers.skipped_files(spark, str(target)).collect()
    # Spark lists no files of zero length.
    assert [r["name"][-9:] for r in skipped] == ["3.parquet"]
    ids = with_unique_id(df, inventory.list_files(spark, str(target)))
    assert ids.filter("_unique_id IS NULL").count() == 0
    kinds = {r["column"]: r["types"] for r in inventory.schema_conflicts(readers.file_catalogue(spark, str(target))).collect()}
    assert kinds == {"a": ["int64", "string"]}


def test_a_damaged_page_is_an_error(spark, tmp_path):
    file = tmp_path / "a.parquet"
    pq.write_table(pa.table({"a": list(range(200_000))}), file, compression="NONE", use_dictionary=False)
    raw = bytearray(file.read_bytes())
    raw[4:400] = bytes(396)
    file.write_bytes(raw)
    with pytest.raises(Exception, match="(?i)parquet|corrupt|read|page"):
        readers.read_parquet(spark, str(file)).agg(F.sum("a")).collect()


def test_boxes_across_the_central_meridian_hold_their_rows(spark):
    schema = "__file_path string, minx double, miny double, maxx double, maxy double"
    stats = spark.createDataFrame([("a", 100000.0, 7800000.0, 900000.0, 7900000.0)], schema)
    row = readers.stats_to_4326(stats, 25833).first()
    assert 71.194 < row["maxy"] < 71.3
    from geoquarry.operators.raster import project_bounds

    b = project_bounds(spark, (5, 70, 25, 71), 25833)
    from geoquarry.functions.crs import reproject_xy

    inside = reproject_xy(spark.createDataFrame([(15.0, 70.0001), (10.0, 70.01)], "x double, y double"), "x", "y", 4326, 25833)
    assert all(b.minx <= r["x"] <= b.maxx and b.miny <= r["y"] <= b.maxy for r in inside.collect())


def test_many_paths_are_numbered_as_few(spark, monkeypatch):
    from geoquarry.operators import prepare as op

    files = spark.range(3000).select(F.concat(F.lit("/d/ü "), F.hash("id")).alias("__file_path")).union(
        spark.sql("SELECT CAST(NULL AS STRING)")
    )
    few = {r[0]: r[1] for r in op.file_index(files).collect()}
    monkeypatch.setattr(op, "BROADCAST_ROWS", 10)
    assert {r[0]: r[1] for r in op.file_index(files).collect()} == few
    assert sorted(few.values()) == list(range(3000))


def test_view_over_a_geojson_layer(spark, tmp_path):
    features = [{"type": "Feature", "properties": {"v": i}, "geometry": {"type": "Point", "coordinates": [i, i]}} for i in (1, 2, 3, 3)]
    (tmp_path / "my layer.geojson").write_text("\n".join(map(json.dumps, features)))
    path = str(tmp_path / "my layer.geojson")
    view = build_view(ViewSpec({path: None}, column="v"), {path: readers.read_geojson(spark, path, "v int", lines=True)})
    ids = [r["_unique_id"] for r in view.features.collect()]
    assert len(ids) == len(set(ids)) == 4 and None not in ids
    hidden = view.hidden.first()
    assert hidden["n_rows"] == 4 and not hidden["rows_are_hidden"]
    everything = build_view(ViewSpec({path: None}, column="v", max_rows=None), {path: readers.read_geojson(spark, path, "v int", lines=True)})
    assert everything.features.count() == 4


def test_geometry_collections_raise(spark, tmp_path):
    shape = {"type": "GeometryCollection", "geometries": []}
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "Feature", "properties": {"v": 1}, "geometry": shape}))
    with pytest.raises(Exception, match="GeometryCollection"):
        readers.read_geojson(spark, str(tmp_path / "c.geojson"), "v int", lines=True).collect()


def test_geojson_infers_properties(spark, tmp_path):
    """Types widen over all features; features without properties, and no features, give a layer."""
    point = {"type": "Point", "coordinates": [10, 60]}
    rows = [{"v": 1}, {"v": 2.5, "name": "x"}, None]
    features = [{"type": "Feature", "properties": p, "geometry": point} for p in rows]
    one, many = tmp_path / "one.geojson", tmp_path / "many.geojson"
    one.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    many.write_text("\n".join(map(json.dumps, features)))
    for path, lines in ((one, False), (many, True)):
        found = readers.read_geojson(spark, str(path), lines=lines)
        assert sorted(map(tuple, found.select("v", "name", "minx").collect()), key=str) == sorted(
            [(1.0, None, 10.0), (2.5, "x", 10.0), (None, None, 10.0)], key=str
        )
    bare = tmp_path / "bare.geojson"
    bare.write_text(json.dumps({"features": [{"properties": {}, "geometry": point}]}))
    assert readers.read_geojson(spark, str(bare)).select("minx", "maxy").first() == (10.0, 60.0)
    none = tmp_path / "none.geojson"
    none.write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    assert readers.read_geojson(spark, str(none)).count() == 0
