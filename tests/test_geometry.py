"""Geometry columns, WKB and projections against hand-computed values."""

import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoquarry.functions import geometry as geo
from geoquarry.functions.crs import normalize, reproject, reproject_xy
from geoquarry.functions.overlap import geometries_relate, strip_share
from geoquarry.functions.wkb import decode_batch, encode_batch, from_wkb, to_wkb


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def square(x, y, size):
    return ring((x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y))


SHAPES = {
    "unit square": (3, [[square(0, 0, 1)]], 1.0),
    "hole": (3, [[square(0, 0, 4), square(1, 1, 1)]], 15.0),
    "triangle": (3, [[ring((0, 0), (1, 0), (0, 1), (0, 0))]], 0.5),
    "two squares": (6, [[square(0, 0, 1)], [square(5, 5, 1)]], 2.0),
    "point": (1, [[ring((3, 4))]], 0.0),
    "line": (2, [[ring((0, 0), (3, 4))]], 0.0),
    "points": (4, [[ring((0, 0))], [ring((1, 2))]], 0.0),
    "lines": (5, [[ring((0, 0), (1, 1))], [ring((2, 2), (3, 3), (4, 3))]], 0.0),
    "empty polygon": (3, [], 0.0),
}
SCHEMA = "name string, g struct<kind:int,parts:array<array<array<struct<x:double,y:double>>>>>"


@pytest.fixture(scope="module")
def shapes(spark):
    rows = [(n, {"kind": k, "parts": p}) for n, (k, p, _) in SHAPES.items()]
    return spark.createDataFrame([*rows, ("null", None)], SCHEMA)


def test_area(shapes):
    found = dict(shapes.select("name", geo.area(F.col("g"))).collect())
    assert found == {n: a for n, (_, _, a) in SHAPES.items()} | {"null": None}


def test_bounds_and_empty(shapes):
    columns = [c.alias(k) for k, c in geo.bounds(F.col("g")).items()]
    found = {r[0]: tuple(r)[1:] for r in shapes.select("name", *columns).collect()}
    assert found["two squares"] == (0, 0, 6, 6)
    assert found["point"] == (3, 4, 3, 4)
    assert found["empty polygon"] == found["null"] == (None,) * 4


def test_centroid_and_length(shapes):
    found = {r[0]: r for r in shapes.select("name", geo.centroid(F.col("g")).alias("c"), geo.length(F.col("g")).alias("l")).collect()}
    assert (found["unit square"]["c"]["x"], found["unit square"]["l"]) == (0.5, 4.0)
    assert found["hole"]["c"]["x"] == pytest.approx((16 * 2 - 1.5) / 15)
    assert found["line"]["c"].asDict() == {"x": 1.5, "y": 2.0}
    assert found["line"]["l"] == 5.0
    assert found["points"]["c"].asDict() == {"x": 0.5, "y": 1.0}


def test_to_lines(shapes):
    lines = shapes.withColumn("g", geo.to_lines(F.col("g")))
    found = dict(lines.select("name", F.col("g.kind")).collect())
    assert found["hole"] == 5 and found["line"] == 2 and found["point"] is None
    assert dict(lines.select("name", geo.length(F.col("g"))).collect())["hole"] == 20.0


def test_geojson(shapes):
    found = dict(shapes.select("name", geo.geojson(F.col("g"))).collect())
    assert found["point"] == '{"type":"Point","coordinates":[3.0,4.0]}'
    assert found["line"] == '{"type":"LineString","coordinates":[[0.0,0.0],[3.0,4.0]]}'
    assert found["points"] == '{"type":"MultiPoint","coordinates":[[0.0,0.0],[1.0,2.0]]}'
    assert found["lines"].startswith('{"type":"MultiLineString","coordinates":[[[0.0,0.0],[1.0,1.0]],[[2.0')
    assert found["two squares"].startswith('{"type":"MultiPolygon","coordinates":[[[[0.0,0.0]')
    assert found["null"] is None


def test_wkb_round_trip(shapes):
    back = shapes.withColumn("w", to_wkb(F.col("g"))).withColumn("h", from_wkb(F.col("w")))
    assert back.filter(~F.col("g").eqNullSafe(F.col("h"))).count() == 0


def test_wkb_variants():
    little = struct.pack("<BIdd", 1, 1, 3.0, 4.0)
    big = struct.pack(">BIdd", 0, 1, 3.0, 4.0)
    with_z = struct.pack("<BIddd", 1, 1001, 3.0, 4.0, 9.0)
    with_srid = struct.pack("<BIIdd", 1, 0x20000001, 4326, 3.0, 4.0)
    with_ewkb_z = struct.pack("<BIddd", 1, 0x80000001, 3.0, 4.0, 9.0)
    big_line = struct.pack(">BIIdddd", 0, 2, 2, 3.0, 4.0, 5.0, 6.0)
    empty = struct.pack("<BIdd", 1, 1, np.nan, np.nan)
    geoms = decode_batch(pa.array([little, big, None, with_z, with_srid, with_ewkb_z, big_line, empty]))
    rows = geoms.to_pylist()
    point = {"kind": 1, "parts": [[[{"x": 3.0, "y": 4.0}]]]}
    assert [rows[i] for i in (0, 1, 3, 4, 5)] == [point] * 5
    assert rows[2] is None and rows[6]["parts"][0][0][1] == {"x": 5.0, "y": 6.0}
    assert rows[7] == {"kind": 1, "parts": []}
    written = encode_batch(geoms).to_pylist()
    assert written[0] == written[1] == written[3] == little and written[2] is None
    assert decode_batch(pa.array(written, pa.binary())).to_pylist() == rows
    with pytest.raises(ValueError):
        decode_batch(pa.array([struct.pack("<BII", 1, 7, 0)]))
    assert decode_batch(pa.array([], pa.binary())).to_pylist() == []
    assert decode_batch(pa.array([None], pa.binary())).to_pylist() == [None]


def test_sliced_batches():
    geoms = pa.array([struct.pack("<BIdd", 1, 1, float(i), 0.0) for i in range(6)])
    assert decode_batch(geoms.slice(2, 3)).to_pylist() == decode_batch(geoms).to_pylist()[2:5]


@pytest.mark.parametrize(
    "lon, lat, code, x, y, tolerance",
    [
        (5.0, 50.0, 3035, 3962799.45, 2999718.85, 0.01),
        (10.0, 52.0, 3035, 4321000.0, 3210000.0, 1e-6),
        (-(79 + 23 / 60 + 13.7 / 3600), 43 + 38 / 60 + 33.24 / 3600, 32617, 630084.0, 4833438.0, 1.0),
        (15.0, 0.0, 25833, 500000.0, 0.0, 1e-6),
        (15.0, 0.0, 32733, 500000.0, 10000000.0, 1e-6),
        (180.0, 0.0, 3857, 20037508.342789, 0.0, 1e-5),
    ],
)
def test_published_points(spark, lon, lat, code, x, y, tolerance):
    row = reproject_xy(spark.createDataFrame([(lon, lat)], "x double, y double"), "x", "y", 4326, code).first()
    assert row["x"] == pytest.approx(x, abs=tolerance)
    assert row["y"] == pytest.approx(y, abs=tolerance)


def test_crs_codes(spark, shapes):
    assert normalize("EPSG:25833") == 25833 and normalize("urn:ogc:def:crs:EPSG::3035") == 3035
    assert normalize('{"authority": "EPSG", "code": 25833}') == 25833
    with pytest.raises(ValueError):
        reproject(F.col("g"), 4326, 27700)
    same = shapes.filter(~F.col("g").eqNullSafe(reproject(F.col("g"), None, 4326)))
    assert same.count() == 0


def test_buffer(spark):
    df = spark.createDataFrame([(10.8, 59.9)], "x double, y double")
    circle = df.select(geo.buffer_points(geo.point(F.col("x"), F.col("y")), 1000.0).alias("g"))
    area = circle.select(geo.area(reproject(F.col("g"), 4326, 3035))).first()[0]
    assert area == pytest.approx(32 * 1e6 * np.sin(2 * np.pi / 64), rel=1e-7)
    with pytest.raises(Exception, match="points only"):
        df.select(geo.buffer_points(geo.box(*[F.col("x")] * 4), 1.0).alias("g")).collect()


CONCAVE = ring((0, 0), (10, 0), (10, 10), (5, 2), (0, 10), (0, 0))
PAIRS = [
    ((3, [[square(0, 0, 2)]]), (3, [[square(1, 1, 2)]]), 1.0),
    ((3, [[square(0, 0, 4), square(1, 1, 2)]]), (3, [[square(0, 0, 4)]]), 12.0),
    ((3, [[square(0, 0, 4), square(1, 1, 2)]]), (3, [[square(1, 1, 2)]]), 0.0),
    ((3, [[square(0, 0, 4)[::-1], square(1, 1, 2)]]), (3, [[square(0, 0, 2)]]), 3.0),
    ((6, [[square(0, 0, 1)], [square(5, 5, 1)]]), (3, [[square(0.5, 0.5, 5)]]), 0.5),
    ((3, [[square(0, 0, 1)]]), (3, [[square(1, 0, 1)]]), 0.0),
    ((3, [[CONCAVE]]), (3, [[CONCAVE]]), 60.0),
    ((3, [[CONCAVE]]), (3, [[square(0, 5, 5)]]), 0.5 * (3.125 + 0) * 5),
    ((1, [[ring((0, 0))]]), (3, [[square(0, 0, 1)]]), 0.0),
]
PAIR_SCHEMA = "a " + SCHEMA.split(" ", 3)[3] + ", b " + SCHEMA.split(" ", 3)[3] + ", area double"


def shared(a, b):
    """Shared area of two polygons, from the share of the first."""
    share = strip_share(to_wkb(F.col(a)), to_wkb(F.col(b)), F.lit(0), F.lit(1))
    return share * geo.area(F.col(a))


def test_intersection_area(spark):
    rows = [({"kind": a[0], "parts": a[1]}, {"kind": b[0], "parts": b[1]}, s) for a, b, s in PAIRS]
    df = spark.createDataFrame(rows, PAIR_SCHEMA).coalesce(1)
    for found, expected in df.select(shared("a", "b"), "area").collect():
        assert found == pytest.approx(expected, abs=1e-9)


def test_intersection_area_of_random_stars(spark):
    """Star-shaped polygons against a fine grid of points."""
    rng = np.random.default_rng(5)

    def star(cx, cy):
        angles = np.sort(rng.uniform(0, 2 * np.pi, 12))
        radius = rng.uniform(0.4, 2.0, 12)
        points = [(cx + r * np.cos(a), cy + r * np.sin(a)) for a, r in zip(angles, radius, strict=True)]
        return ring(*points, points[0])

    def covered(polygon, x, y):
        inside = np.zeros(len(x), dtype=bool)
        for p, q in zip(polygon[:-1], polygon[1:], strict=True):
            hit = (p["y"] > y) != (q["y"] > y)
            at = p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / (q["y"] - p["y"])
            inside ^= hit & (x < at)
        return inside

    grid = (np.arange(600) + 0.5) / 100 - 3
    x, y = (v.ravel() for v in np.meshgrid(grid, grid))
    pairs = [(star(0, 0), star(*rng.uniform(-1, 1, 2))) for _ in range(12)]
    rows = [({"kind": 3, "parts": [[a]]}, {"kind": 3, "parts": [[b]]}, float((covered(a, x, y) & covered(b, x, y)).sum() / 1e4)) for a, b in pairs]
    df = spark.createDataFrame(rows, PAIR_SCHEMA)
    for found, expected in df.select(shared("a", "b"), "area").collect():
        assert found == pytest.approx(expected, abs=0.02)


def line(*points):
    return (2, [[ring(*points)]])


RELATED = [
    ((3, [[square(0, 0, 10)]]), (3, [[square(9.5, 0, 10)]]), True),
    ((3, [[square(0, 0, 10)]]), (3, [[square(9.95, 0, 10)]]), False),
    ((3, [[square(0, 0, 1)]]), (3, [[square(1, 0, 1)]]), False),
    ((3, [[square(2, 2, 1)]]), (3, [[square(0, 0, 9)]]), True),
    ((1, [[ring((1, 0.5))]]), (3, [[square(0, 0, 1)]]), True),
    ((1, [[ring((1.01, 0.5))]]), (3, [[square(0, 0, 1)]]), False),
    ((1, [[ring((0.5, 0.5))]]), (3, [[square(0, 0, 1), square(0.25, 0.25, 0.5)]]), False),
    ((1, [[ring((2, 2))]]), (1, [[ring((2, 2))]]), True),
    ((1, [[ring((2, 2))]]), (1, [[ring((2, 3))]]), False),
    ((1, [[ring((1, 1))]]), line((0, 0), (2, 2)), True),
    (line((0, 0), (1, 1)), (3, [[square(0, 0, 1)]]), True),
    (line((0, 0), (2, 2)), (3, [[square(0, 0, 1)]]), False),
    (line((0, 5), (10, 5)), (3, [[CONCAVE]]), False),
    (line((0, 0), (2, 0)), line((1, 0), (3, 0)), True),
    (line((0, 0), (2, 0)), line((0, 0), (0, 2)), False),
    (line((0, 0), (1, 0)), line((0, 0), (3, 0)), True),
    (line((0, 0), (3, 0)), line((1, 0), (2, 0)), False),
    ((3, [[square(0, 0, 1)]]), line((0, 0), (1, 1)), False),
]


def test_relations(spark):
    rows = [({"kind": a[0], "parts": a[1]}, {"kind": b[0], "parts": b[1]}, float(r)) for a, b, r in RELATED]
    df = spark.createDataFrame(rows, PAIR_SCHEMA).coalesce(1)
    found = [r[0] for r in df.select(geometries_relate(to_wkb(F.col("a")), to_wkb(F.col("b")))).collect()]
    assert found == [r for _, _, r in RELATED]


def test_many_points_in_one_polygon(spark):
    star = {"kind": 3, "parts": [[CONCAVE]]}
    points = spark.range(1000).select(
        geo.point((F.col("id") % 40) / 4, (F.col("id") / 100).cast("double")).alias("p"), "id"
    )
    polygon = spark.createDataFrame([(star,)], "b " + SCHEMA.split(" ", 3)[3]).select(to_wkb(F.col("b")).alias("b"))
    rows = points.join(F.broadcast(polygon)).withColumn("hit", geometries_relate(to_wkb(F.col("p")), F.col("b")))
    for r in rows.select("id", "hit").collect():
        x, y = r["id"] % 40 / 4, r["id"] / 100
        edge = 2 + 8 * abs(x - 5) / 5
        assert r["hit"] == (0 <= x <= 10 and 0 <= y <= edge), (x, y)


def test_zoom_of_points_and_lines(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0, 2.0), (1.0, 2.0, 1.0, 3.0)], "minx double, miny double, maxx double, maxy double")
    b = {c: F.col(c) for c in df.columns}
    point, vertical = [r[0] for r in df.select(geo.zoom_for_bounds(b, 800, 800)).collect()]
    assert point == 16.0 and 0 < vertical < 16
