"""Zone maps, positions in text files, GeoParquet layers, hot cells and large polygons."""

import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from geoquarry.functions import geometry as geo
from geoquarry.functions import overlap
from geoquarry.functions.wkb import decode_batch, to_wkb
from geoquarry.operators import spatial
from geoquarry.operators.prepare import with_unique_id
from geoquarry.operators.profile import file_statistics
from geoquarry.sources import geoparquet, positions, readers, sinks, zones


def jobs_of(spark, action):
    """How many jobs a piece of planning starts."""
    tag = f"t{random.random()}"
    spark.sparkContext.setJobGroup(tag, tag)
    out = action()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(tag))
    spark.sparkContext.setJobGroup("", "")
    return out, found


@pytest.fixture
def placed(spark, tmp_path):
    """A layer of 4,000 points in files by place, several row groups each, some rows without bounds."""
    path = tmp_path / "layer"
    path.mkdir()
    chance = np.random.default_rng(4)
    for k in range(6):
        x = np.sort(np.concatenate((chance.uniform(k, k + 0.2, 300), chance.uniform(k + 20, k + 20.2, 300))))
        y = chance.uniform(0, 1, 600)
        table = pa.table({"id": np.arange(600) + 600 * k, "minx": x, "miny": y, "maxx": x + 0.01, "maxy": y + 0.01})
        pq.write_table(table, path / f"part-{k}.parquet", row_group_size=100)
    nothing = pa.array([None] * 5, pa.float64())
    pq.write_table(
        pa.table({"id": np.arange(9000, 9005), **dict.fromkeys(("minx", "miny", "maxx", "maxy"), nothing)}),
        path / "without.parquet",
    )
    return str(path)


def test_zones_give_the_rows_of_the_viewport(spark, placed, tmp_path):
    found = zones.zone_map(spark, placed, f"{tmp_path}/zones")
    assert found.count() == 6 * 6 + 1
    everything = readers.read_parquet(spark, placed)
    for bounds in ((1.0, 0.2, 1.1, 0.4), (5.0, 0, 20.1, 1), (10, 0, 12, 1), (-5, -5, 99, 99), (50, 50, 51, 51)):
        rows, jobs = jobs_of(spark, lambda b=bounds: zones.read_in_zones(spark, placed, found, b))
        assert jobs <= 3
        expected = zones._in_bounds(everything, bounds, ("minx", "miny", "maxx", "maxy"))
        assert sorted(r["id"] for r in rows.collect()) == sorted(r["id"] for r in expected.collect())
    # Files that have rows on both sides of a viewport, but none in it, are left alone.
    between = zones.surviving_zones(found, (10, 0, 12, 1)).select("__file_path").distinct().collect()
    assert [r[0].rsplit("/", 1)[1] for r in between] == ["without.parquet"]
    ranges = zones.row_ranges(zones.surviving_zones(found, (1.0, 0, 1.2, 1), keep_missing=False)).collect()
    assert {(r["first_row"], r["last_row"]) for r in ranges} == {(0, 299), (0, 4)}  # the second has no statistics


def test_zone_statistics_are_those_of_the_rows(spark, placed, tmp_path):
    found = zones.zone_statistics(zones.zone_map(spark, placed, f"{tmp_path}/zones"))
    plain = file_statistics(readers.read_parquet(spark, placed))
    order = ("__file_path", "n_rows", "minx", "miny", "maxx", "maxy")
    assert sorted(map(tuple, found.select(*order).collect())) == sorted(map(tuple, plain.select(*order).collect()))


def test_refresh_reads_footers_of_changed_files_alone(spark, placed, tmp_path, monkeypatch):
    target = f"{tmp_path}/zones"
    first = zones.zone_map(spark, placed, target)
    seen = []
    real = zones.read_zones
    monkeypatch.setattr(zones, "read_zones", lambda files, names: seen.append([r["name"] for r in files.select("name").collect()]) or real(files, names))
    again = zones.zone_map(spark, placed, target)
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect()))
    assert seen[-1:] in ([], [[]])
    time.sleep(1.1)
    pq.write_table(pa.table({"id": [1], "minx": [70.0], "miny": [7.0], "maxx": [70.5], "maxy": [7.5]}), f"{placed}/part-2.parquet")
    (tmp_path / "layer" / "part-3.parquet").unlink()
    (tmp_path / "layer" / "note.parquet").write_text("no parquet")
    after = zones.zone_map(spark, placed, target)
    assert sorted(n.rsplit("/", 1)[1] for n in seen[-1]) == ["note.parquet", "part-2.parquet"]
    names = {r["__file_path"].rsplit("/", 1)[1] for r in after.collect()}
    assert names == {"part-0.parquet", "part-1.parquet", "part-2.parquet", "part-4.parquet", "part-5.parquet", "without.parquet", "note.parquet"}
    assert [r["id"] for r in zones.read_in_zones(spark, placed, after, (70, 7, 71, 8)).collect() if r["minx"]] == [1]


def test_footers_are_read_once_a_listing(spark, placed, monkeypatch):
    calls = []
    real = readers.file_schemas
    monkeypatch.setattr(readers, "file_schemas", lambda *a: calls.append(1) or real(*a))
    assert readers.read_parquet(spark, placed).count() == 3605
    assert readers.read_parquet(spark, placed).count() == 3605
    assert len(calls) == 1
    pq.write_table(pa.table({"id": [1], "other": ["x"]}), f"{placed}/new.parquet")
    assert readers.read_parquet(spark, placed).count() == 3606
    assert len(calls) == 2


@pytest.mark.parametrize("split", ["2k", "128m"])
def test_positions_in_csv_files_that_are_cut(spark, tmp_path, split):
    rows = {}
    for k, n in enumerate((1, 700, 2500, 0)):
        lines = ["a,b", *(f'{10_000 * k + j},"x{j % 13}"' for j in range(n))]
        (tmp_path / f"f{k}.csv").write_text("\n".join(lines) + "\n")
        rows.update({10_000 * k + j: (f"f{k}.csv", j) for j in range(n)})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        df = spark.read.option("header", True).schema("a long, b string").csv(str(tmp_path))
        found = positions.with_positions(df)
        assert found.columns == ["a", "b", "__file_path", "__row_index"]
        got = {r["a"]: (r["__file_path"].rsplit("/", 1)[1], r["__row_index"]) for r in found.collect()}
        ids = {r["a"]: r["_unique_id"] for r in with_unique_id(found).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == rows
    assert ids == {a: f"{('f0.csv', 'f1.csv', 'f2.csv').index(f)}.{j}" for a, (f, j) in rows.items()}


def test_positions_in_feature_collections(spark, tmp_path):
    features = ", ".join(
        f'{{"type": "Feature", "properties": {{"k": {k}}}, "geometry": {{"type": "Point", "coordinates": [{k}, 1]}}}}' for k in range(20)
    )
    (tmp_path / "c.geojson").write_text(f'{{"type": "FeatureCollection", "features": [{features}]}}')
    rows = readers.read_geojson(spark, str(tmp_path / "c.geojson"), "k long", positions=True)
    assert sorted((r["k"], r["__row_index"]) for r in rows.collect()) == [(k, k) for k in range(20)]


def test_geoparquet_layer_takes_few_scans(spark, tmp_path):
    """Fifty schemas, two CRSs, two geometry columns, a column with two types, a file without geometry."""
    path = f"{tmp_path}/geo"
    points = spark.range(200).select(
        F.col("id").alias("key"), (F.col("id") % 25).alias("part"), (8 + F.col("id") / 40).alias("x"), (58 + F.col("id") / 50).alias("y")
    )
    for part in range(25):
        for metric in (False, True):
            mine = points.filter(f"part = {part} AND key % 2 = {int(metric)}").coalesce(1)
            value = F.lit(part) if part % 2 else F.lit(str(part))
            kind = F.lit(1).cast("long" if part == 3 else "int").alias("kind")
            name, crs = ("shape", "EPSG:3857") if metric else ("geometry", "EPSG:4326")
            x, y = F.col("x"), F.col("y")
            if metric:
                x = F.radians(x) * 6378137.0
                y = F.log(F.tan(F.lit(math.pi / 4) + F.radians(y) / 2)) * 6378137.0
            geoparquet.write_geoparquet(
                mine.select("key", kind, value.alias(f"v{part}"), to_wkb(geo.point(x, y)).alias(name)), path, crs, name
            )
    pq.write_table(pa.table({"key": [1000, 1001]}), f"{path}/plain.parquet")
    found = geoparquet.read_geoparquet(spark, path)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"(?<!Local)Relation \[", plan)) <= 5
    rows = {r["key"]: r for r in found.collect()}
    assert len(rows) == 202
    for k in range(200):
        assert rows[k]["minx"] == pytest.approx(8 + k / 40, abs=1e-9)
        assert rows[k]["maxy"] == pytest.approx(58 + k / 50, abs=1e-9)
        assert str(rows[k][f"v{k % 25}"]) == str(k % 25)
    assert rows[1000]["minx"] is None


def test_unknown_crs_is_an_error(spark, tmp_path):
    point = spark.range(1).select("id", to_wkb(geo.point(F.lit(1.0), F.lit(2.0))).alias("geometry"))
    geoparquet.write_geoparquet(point, f"{tmp_path}/a", "EPSG:99999")
    with pytest.raises(ValueError, match="99999"):
        geoparquet.read_geoparquet(spark, f"{tmp_path}/a")


# --- spatial join -----------------------------------------------------------------------------


def test_equal_points_spread_over_parts(spark):
    """20,000 equal points are dealt to twenty parts of about the same size, by number."""
    points = spark.range(20_000).selectExpr("10.0 AS x", "60.0 AS y")
    packed = spatial._packed(points, "l", ("x", "y", "x", "y"))
    cell = 1.0
    entries = spatial._entries(packed, "l", cell, [], True)
    key = {"__level": 0, "__ix": 10, "__iy": 60}
    hot = spark.createDataFrame([(*key.values(), 20_000.0, 5.0)], "__level int, __ix long, __iy long, n1 double, n2 double")
    dealing = spark.createDataFrame([(0, 10, 60, -1, -1, 20, 1)], "__level int, __ix long, __iy long, __sx long, __sy long, p1 long, p2 long")
    sizes = [r["count"] for r in spatial._dealt(entries, hot, dealing, "l", cell).groupBy("__d1").count().collect()]
    assert len(sizes) == 20
    assert sum(sizes) == 20_000
    assert max(sizes) < 1.5 * min(sizes)


@pytest.mark.parametrize("hot_rows", [4, 30, 1 << 17])
def test_hot_cells_keep_every_pair(spark, hot_rows):
    """Clusters, equal rows and boxes of many sizes, with cells cut and dealt or not at all."""
    chance = random.Random(hot_rows)
    left = [(k, chance.choice([0.0, 1.0, 1.02]) + chance.random() * chance.choice([0, 0.1, 30]), chance.random(), 0.0) for k in range(150)]
    left += [(200 + k, 5.0, 5.0, 0.0) for k in range(60)]
    right = [(k, chance.random() * 30, chance.random(), chance.choice([0.01, 0.3, 4.0, 25.0])) for k in range(70)]
    right += [(100 + k, 4.5, 4.5, 1.0) for k in range(20)]
    schema = "id long, minx double, miny double, w double"
    a, b = (spark.createDataFrame(rows, schema).selectExpr("id", "minx", "miny", "minx + w AS maxx", "miny + w AS maxy") for rows in (left, right))
    found = spatial.bounds_join(a, b, hot_rows=hot_rows).select("l.id", "r.id")
    pairs = sorted(map(tuple, found.collect()))
    expected = sorted(
        (i, j)
        for i, x, y, w in left
        for j, u, v, s in right
        if x <= u + s and x + w >= u and y <= v + s and y + w >= v
    )
    assert pairs == expected


def ring(n, radius, wobble=0.0, x=0.0, y=0.0):
    angle = np.linspace(0, 2 * np.pi, n, endpoint=False)
    r = radius + wobble * np.cos(angle * 37)
    xs, ys = x + r * np.cos(angle), y + r * np.sin(angle)
    return np.append(xs, xs[0]), np.append(ys, ys[0])


def wkb(x, y):
    body = np.column_stack((x, y)).astype("<f8").tobytes()
    return b"\x01" + (3).to_bytes(4, "little") + (1).to_bytes(4, "little") + len(x).to_bytes(4, "little") + body


def rows_of(*shapes):
    return overlap._Rows(decode_batch(pa.array([wkb(*s) for s in shapes])))


@pytest.mark.parametrize("n", [300, 700])
def test_strips_add_up_to_all_pairs(n):
    shapes = [ring(n, 1.0, 0.2), ring(n + 13, 0.8, 0.3, 0.4, 0.1), ring(n, 1.0, 0.2), ring(n, 0.1, x=5.0)]
    zigzag = (np.array([*([0.0, 1.0] * (n // 2)), -0.2, 0.0]), np.array([*np.linspace(0, 1, n), 2.0, 0.0]))
    rows = rows_of(*shapes, zigzag)
    for i, j in ((0, 1), (0, 2), (0, 3), (1, 4), (4, 0)):
        whole = overlap._all_pairs_areas(rows, np.array([i]), rows, np.array([j]))[0]
        assert overlap.swept_area(rows, i, rows, j) == pytest.approx(whole, abs=1e-9)
        parts = [overlap.swept_area(rows, i, rows, j, k, 7) for k in range(7)]
        assert sum(parts) == pytest.approx(whole, abs=1e-9)


def test_large_pair_is_fast():
    rows = rows_of(ring(20_000, 1.0, 0.2), ring(20_000, 0.9, 0.1, 0.3))
    begin = time.perf_counter()
    found = overlap.shared_areas(rows, np.array([0]), rows, np.array([1]))[0]
    assert time.perf_counter() - begin < 2
    coarse = rows_of(ring(2000, 1.0, 0.2), ring(2000, 0.9, 0.1, 0.3))
    assert found == pytest.approx(overlap._all_pairs_areas(coarse, np.array([0]), coarse, np.array([1]))[0], rel=1e-3)


def test_large_polygons_are_compared_strip_by_strip(spark, monkeypatch):
    """Circles, some of them large, against the formula for two circles."""
    monkeypatch.setattr(spatial, "LARGE_POINTS", 500)
    monkeypatch.setattr(spatial, "STRIP_POINTS", 150)
    chance = random.Random(3)
    rows = [(k, chance.random() * 4, chance.random() * 4, 0.3 + chance.random(), chance.choice([64, 900])) for k in range(24)]
    data = [
        (k, x - r, y - r, x + r, y + r, bytearray(wkb(*ring(n, r, x=x, y=y)))) for k, x, y, r, n in rows
    ]
    df = spark.createDataFrame(data, "id long, minx double, miny double, maxx double, maxy double, geometry binary")
    found = {(r[0], r[1]) for r in spatial.overlap_join(df, df, min_ratio=0.1).select("l.id", "r.id").collect()}
    for i, x, y, r, _ in rows:
        for j, u, v, s, _ in rows:
            d = math.hypot(x - u, y - v)
            if d >= r + s:
                share = 0.0
            elif d <= abs(r - s):
                share = min(r, s) ** 2 / r**2
            else:
                a, b = (math.acos((d * d + p * p - q * q) / (2 * d * p)) for p, q in ((r, s), (s, r)))
                share = (r * r * (a - math.sin(2 * a) / 2) + s * s * (b - math.sin(2 * b) / 2)) / (math.pi * r * r)
            if abs(share - 0.1) > 0.005:
                assert ((i, j) in found) == (share > 0.1)


def cut_box(n, x0, y0, x1, y1):
    """A box whose sides are cut into ``n`` pieces."""
    k = np.arange(n) / n
    xs = (x0 + (x1 - x0) * k, np.full(n, x1), x1 - (x1 - x0) * k, np.full(n, x0), [x0])
    ys = (np.full(n, y0), y0 + (y1 - y0) * k, np.full(n, y1), y1 - (y1 - y0) * k, [y0])
    return np.concatenate(xs), np.concatenate(ys)


def blob(chance, n, x, y, size):
    angle = np.linspace(0, 2 * np.pi, n, endpoint=False)
    r = size * np.maximum(1 + sum(chance.gauss(0, 0.3 / (k + 1)) * np.cos(k * angle + k) for k in range(1, 9)), 0.1)
    xs, ys = x + r * np.cos(angle), y + r * np.sin(angle) * chance.uniform(0.2, 1)
    return np.append(xs, xs[0]), np.append(ys, ys[0])


def test_a_box_inside_a_polygon():
    chance = random.Random(8)
    far = [(x + 5e5, y + 6.6e6) for x, y in (blob(chance, n, 0.0, 0.0, 0.7) for n in (7, 50, 900))]
    shapes = [cut_box(50, 1.5, 57.25, 2.2, 58.0), ring(3, 1.0), ring(900, 1.0), *far, *(blob(chance, 70, 3.0, 4.0, 2.0) for _ in range(9))]
    g = rows_of(*shapes)
    rows = np.arange(len(shapes))
    bounds, box = overlap._inside(g, rows)
    assert bounds.tolist() == [[x.min(), y.min(), x.max(), y.max()] for x, y in shapes]
    assert box[0].tolist() == bounds[0].tolist()
    size = (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
    assert (size > 0.2 * g.area).all()
    boxes = rows_of(*[cut_box(1, *b) for b in box])
    assert overlap.shared_areas(boxes, rows, g, rows) == pytest.approx(size, rel=1e-9)


def test_no_box_inside_what_counts_a_place_twice_or_less_than_once():
    crossed = (np.array([0.0, 2.0, 2.0, 0.0, 0.0]), np.array([0.0, 2.0, 0.0, 2.1, 0.0]))
    twice = tuple(np.concatenate((v[:-1], v)) for v in cut_box(3, 0.0, 0.0, 1.0, 1.0))
    bounds, _ = overlap._inside(rows_of(crossed, twice, ring(9, 1.0)), np.arange(3))
    assert np.isnan(bounds).all(axis=1).tolist() == [True, True, False]


def geometry_rows(spark, shapes):
    data = [
        (k, None if s is None else bytearray(wkb(*s)), *map(float, b))
        for k, (s, b) in enumerate((s, (0, 0, 9, 9) if s is None else (s[0].min(), s[1].min(), s[0].max(), s[1].max())) for s in shapes)
    ]
    return spark.createDataFrame(data, "id long, geometry binary, minx double, miny double, maxx double, maxy double")


def test_boxes_inside_settle_pairs_of_large_polygons(spark, monkeypatch):
    """Pairs that share clearly more or less than asked for are not compared by their edges."""
    chance = random.Random(9)
    boxes = [(x, y, x + chance.uniform(1, 3), y + chance.uniform(1, 3)) for x, y in ((chance.uniform(0, 8), chance.uniform(0, 8)) for _ in range(40))]
    # A tenth of each side is just the share asked for: that is left to the edges.
    boxes += [(20.0, 20.0, 21.0, 21.0), (20.9, 20.9, 21.9, 21.9)]
    df = geometry_rows(spark, [cut_box(50, *b) for b in boxes])
    compared = []
    monkeypatch.setattr(spatial, "geometries_relate", lambda *args: compared.append(args) or F.lit(False))
    found = {tuple(r) for r in spatial.overlap_join(df, df).select("l.id", "r.id").collect()}
    shares = {
        (i, j): max(min(a[2], b[2]) - max(a[0], b[0]), 0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0) / ((a[2] - a[0]) * (a[3] - a[1]))
        for i, a in enumerate(boxes) for j, b in enumerate(boxes)
    }
    assert found == {p for p, share in shares.items() if share > 0.01 + 1e-5}
    assert len(compared) == 1 and len(found) > 100


@pytest.mark.parametrize("ratio", [0.01, 0.1, 0.5])
def test_large_polygons_equal_all_pairs(spark, ratio):
    """Blobs, crossed and empty ones among them, of few and many edges, against each pair on its own."""
    chance = random.Random(10)
    shapes = [blob(chance, chance.choice([5, 60, 400]), chance.uniform(0, 9), chance.uniform(0, 9), chance.uniform(0.2, 2)) for _ in range(60)]
    shapes += [None, (np.array([0.0, 9.0, 9.0, 0.0, 0.0]), np.array([0.0, 9.0, 0.0, 8.0, 0.0])), (np.zeros(5) + 4, np.array([0.0, 9.0, 9.0, 0.0, 0.0]))]
    df = geometry_rows(spark, shapes)
    pairs = spatial.overlap_join(df, df, min_ratio=ratio)
    found = sorted(map(tuple, pairs.select("l.id", F.col("r.id").alias("other")).collect()))
    other = df.select(F.col("id").alias("other"), F.col("geometry").alias("h"))
    every = df.crossJoin(other).filter(overlap.geometries_relate(F.col("geometry"), F.col("h"), ratio))
    assert found == sorted(map(tuple, every.select("id", "other").collect())) and len(found) > 100
    assert pairs.schema["l"].dataType.names == df.columns


def test_written_layer_has_row_groups_by_place(spark, tmp_path):
    rows = spark.range(500).selectExpr("CAST(id AS STRING) AS _unique_id", "id % 20 * 1.0 AS minx", "id % 7 * 1.0 AS miny", "id % 20 + 0.5 AS maxx", "id % 7 + 0.5 AS maxy")
    sinks.write_layer(rows, f"{tmp_path}/l", cell=4.0, files=5)
    found = zones.zone_map(spark, f"{tmp_path}/l", f"{tmp_path}/z")
    kept = zones.surviving_zones(found, (0, 0, 1, 1)).count()
    assert 0 < kept < found.count()


def test_dear_rows_are_spread(spark):
    """A scan of one task, for work that is dear for every row."""
    from geoquarry.operators import relational

    rows = relational.spread(spark.range(0, 10_000, 1, 1), 1_000)
    assert rows.rdd.getNumPartitions() == 10
    assert rows.agg(F.sum("id")).first()[0] == 49_995_000


def test_pairs_of_a_few_hundred_edges_are_fast():
    """Only edges above the same place are paired: 2,500 pairs of polygons of 250 edges."""
    chance = random.Random(5)
    rows = rows_of(*[ring(250, 1.0, 0.1, chance.random() * 2, chance.random() * 2) for _ in range(50)])
    a, b = (v.ravel() for v in np.meshgrid(np.arange(50), np.arange(50)))
    begin = time.perf_counter()
    found = overlap.relate(rows, a, rows, b, 0.3)
    assert time.perf_counter() - begin < 4
    some = slice(0, 300)
    shares = overlap._all_pairs_areas(rows, a[some], rows, b[some]) / rows.area[a[some]]
    sure = np.abs(shares - 0.3) > 1e-9
    assert (found[some] == (shares > 0.3))[sure].all() and sure.sum() > 250


def test_rows_of_hot_cells_are_copied_a_bounded_number_of_times(spark):
    """4,000 equal points in 2,000 equal boxes: what is shuffled does not grow with the pairs."""
    points = spatial._packed(spark.range(4_000).selectExpr("10.5 AS x", "60.5 AS y"), "l", ("x", "y", "x", "y"))
    boxes = spark.range(2_000).selectExpr("10.2 AS minx", "60.2 AS miny", "10.8 AS maxx", "60.8 AS maxy")
    left = spatial._entries(points, "l", 1.0, [], True)
    right = spatial._entries(spatial._packed(boxes, "r", ("minx", "miny", "maxx", "maxy")), "r", 1.0, [], True)
    hot = spark.createDataFrame([(0, 10, 60, 4000.0, 2000.0)], "__level int, __ix long, __iy long, n1 double, n2 double")
    dealing = spatial._dealing(left, right, hot, 1.0, 8, 4096.0)
    rows = [spatial._dealt(df, hot, dealing, side, 1.0).count() for df, side in ((left, "l"), (right, "r"))]
    assert sum(rows) <= (spatial.COPIES + 2) * 6_000


def test_pairs_of_small_files_are_dealt_to_tasks(spark, monkeypatch):
    """Few rows with many pairs are not broadcast to the one task that scans the other side."""
    monkeypatch.setattr(spatial, "FEW_PAIRS", 1, raising=False)
    monkeypatch.setattr(spatial, "PAIRS_PER_TASK", 100, raising=False)
    boxes = spark.range(400).selectExpr("id", "id % 20 AS minx", "id % 17 AS miny", "id % 20 + 1.5 AS maxx", "id % 17 + 1.5 AS maxy")
    pairs = spatial.bounds_join(boxes, boxes).select("l.id", "r.id")
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "REPARTITION_BY_NUM" in plan
    cells = [(k % 20, k % 17) for k in range(400)]
    near = sum(abs(x - u) <= 1.5 and abs(y - v) <= 1.5 for x, y in cells for u, v in cells)
    assert pairs.count() == near


def test_pixels_at_points_on_edges_of_unlike_grids(spark):
    """Rasters of unlike grids against the definition; edges belong to the upper cell."""
    from geoquarry.operators import raster

    grids = [(0, 0.0, 0.0, 1.0, 6), (1, 0.375, -0.75, 0.25, 9), (2, 1e6, 2e6, 10.0, 4)]
    cells = [(k, b, x0 + c * s, y0 + r * s, float(100 * r + c)) for k, x0, y0, s, n in grids for b in ("B1", "B2") for c in range(n) for r in range(n)]
    pixels = spark.createDataFrame(cells, "raster_id long, band string, x double, y double, value double")
    places = [(k, 0.5 * (k % 14) - 1.0, 0.5 * (k // 14) - 1.0) for k in range(14 * 14)] + [(500, 1e6 + 5, 2e6 - 5), (501, 1e6 + 35, 2e6)]
    points = spark.createDataFrame(places, "id long, px double, py double")
    found = raster.pixels_at(points, pixels)
    assert found.columns == ["raster_id", "id", "px", "py", "band", "x", "y", "value"]
    # The grid is computed once and written, not once for each use.
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    expected = sorted(
        (i, k, b, v)
        for i, px, py in places
        for k, x0, y0, s, n in grids
        for k2, b, x, y, v in cells
        if k == k2 and x - s / 2 <= px < x + s / 2 and y - s / 2 <= py < y + s / 2
    )
    assert sorted(map(tuple, found.select("id", "raster_id", "band", "value").collect())) == expected


def test_tasks_grow_with_the_pairs():
    """Six times the rows are 36 times the pairs: a task is to have no more of them."""
    pairs, work = 227e6, spatial.COMPARE_WORK + 12
    few, many = (spatial._tasks(n, None, work) for n in (pairs, 36 * pairs))
    assert 100 < few and 36 * pairs / many <= 1.1 * pairs / few


def test_runs_of_pairs_of_polygons_add_up(monkeypatch):
    """Small polygons, ones larger than a run and ones without a width, in runs of any size."""
    chance = random.Random(7)
    shapes = [ring(n, 1.0, 0.1, chance.random() * 2, chance.random() * 2) for n in (4, 5, 30, 4, 12, 9)]
    rows = rows_of(*shapes, (np.ones(3), np.array([0.0, 2.0, 0.0])))
    a, b = (v.ravel() for v in np.meshgrid(np.arange(7), np.arange(7)))
    whole = [overlap._all_pairs_areas(rows, a[[k]], rows, b[[k]])[0] for k in range(49)]
    for size in (1, 64, 1 << 13):
        monkeypatch.setattr(overlap, "PAIRS_PER_CACHE", size)
        assert overlap._all_pairs_areas(rows, a, rows, b).tolist() == whole
