"""Operators on small tables: brute force, edge cases, errors."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoquarry.functions import colors
from geoquarry.functions import geometry as geo
from geoquarry.functions.overlap import geometries_relate
from geoquarry.functions.text import match_terms, stem
from geoquarry.functions.wkb import to_wkb
from geoquarry.model import Bounds, Layer
from geoquarry.operators import classify, filters, prepare, profile, raster, spatial, union
from geoquarry.operators.layer_sql import run_sql
from geoquarry.operators.relational import join_stats, ranked
from geoquarry.operators.sample import sample_per_layer
from geoquarry.plans.layers import LayerSet, short_names
from geoquarry.plans.view import ViewSpec, build_view


def cost(groups):
    return sum(float(((g - g.mean()) ** 2).sum()) for g in groups)


def best_cost(values, k):
    v = np.sort(values)
    spots = [i for i in range(1, len(v)) if v[i] != v[i - 1]]
    return min(cost(np.split(v, list(c))) for c in itertools.combinations(spots, k - 1))


@pytest.mark.parametrize("seed, k, bins", [(1, 3, 2000), (2, 4, 2000), (3, 3, 16), (4, 4, 12), (5, 2, 8)])
def test_breaks_are_optimal(spark, seed, k, bins):
    rng = np.random.default_rng(seed)
    values = np.round(np.concatenate([rng.normal(0, 1, 20), rng.normal(6, 2, 15), rng.exponential(3, 10)]), 3)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    breaks = classify.natural_breaks(df, "v", k, max_bins=bins)
    assert len(breaks) == k + 1 and breaks[0] == values.min() and breaks[-1] == values.max()
    v = np.sort(values)
    cut = np.searchsorted(v, breaks[1:-1], side="right")
    assert cost(np.split(v, cut)) == pytest.approx(best_cost(values, k), rel=1e-9)


def test_refined_breaks_equal_whole_solution(spark):
    rng = np.random.default_rng(8)
    values = np.concatenate([rng.lognormal(0, 1, 1500), np.repeat(2.5, 700)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    whole = classify.natural_breaks(df, "v", 5, max_bins=2000)
    assert classify.natural_breaks(df, "v", 5, max_bins=64) == whole


def test_breaks_of_few_or_no_values(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    assert classify.natural_breaks(df, "v", 5) == [1.0, 3.0]
    assert classify.natural_breaks(df.filter("v IS NULL"), "v", 5) == []


def test_classes(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 2.0, 3.0, 4.0, None, float("nan"))], "v double")
    found = [r["_class"] for r in classify.classify(df, "v", [0.0, 1.0, 2.0, 4.0], 3).collect()]
    assert found == [0, 1, 1, 2, 2, 3, None, None]
    one = classify.classify(df, "v", [2.0], 5).filter("v IS NOT NULL AND NOT isnan(v)")
    assert {r["_color"] for r in one.collect()} == {"#fde725"}
    none = classify.classify(df, "v", [], 5)
    assert {r["_color"] for r in none.collect()} == {colors.NAN_COLOR}


def test_colors(spark):
    assert colors.ramp("viridis", 6) == ["#440154", "#414487", "#2a788e", "#22a884", "#7ad151", "#fde725"]
    assert colors.to_hex("DarkGreen") == "#006400" and colors.to_hex("#abc") == "#aabbcc"
    with pytest.raises(ValueError):
        colors.to_hex("no colour")
    df = spark.range(3000).select(colors.hashed_color(F.col("id")).alias("c"))
    for (c,) in df.collect():
        r, g, b = (int(c[i : i + 2], 16) for i in (1, 3, 5))
        assert abs(r - g) + abs(r - b) > 50
    layers = classify.color_layers([f"layer{i}" for i in range(14)], {"layer3": "red"})
    assert layers["layer3"] == "#ff0000" and len(layers) == 14


def test_more_categories_than_colours(spark):
    df = spark.range(200).select(F.format_string("v%03d", F.col("id") % 25).alias("c"))
    mapping = classify.category_colors(df, "c", {"v003": "red"})
    assert len(mapping) == 1 + len(colors.PALETTE) - 1
    legend = classify.category_legend(df, "c", mapping)
    assert legend.count() == 25 and legend.filter("color IS NULL").count() == 0


@pytest.mark.parametrize("n", [1, 7, 50, 333, 1000])
def test_sample_is_exact(spark, n):
    df = spark.range(500).select(F.when(F.col("id") < 400, "big").otherwise("small").alias("layer"), "id")
    found = sample_per_layer(df, "layer", "id", n, seed=3)
    counts = {r["layer"]: r["count"] for r in found.groupBy("layer").count().collect()}
    assert counts == {"big": min(n, 400), "small": min(n, 100)}
    assert found.distinct().count() == found.count()


def test_sample_depends_on_seed(spark):
    df = spark.range(300).withColumn("layer", F.lit("a"))
    one, two = (set(sample_per_layer(df, "layer", "id", 30, s).toPandas()["id"]) for s in (1, 2))
    assert one != two and one == set(sample_per_layer(df, "layer", "id", 30, 1).toPandas()["id"])


def random_boxes(spark, seed, n, hot=0):
    rng = np.random.default_rng(seed)
    x, y = rng.uniform(0, 100, n), rng.uniform(0, 100, n)
    size = rng.choice([0.0, 0.5, 3.0, 60.0], n, p=[0.3, 0.4, 0.25, 0.05])
    x[:hot], y[:hot], size[:hot] = 50.0, 50.0, 0.5
    rows = [(i, float(a), float(b), float(a + s), float(b + s / 2)) for i, (a, b, s) in enumerate(zip(x, y, size, strict=True))]
    return spark.createDataFrame([*rows, (n, None, None, None, None)], "id int, minx double, miny double, maxx double, maxy double")


@pytest.mark.parametrize("hot_rows", [1 << 17, 10])
def test_bounds_join_equals_brute_force(spark, hot_rows):
    a, b = random_boxes(spark, 1, 300, hot=100), random_boxes(spark, 2, 200, hot=60)
    pairs = spatial.bounds_join(a, b, hot_rows=hot_rows).select("l.id", F.col("r.id").alias("other"))
    found = sorted(map(tuple, pairs.collect()))
    left, right = a.toPandas().dropna().to_numpy(), b.toPandas().dropna().to_numpy()
    expected = sorted(
        (int(p[0]), int(q[0]))
        for p in left for q in right
        if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2]
    )
    assert found == expected


def test_overlap_join_of_polygons_equals_brute_force(spark):
    """Triangles and points of mixed size against triangles, each pair measured on its own."""
    rng = np.random.default_rng(21)

    def shapes(n, seed):
        rows = []
        for i in range(n):
            x, y, s = *rng.uniform(0, 20, 2), rng.choice([0.5, 2.0, 9.0])
            corners = [(x, y), (x + s, y + rng.uniform(-s, s)), (x + rng.uniform(0, s), y + s)]
            ring = [{"x": float(a), "y": float(b)} for a, b in [*corners, corners[0]]]
            shape = {"kind": 1, "parts": [[ring[:1]]]} if i % 4 == 0 else {"kind": 3, "parts": [[ring]]}
            rows.append((i, shape))
        df = spark.createDataFrame(rows, "id int, g struct<kind:int,parts:array<array<array<struct<x:double,y:double>>>>>")
        return df.withColumns({**geo.bounds(F.col("g")), "geometry": to_wkb(F.col("g"))}).drop("g")

    a, b = shapes(80, 1), shapes(60, 2)
    pairs = spatial.overlap_join(a, b, hot_rows=20)
    found = sorted(map(tuple, pairs.select("l.id", F.col("r.id").alias("other")).collect()))
    every = a.select("id", "geometry").crossJoin(b.select(F.col("id").alias("other"), F.col("geometry").alias("h")))
    expected = every.filter(geometries_relate(F.col("geometry"), F.col("h"), 0.01)).select("id", "other")
    assert found == sorted(map(tuple, expected.collect())) and len(found) > 50


def test_join_with_an_empty_side(spark):
    a = random_boxes(spark, 1, 5)
    assert spatial.bounds_join(a, a.limit(0)).count() == 0


def test_join_stats_of_many_keys(spark):
    df = spark.range(500).withColumn("k", F.col("id") % 50)
    stats = df.groupBy("k").agg(F.max("id").alias("top"))
    small, salted = join_stats(df, stats, ["k"]), join_stats(df, stats, ["k"], max_rows=5)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, salted.select(small.columns).collect()))


def test_ranked_with_null_groups(spark):
    df = spark.createDataFrame([(None, 5), ("a", 1), ("a", 3), (None, 2)], "g string, v int")
    found = ranked(df, ["g"], [F.col("v")], F.floor(F.col("v") / 2), "n")
    assert sorted((r["v"], r["n"]) for r in found.collect()) == [(1, 1), (2, 1), (3, 2), (5, 2)]


def test_row_numbers_with_a_hot_value(spark):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 50).alias("v"))
    rows = prepare.row_numbers(df, "v", "n").orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1, 901))
    values = [-1 if r["v"] is None else r["v"] for r in rows]
    assert values == sorted(values)


def test_median_rule(spark):
    groups = {"low": [1, 2, 30], "high": [11, 12, 1], "tie": [9, 12], "below": [5, 12], "null": [50, None]}
    rows = [(g, float(v) if v is not None else None) for g, vs in groups.items() for v in vs]
    found = dict(prepare.large_areas(spark.createDataFrame(rows, "f string, area double"), ["f"]).collect())
    assert found == {"low": False, "high": True, "tie": True, "below": False, "null": False}


def test_prepare_in_metres(spark):
    df = spark.createDataFrame([(1, 262000.0, 6649000.0)], "id int, x double, y double")
    box = geo.box(F.col("x"), F.col("y"), F.col("x") + 100.5, F.col("y") + 100)
    source = df.select("id", F.lit("/a/b.parquet").alias("__file_path"), F.array(F.lit(1)).alias("tags"), to_wkb(box).alias("geometry"))
    row = prepare.prepare(source, crs=25833).first()
    assert row["area"] == 10050.0 and 10 < row["minx"] < row["maxx"] < 11 and 59 < row["miny"] < 60
    assert "id" not in row and "tags" not in row


def test_layer_columns(spark):
    df = spark.sql("SELECT 1 AS b, array(1) AS tags, '0.0' AS _unique_id, 'p' AS __file_path, 1D AS minx, binary('x') AS geometry, 2 AS a")
    assert prepare.colour_columns(df) == ["a", "area", "b"]
    assert prepare.project_for_drawing(df, "a").columns == ["geometry", "_unique_id", "a"]
    assert prepare.project_for_drawing(df, "zz").columns == ["geometry", "_unique_id"]
    frame = prepare.with_frame_ids(spark.range(3).withColumnRenamed("id", "v"), 4, "v")
    assert sorted(r["_unique_id"] for r in frame.collect()) == ["4.0", "4.1", "4.2"]
    points = spark.sql("SELECT 5D AS area")
    assert profile.buffer_hint(points, 8).first()["buffer_hint"] and not profile.buffer_hint(points, 12).first()["buffer_hint"]


def test_union_types(spark):
    a = spark.sql("SELECT 1 AS a, 'x' AS b, 1.5D AS c, DATE '2020-01-01' AS d, true AS e")
    b = spark.sql("SELECT 2.5D AS a, 3 AS b, 4 AS c, TIMESTAMP '2020-01-02 03:00:00' AS d, 7 AS e, NULL AS f")
    both = union.stack([a, b])
    assert dict(both.dtypes) == {"a": "double", "b": "string", "c": "double", "d": "timestamp", "e": "int", "f": "void"}
    assert sorted(r["b"] for r in both.collect()) == ["3", "x"]
    with pytest.raises(ValueError):
        union.stack([spark.sql("SELECT array(1) AS a"), spark.sql("SELECT 1 AS a")])


def layer_set(spark, queries):
    df = spark.createDataFrame([("0.0", 1, "a"), ("0.1", 2, "b"), ("0.2", 3, None)], "_unique_id string, k int, name string")
    return LayerSet([Layer(p, df, q) for p, q in queries.items()])


def test_layer_queries(spark):
    layers = layer_set(spark, {
        "/x/one.parquet": "SELECT df.*, two.name AS other FROM df JOIN two USING (k)",
        "/x/two.parquet": "k > 1",
        "/y/three.parquet": lambda df, others: df.join(others["one"], "k", "left_anti"),
        "/y/{odd}.parquet": "SELECT * FROM df WHERE name = '{b}'",
    })
    assert layers.table("/x/one.parquet").count() == 2
    assert [r["k"] for r in layers.table("/y/three.parquet").collect()] == [1]
    assert layers.table("/y/{odd}.parquet").count() == 0
    assert layers.union().count() == 2 + 2 + 1


def test_columns_named_like_layers_are_no_cycle(spark):
    df = spark.createDataFrame([("0.0", 1, 2)], "_unique_id string, one int, two int")
    layers = LayerSet([
        Layer("/x/one.parquet", df, "SELECT df.one, two.two FROM df, two WHERE df.two = two.two"),
        Layer("/x/two.parquet", df, "SELECT two, one FROM df WHERE one = 1"),
    ])
    assert layers.table("/x/one.parquet").count() == 1


def test_breaks_of_a_written_column(spark):
    df = spark.range(500).select((F.col("id") % 97).cast("double").alias("v"))
    assert classify.natural_breaks(df, "v", 4, write_values=True) == classify.natural_breaks(df, "v", 4)


def test_full_path_and_parent_names(spark):
    layers = layer_set(spark, {"/x/one.parquet": "SELECT df.k FROM df JOIN `y/one` USING (k)", "/y/one.parquet": None})
    assert layers.names == {"/x/one.parquet": "x/one", "/y/one.parquet": "y/one"}
    assert layers.table("/x/one.parquet").count() == 3
    layers = layer_set(spark, {"/x/a.parquet": "SELECT df.k FROM df JOIN `/y/b.parquet` USING (k)", "/y/b.parquet": "k = 1"})
    assert layers.table("/x/a.parquet").count() == 1
    assert short_names(["/a/v1.2.parquet", "plain"]) == {"/a/v1.2.parquet": "v1.2", "plain": "plain"}


def test_bad_queries(spark):
    circle = layer_set(spark, {"/x/one.parquet": "SELECT df.* FROM df JOIN two USING (k)", "/x/two.parquet": "SELECT df.* FROM df JOIN one USING (k)"})
    with pytest.raises(filters.QueryError, match="Circular"):
        circle.table("/x/one.parquet")
    assert "Circular" in circle.message("/x/two.parquet")
    df = circle.layers["/x/one.parquet"].df
    with pytest.raises(filters.QueryError, match="called df"):
        run_sql(df, "SELECT * FROM something")
    for bad in ("no_column > 1", "SELECT nothing FROM df", lambda d: d.drop("_unique_id"), lambda d: 5, 7):
        kept, message = filters.try_query(df, bad)
        assert kept is df and message
    kept, message = filters.try_query(df, "k > 2")
    assert kept.count() == 1 and message is None


def test_sql_hidden_columns(spark):
    df = spark.createDataFrame([("0.0", 1, 2.0, "f")], "_unique_id string, k int, minx double, __file_path string")
    assert set(run_sql(df, "SELECT _unique_id, k FROM df").columns) == {"_unique_id", "k", "minx", "__file_path"}
    assert set(run_sql(df, "select k from df", keep_ids=True).columns) == {"_unique_id", "k", "minx", "__file_path"}
    assert run_sql(df, "WITH t AS (SELECT k FROM df) SELECT * FROM t;").columns == ["k"]


def test_joined_layers_come_without_added_columns(spark):
    df = spark.createDataFrame([("0.0", 1, 5.0)], "_unique_id string, k int, area double")
    other = {"b": spark.createDataFrame([("1.0", 1, 7.0, "x")], "_unique_id string, k int, area double, name string")}
    row = run_sql(df, "SELECT _unique_id, name, area / 10 AS tenth FROM df JOIN b USING (k)", other).first()
    assert row.asDict() == {"_unique_id": "0.0", "name": "x", "tenth": 0.5}
    row = run_sql(df, "SELECT df.area, b.area AS other FROM df JOIN b USING (k)", other).first()
    assert tuple(row) == (5.0, 7.0)


def test_null_safe_text(spark):
    df = spark.createDataFrame([("air",), ("bus",), (None,)], "vehicle string")
    assert filters.apply_query(df, "vehicle != 'air'").count() == 1
    assert filters.apply_query(df, 'vehicle != "air"', null_safe=True).count() == 2
    assert filters.apply_query(df, "   ").count() == 3


def test_viewport_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (1.1, 0.0, 2.0, 1.0), (None,) * 4], "minx double, miny double, maxx double, maxy double")
    assert filters.filter_bounds(df, [[0, 1.0], [5, 1.05]]).count() == 2
    assert Bounds.parse([[1, 2], [3, 4]]) == Bounds(2, 1, 4, 3)


def test_search_terms(spark):
    df = spark.createDataFrame([("Alpha beta",), ("alpha",), (None,)], "t string")
    count = lambda *a: df.filter(match_terms(F.col("t"), *a)).count()
    assert (count("Alpha | gamma, beta"), count("alpha", False), count("alpha"), count(" , "), count("|")) == (1, 2, 1, 3, 0)
    assert spark.range(1).select(stem(F.lit("/a/b.c/d.tar.gz")), stem(F.lit("/a/.hidden")), stem(F.lit("x"))).first()[:] == ("d.tar", ".hidden", "x")


def test_suggestions_and_budget(spark):
    df = spark.createDataFrame([("a", 1.0, 5, 2.0), ("a", 2.0, 5, 4.0), ("o'b", None, 5, 9.0)], "name string, v double, same int, area double")
    rows = {r["column"]: r for r in profile.suggest_queries(df).collect()}
    assert rows["area"]["query"] == "SELECT area, name, same, v FROM df WHERE area > 5.0 ORDER BY area DESC"
    assert rows["name"]["query"] == "SELECT name, area, same, v FROM df WHERE name = 'a'"
    assert rows["v"]["n_rows"] == 1 and "same" not in rows
    for r in rows.values():
        assert run_sql(df, r["query"]).count() == r["n_rows"]
    assert profile.exceeds_table_budget(df, budget=11) and not profile.exceeds_table_budget(df, budget=12)
    assert not profile.exceeds_table_budget(df, "select * from df LIMIT 5", budget=1)


def test_join_keys(spark):
    layers = {
        "a": spark.sql("SELECT 1 AS k, 'x' AS s, 1D AS f"),
        "b": spark.sql("SELECT 1L AS k, 2 AS s, 1D AS f, 'more' AS extra"),
        "c": spark.sql("SELECT 9 AS z"),
        "d": spark.sql("SELECT 5 AS k, 0 AS other"),
    }
    found = {(r["left"], r["right"], r["column"]): r for r in profile.join_keys(layers).collect()}
    assert set(found) == {("a", "b", "k")}
    row = found["a", "b", "k"]
    assert (row["n_common_keys"], row["n_joined"]) == (1, 1)
    assert run_sql(layers["a"], row["query"], layers).first()["extra"] == "more"
    assert profile.join_keys({"a": layers["a"], "c": layers["c"]}).count() == 0


def pixel_table(spark, rows):
    return spark.createDataFrame(rows, "raster_id int, band string, time int, y double, x double, value double")


def test_raster_errors(spark):
    thin = pixel_table(spark, [(1, "a", 0, 0.0, 0.0, 1.0), (1, "a", 0, 0.0, 1.0, 1.0)])
    with pytest.raises(Exception, match="single row or column"):
        raster.raster_bounds(thin).collect()
    skewed = pixel_table(spark, [(1, "a", 0, y, x, 1.0) for y in (0.0, 2.0) for x in (0.0, 1.0)])
    with pytest.raises(Exception, match="resolution differ"):
        raster.raster_bounds(skewed).collect()
    with pytest.raises(raster.RasterError):
        raster.rgb(thin, ["a", "b"])
    with pytest.raises(raster.RasterError):
        raster.transform(thin, lambda p: p.drop("x"))


def test_all_nan_image_and_bands(spark):
    nan = float("nan")
    df = pixel_table(spark, [(1, "a", 0, 0.0, 0.0, nan), (2, "a", 0, 0.0, 0.0, nan), (2, "a", 0, 0.0, 1.0, 3.0)])
    found = sorted((r["raster_id"], str(r["value"])) for r in raster.fill_nan(df).collect())
    assert found == [(1, "nan"), (2, "3.0"), (2, "3.0")]
    assert raster.choose_bands(["z"]) == ["z"] and raster.choose_bands(["B2", "B3", "B4", "B8"]) == ["B4", "B3", "B2"]
    assert raster.choose_bands(["a", "b", "c"]) == ["a", "b", "c"] and raster.choose_bands(["a", "b"]) == ["a"]


def test_clip_in_raster_crs(spark):
    df = pixel_table(spark, [(1, "a", 0, 0.0, x, 1.0) for x in (0.0, 50_000.0, 150_000.0)])
    assert raster.clip(df, (0.1, -1, 1.0, 1), crs=3857).count() == 1


def test_view_round_trip(spark):
    spec = ViewSpec({"/a/x.parquet": None, "/a/y.parquet": "v > 1"}, column="v", k=3, hidden=["/a/x.parquet"])
    assert ViewSpec.from_json(spec.to_json()) == spec and "cmap" not in spec.to_json()
    df = spark.range(40).select(F.concat(F.lit("0."), "id").alias("_unique_id"), (F.col("id") % 7).cast("double").alias("v"), F.lit(None).cast("double").alias("minx"))
    view = build_view(spec, lambda path: df)
    assert view.legend.count() == 4
    assert {r["layer"] for r in view.features.collect()} == {"y"} and view.features.count() == view.union.count()


def test_row_numbers_of_large_integers_dates_decimals_and_hot_values(spark):
    from geoquarry.operators.prepare import row_numbers

    df = spark.range(3000).selectExpr(
        "id + (1L << 60) AS long", "date_add(DATE '2000-01-01', CAST(id AS INT)) AS day",
        "CAST(id / 7 AS DECIMAL(20,3)) AS price", "IF(id % 2 = 0, (1L << 60) + 5, (1L << 60) + id) AS hot",
    )
    for order in ("long", "day", "price", "hot"):
        rows = row_numbers(df, order, "n").select(order, "n").collect()
        assert sorted(r["n"] for r in rows) == list(range(1, 3001))
        by_number = [r[order] for r in sorted(rows, key=lambda r: r["n"])]
        assert by_number == sorted(by_number)


def test_first_row_of_a_key_without_orders(spark):
    from geoquarry.operators.union import first_per_key, stack

    df = spark.createDataFrame([("a", None, 1), ("b", 2, 2), ("b", None, 3)], "k string, o int, v int")
    assert {tuple(r) for r in first_per_key(df, "k", F.col("o")).collect()} == {("a", None, 1), ("b", 2, 2)}
    with pytest.raises(ValueError, match="capitals"):
        stack([df, df.withColumnRenamed("k", "K")])


def test_null_safe_text_leaves_literals_alone(spark):
    from geoquarry.operators.filters import text_predicate

    df = spark.createDataFrame([("size != 5", 1, None), ("x", None, 2), ("y", 5, 5)], "txt string, a int, b int")
    def found(text):
        return [r["txt"] for r in text_predicate(df, text, null_safe=True).collect()]
    assert found("txt = 'size != 5'") == ["size != 5"]
    assert found("5 != a") == ["size != 5", "x"]
    assert found("a <> b") == ["size != 5", "x"]
    assert found("txt != 'it''s != 3'") == ["size != 5", "x", "y"]


def test_ids_of_select_lists_with_products(spark):
    from geoquarry.operators.layer_sql import run_sql

    df = spark.createDataFrame([("0.1", 3, "2020-01-02")], "_unique_id string, a int, d string")
    found = run_sql(df, "SELECT a * 2 AS b, extract(YEAR FROM CAST(d AS DATE)) AS y FROM df", keep_ids=True)
    assert set(found.columns) == {"_unique_id", "b", "y"} and found.first()["b"] == 6
    assert run_sql(df, "SELECT df.* FROM df", keep_ids=True).columns == df.columns


def test_suggestions_run_for_any_name(spark):
    from geoquarry.operators.profile import suggest_queries

    df = spark.createDataFrame([(1, 2.5, "a"), (2, 3.5, "a"), (9, 1.0, "b`")], "`kjøretøy` int, `min verdi` double, slag string")
    for row in suggest_queries(df).collect():
        assert spark.sql(row["query"].replace("FROM df", "FROM {df}"), df=df).count() == row["n_rows"]


def test_infinite_values_and_boxes(spark):
    from geoquarry.operators.classify import natural_breaks
    from geoquarry.operators.spatial import bounds_join

    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 10, 11, 50, "inf", "-inf", "nan")], "v double")
    breaks = natural_breaks(df, "v", 3)
    assert breaks[0] == 1 and breaks[-1] == 50
    boxes = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (0.0, 0.0, float("inf"), 1.0)], "minx double, miny double, maxx double, maxy double")
    with_map = boxes.withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    assert bounds_join(with_map.union(with_map), boxes.union(boxes), hot_rows=1).count() == 4


def test_sample_with_null_and_equal_ids(spark):
    from geoquarry.operators.sample import sample_per_layer

    df = spark.range(2000).selectExpr("'one' AS layer", "CAST(NULL AS STRING) AS key", "id")
    some = [r["id"] for r in sample_per_layer(df, "layer", "key", 200, 3).collect()]
    assert len(set(some)) == 200 and 700 < sum(some) / 200 < 1300
    assert sample_per_layer(df, "layer", "key", 5000, 3).count() == 2000
    equal = df.withColumn("key", F.lit("k"))
    assert sample_per_layer(equal, "layer", "key", 200, 3).count() == 200
    text = sample_per_layer(df, "layer", "key", 200, 3)._jdf.queryExecution().toString()
    assert "NestedLoop" not in text
