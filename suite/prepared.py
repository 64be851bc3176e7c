"""Geometry columns, ids and names of prepared layers."""

from pyspark.sql import functions as F

from geoquarry.functions import geometry as geo
from geoquarry.functions.crs import reproject, reproject_xy
from geoquarry.functions.text import with_unique_stem
from geoquarry.functions.wkb import from_wkb, to_wkb
from geoquarry.operators import prepare as op
from geoquarry.operators.relational import spread
from geoquarry.plans.layers import layer_of_path
from geoquarry.sources.inventory import list_files
from geoquarry.sources.readers import read_parquet

from .base import VIEWPORT, layer, point_layer, query, table, with_layers

def box():
    return geo.box(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")])


@query("p1_wkb_roundtrip", f"{with_layers('boxes')} SELECT s_suppkey, minx, miny, maxx, maxy, CAST(93 AS BIGINT) AS wkb_bytes FROM boxes")
def p1_wkb_roundtrip(spark, sf_dir):
    df = layer(spark, sf_dir, "boxes").select("s_suppkey", to_wkb(box()).alias("geometry"))
    back = df.withColumn("g", from_wkb(F.col("geometry")))
    bounds = [c.alias(k) for k, c in geo.bounds(F.col("g")).items()]
    return back.select("s_suppkey", *bounds, F.length("geometry").cast("long").alias("wkb_bytes"))


@query(
    "p2_area",
    f"""{with_layers('metric_boxes')}, sized AS (
SELECT *, (maxx - minx) * (maxy - miny) AS a FROM metric_boxes),
marked AS (SELECT *, median(a) OVER (PARTITION BY __file_path) AS m FROM sized)
SELECT s_suppkey, __file_path, CASE WHEN m > 10 THEN trunc(a) ELSE a END AS area FROM marked""",
)
def p2_area(spark, sf_dir):
    df = layer(spark, sf_dir, "metric_boxes").withColumn("geometry", to_wkb(box()))
    return op.prepare(df.drop("minx", "miny", "maxx", "maxy")).select("s_suppkey", "__file_path", "area")


@query("p3_bounds", f"{with_layers('boxes')} SELECT s_suppkey, minx, miny, maxx, maxy FROM boxes")
def p3_bounds(spark, sf_dir):
    df = layer(spark, sf_dir, "boxes").select("s_suppkey", "__file_path", to_wkb(box()).alias("geometry"))
    return op.prepare(df, truncate=False).select("s_suppkey", "minx", "miny", "maxx", "maxy")


@query(
    "p4_web_mercator",
    f"""{with_layers('points')} SELECT c_custkey, round(6378137 * radians(x), 3) AS mx,
round(6378137 * ln(tan(pi() / 4 + radians(y) / 2)), 3) AS my FROM points""",
)
def p4_web_mercator(spark, sf_dir):
    df = reproject_xy(layer(spark, sf_dir, "points"), "x", "y", 4326, 3857)
    return df.select("c_custkey", F.round("x", 3).alias("mx"), F.round("y", 3).alias("my"))


P4_BACK = f"{with_layers('points')} SELECT c_custkey, round(x, 6) AS x, round(y, 6) AS y FROM points"


def _there_and_back(spark, sf_dir, crs):
    df = layer(spark, sf_dir, "points")
    back = reproject_xy(reproject_xy(df, "x", "y", 4326, crs), "x", "y", crs, 4326)
    return back.select("c_custkey", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("p4_utm_roundtrip", P4_BACK)
def p4_utm_roundtrip(spark, sf_dir):
    return _there_and_back(spark, sf_dir, 25833)


@query("p4_laea_roundtrip", P4_BACK)
def p4_laea_roundtrip(spark, sf_dir):
    return _there_and_back(spark, sf_dir, 3035)


@query(
    "p4_reproject_geometry",
    f"""{with_layers('boxes')} SELECT s_suppkey, round(6378137 * radians(minx), 2) AS minx, round(6378137 * radians(maxx), 2) AS maxx,
round(6378137 * ln(tan(pi() / 4 + radians(miny) / 2)), 2) AS miny,
round(6378137 * ln(tan(pi() / 4 + radians(maxy) / 2)), 2) AS maxy FROM boxes""",
)
def p4_reproject_geometry(spark, sf_dir):
    df = layer(spark, sf_dir, "boxes").select("s_suppkey", reproject(box(), 4326, 3857).alias("g"))
    b = geo.bounds(F.col("g"))
    return df.select("s_suppkey", *[F.round(b[c], 2).alias(c) for c in b])


@query(
    "s12_frame_ids",
    "SELECT o_orderkey, concat('5.', CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS VARCHAR)) AS _unique_id FROM orders",
)
def s12_frame_ids(spark, sf_dir):
    """Ids of a table without a file, numbered along keys beyond what doubles tell apart."""
    large = F.col("o_orderkey") + F.lit(1 << 60)
    df = table(spark, sf_dir, "orders").select("o_orderkey", large.alias("key"))
    return op.with_frame_ids(df, 5, "key").select("o_orderkey", "_unique_id")


@query(
    "p11_colour_columns",
    "SELECT count(*) AS n_rows, 'area,c_custkey,few,segment,v' AS columns FROM customer",
)
def p11_colour_columns(spark, sf_dir):
    df = op.without_geometry(layer(spark, sf_dir, "dirty").drop("c_mktsegment"))
    names = ",".join(op.colour_columns(df))
    return df.agg(F.count("*").alias("n_rows")).withColumn("columns", F.lit(names))


@query("p5_drop_nested", "SELECT vec_id, label FROM embeddings")
def p5_drop_nested(spark, sf_dir):
    return op.drop_nested(table(spark, sf_dir, "embeddings"))


@query("p6_unique_id_file", "SELECT c_custkey, concat('0.', CAST(c_custkey AS VARCHAR)) AS _unique_id FROM customer")
def p6_unique_id_file(spark, sf_dir):
    path = f"{sf_dir}/customer.parquet"
    df = op.with_unique_id(read_parquet(spark, path), list_files(spark, path))
    return df.select("c_custkey", "_unique_id")


@query(
    "p6_unique_id",
    f"""{with_layers('metric_boxes')} SELECT s_suppkey, concat(CAST(dense_rank() OVER (ORDER BY __file_path) - 1 AS VARCHAR), '.',
CAST(row_number() OVER (PARTITION BY __file_path ORDER BY s_suppkey) - 1 AS VARCHAR)) AS _unique_id FROM metric_boxes""",
)
def p6_unique_id(spark, sf_dir):
    df = op.row_numbers(layer(spark, sf_dir, "metric_boxes"), "s_suppkey", "n", by=["__file_path"])
    numbered = op.with_unique_id(df.withColumn("__row_index", F.col("n") - 1))
    return numbered.select("s_suppkey", "_unique_id")


@query(
    "p8_non_geo",
    "SELECT event_id, event_type, CAST(NULL AS DOUBLE) AS area, CAST(NULL AS DOUBLE) AS minx FROM events",
)
def p8_non_geo(spark, sf_dir):
    df = op.without_geometry(table(spark, sf_dir, "events"))
    return df.select("event_id", "event_type", "area", "minx")


@query(
    "p9_split_index",
    f"""{with_layers('points')} SELECT c_custkey, concat('part-0 ',
CAST(row_number() OVER (PARTITION BY __file_path ORDER BY c_custkey) AS VARCHAR)) AS split_index
FROM points WHERE c_acctbal > 0""",
)
def p9_split_index(spark, sf_dir):
    df = layer(spark, sf_dir, "points").filter("c_acctbal > 0")
    return op.with_split_index(df, row="c_custkey").select("c_custkey", "split_index")


@query(
    "p12_unique_stem",
    f"""{with_layers('listing')}, sets AS (SELECT name, regexp_replace(name, '/part-[^/]*$', '') AS path FROM listing),
stems AS (SELECT *, regexp_extract(path, '([^/]*)\\.[^./]+$', 1) AS stem FROM sets)
SELECT name, CASE WHEN count(*) OVER (PARTITION BY stem) > 1
THEN concat(regexp_extract(path, '([^/]+)/[^/]+$', 1), '/', stem) ELSE stem END AS label FROM stems""",
)
def p12_unique_stem(spark, sf_dir):
    df = layer(spark, sf_dir, "listing").select("name", F.regexp_replace("name", "/part-[^/]*$", "").alias("path"))
    return with_unique_stem(df, "path", "label").select("name", "label")


@query(
    "p13_layer_of_file",
    f"""{with_layers('listing')} SELECT name, CASE WHEN starts_with(name, '/data/year=2020/') THEN 'year=2020'
WHEN starts_with(name, '/data/year=2021/set1.parquet/') THEN 'set1' END AS layer FROM listing""",
)
def p13_layer_of_file(spark, sf_dir):
    df = layer(spark, sf_dir, "listing").withColumn("__file_path", F.col("name"))
    return layer_of_path(df, ["/data/year=2020", "/data/year=2021/set1.parquet"]).select("name", "layer")


@query(
    "p15_project",
    f"{with_layers('points')} SELECT _unique_id, c_mktsegment FROM points",
)
def p15_project(spark, sf_dir):
    df = point_layer(spark, sf_dir).withColumn("geometry", F.lit(None).cast("binary"))
    return op.project_for_drawing(df, "c_mktsegment").drop("geometry")


@query(
    "w1_row_number",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders",
)
def w1_row_number(spark, sf_dir):
    df = op.row_numbers(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "n")
    return df.withColumn("n", F.col("n") - 1)


@query(
    "w2_running_count",
    "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS n FROM orders",
)
def w2_running_count(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return op.row_numbers(df, "o_orderkey", "n", by=["o_orderpriority"]).select("o_orderkey", "n")


@query(
    "x5_box_area",
    f"{with_layers('boxes')} SELECT s_suppkey, round((maxx - minx) * (maxy - miny), 9) AS area, "
    "round(2 * (maxx - minx) + 2 * (maxy - miny), 9) AS outline FROM boxes",
)
def x5_box_area(spark, sf_dir):
    df = layer(spark, sf_dir, "boxes").select("s_suppkey", box().alias("g"))
    lines = geo.to_lines(F.col("g"))
    return df.select(
        "s_suppkey",
        F.round(geo.area(F.col("g")), 9).alias("area"),
        F.round(geo.length(lines), 9).alias("outline"),
    )


@query(
    "x6_box_relations",
    f"""{with_layers('boxes')} SELECT s_suppkey, minx <= 14 AND maxx >= 9 AND miny <= 62 AND maxy >= 59 AS meets,
minx >= 9 AND maxx <= 14 AND miny >= 59 AND maxy <= 62 AS is_within, minx <= 9 AND maxx >= 14 AND miny <= 59 AND maxy >= 62 AS covers,
least(maxx, 14) > greatest(minx, 9) AND least(maxy, 62) > greatest(miny, 59) AND NOT (minx >= 9 AND maxx <= 14 AND miny >= 59 AND maxy <= 62)
AND NOT (minx <= 9 AND maxx >= 14 AND miny <= 59 AND maxy >= 62) AS overlaps,
CASE WHEN minx <= 14 AND maxx >= 9 AND miny <= 62 AND maxy >= 59 THEN greatest(minx, 9) END AS shared_minx FROM boxes""",
)
def x6_box_relations(spark, sf_dir):
    sides = ("minx", "miny", "maxx", "maxy")
    a = {c: F.col(c) for c in sides}
    b = {c: F.lit(v) for c, v in zip(sides, VIEWPORT, strict=True)}
    return layer(spark, sf_dir, "boxes").select(
        "s_suppkey",
        geo.bounds_intersect(a, b).alias("meets"),
        geo.box_within(a, b).alias("is_within"),
        geo.box_covers(a, b).alias("covers"),
        geo.box_overlaps(a, b).alias("overlaps"),
        geo.box_intersection(a, b)["minx"].alias("shared_minx"),
    )


@query(
    "x7_centroid",
    f"{with_layers('boxes')} SELECT s_suppkey, round((minx + maxx) / 2, 8) AS cx, round((miny + maxy) / 2, 8) AS cy FROM boxes",
)
def x7_centroid(spark, sf_dir):
    df = layer(spark, sf_dir, "boxes").select("s_suppkey", geo.centroid(box()).alias("c"))
    return df.select("s_suppkey", F.round("c.x", 8).alias("cx"), F.round("c.y", 8).alias("cy"))


@query(
    "x8_buffer",
    f"{with_layers('points')} SELECT c_custkey, round(64 * 0.5 * 500 * 500 * sin(2 * pi() / 64), 0) AS area_m2, CAST(65 AS BIGINT) AS n_points FROM points",
)
def x8_buffer(spark, sf_dir):
    df = spread(layer(spark, sf_dir, "points"))
    circles = df.select("c_custkey", geo.buffer_points(geo.point(F.col("x"), F.col("y")), 500.0).alias("g"))
    metres = geo.area(reproject(F.col("g"), 4326, 3035))
    return circles.select(
        "c_custkey",
        F.round(metres, 0).alias("area_m2"),
        F.size(geo.points_of(F.col("g"))).cast("long").alias("n_points"),
    )
