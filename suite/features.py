"""Zoom, GeoJSON, attribute rows and whole views."""

from pyspark.sql import functions as F

from geoquarry.functions import geometry as geo
from geoquarry.functions.wkb import to_wkb
from geoquarry.operators import features as op
from geoquarry.plans.view import ViewSpec, build_view

from .base import VIEWPORT, layer, point_layer, query, with_layers

ZOOM = """CASE WHEN maxx = minx AND maxy = miny THEN 16 ELSE round(log2(40075016.686 * cos(radians((miny + maxy) / 2)) /
(greatest(abs(maxx - minx) * (40075016.686 / 360) * cos(radians((miny + maxy) / 2)) / {w}, abs(maxy - miny) * (40075016.686 / 360) / {h}) * 256)), 2) END"""


@query("x1_zoom", f"{with_layers('boxes')} SELECT s_suppkey, {ZOOM.format(w=1000, h=800)} AS zoom FROM boxes")
def x1_zoom(spark, sf_dir):
    b = {c: F.col(c) for c in ("minx", "miny", "maxx", "maxy")}
    return layer(spark, sf_dir, "boxes").select("s_suppkey", geo.zoom_for_bounds(b, 1000, 800).alias("zoom"))


@query(
    "x2_feature_view",
    f"""{with_layers('boxes')} SELECT _unique_id, (minx + maxx) / 2 AS center_x, (miny + maxy) / 2 AS center_y, minx, miny, maxx, maxy,
CAST(trunc(greatest(least({ZOOM.format(w=700, h=560)}, 8), 6)) AS INTEGER) AS zoom FROM boxes""",
)
def x2_feature_view(spark, sf_dir):
    return op.feature_view(layer(spark, sf_dir, "boxes"), 1000, 800, 6, 8)


@query(
    "k1_features",
    f"""{with_layers('points')} SELECT concat('{{"id":"', CAST(c_custkey AS VARCHAR), '","type":"Feature","properties":{{"_unique_id":"', _unique_id,
'"}},"geometry":{{"type":"Point","coordinates":[', CAST(x AS VARCHAR), ',', CAST(y AS VARCHAR), ']}}}}') AS feature FROM points""",
)
def k1_features(spark, sf_dir):
    df = layer(spark, sf_dir, "points").withColumn("geometry", to_wkb(geo.point(F.col("x"), F.col("y"))))
    return op.geojson_features(df, F.col("c_custkey"))


@query(
    "k2_attributes",
    f"{with_layers('points')} SELECT _unique_id AS id, c_custkey, c_mktsegment, c_acctbal, c_nationkey, x, y, CAST(0 AS DOUBLE) AS area FROM points",
)
def k2_attributes(spark, sf_dir):
    return op.attribute_table(point_layer(spark, sf_dir))


def saved_view(spark, sf_dir):
    """Points and boxes in a viewport, filtered, coloured by segment, sampled."""
    points = "/layers/customer_points.parquet"
    boxes = "/layers/supplier_boxes.parquet"
    spec = ViewSpec(
        layers={points: "c_mktsegment != 'FURNITURE'", boxes: "SELECT * FROM df WHERE s_acctbal > 0"},
        column="c_mktsegment",
        color_dict={"BUILDING": "darkgreen", "MACHINERY": "navy"},
        bounds=list(VIEWPORT),
        max_rows=40,
    )
    spec = ViewSpec.from_json(spec.to_json())
    tables = {points: point_layer(spark, sf_dir), boxes: layer(spark, sf_dir, "boxes")}
    return build_view(spec, tables)


VIEW_SQL = f"""{with_layers('points', 'boxes')}, visible AS (
SELECT 'customer_points' AS layer, _unique_id, c_mktsegment FROM points WHERE x <= 14 AND x >= 9 AND y <= 62 AND y >= 59 AND c_mktsegment <> 'FURNITURE'
UNION ALL SELECT 'supplier_boxes', _unique_id, NULL FROM boxes WHERE minx <= 14 AND maxx >= 9 AND miny <= 62 AND maxy >= 59 AND s_acctbal > 0),
fresh AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) AS i, (SELECT count(DISTINCT c_mktsegment) FROM visible WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) AS taken
FROM (SELECT DISTINCT c_mktsegment FROM visible WHERE c_mktsegment IS NOT NULL AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) AS d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY md5(concat('0|', _unique_id)), _unique_id) AS r FROM visible)
SELECT layer, _unique_id, CASE WHEN ranked.c_mktsegment IS NULL THEN '#969696' WHEN ranked.c_mktsegment = 'BUILDING' THEN '#006400'
WHEN ranked.c_mktsegment = 'MACHINERY' THEN '#000080' ELSE [palette][taken + i] END AS color
FROM ranked LEFT JOIN fresh ON ranked.c_mktsegment = fresh.c_mktsegment WHERE r <= 40"""


def _palette() -> str:
    from geoquarry.functions.colors import PALETTE

    return "[" + ", ".join(f"'{c}'" for c in PALETTE) + "]"


@query("k3_saved_view", VIEW_SQL.replace("[palette]", _palette()))
def k3_saved_view(spark, sf_dir):
    return saved_view(spark, sf_dir).features.select("layer", "_unique_id", F.col("_color").alias("color"))


@query(
    "k3_rows_per_layer",
    f"""{with_layers('points', 'boxes')} SELECT 'customer_points' AS layer, count(*) AS n_rows FROM points WHERE x <= 14 AND x >= 9 AND y <= 62 AND y >= 59 AND c_mktsegment <> 'FURNITURE'
UNION ALL SELECT 'supplier_boxes', count(*) FROM boxes WHERE minx <= 14 AND maxx >= 9 AND miny <= 62 AND maxy >= 59 AND s_acctbal > 0""",
)
def k3_rows_per_layer(spark, sf_dir):
    view = saved_view(spark, sf_dir)
    return view.union.groupBy("layer").agg(F.count(F.lit(1)).alias("n_rows"))
