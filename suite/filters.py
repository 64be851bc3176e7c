"""Viewport, SQL, expression, text and function filters."""

from pyspark.sql import functions as F

from geoquarry.functions import geometry as geo
from geoquarry.model import GEOM, is_missing
from geoquarry.operators import filters as op
from geoquarry.operators.layer_sql import run_sql
from geoquarry.operators.prepare import with_geometry

from .base import INSIDE, VIEWPORT, layer, point_layer, query, with_layers

POINTS = with_layers("points")


@query(
    "f1_viewport",
    f"{POINTS} SELECT _unique_id, c_custkey, x, y FROM points "
    "WHERE x <= 14 AND x >= 9 AND y <= 62 AND y >= 59",
)
def f1_viewport(spark, sf_dir):
    found = op.filter_bounds(point_layer(spark, sf_dir), VIEWPORT)
    return found.select("_unique_id", "c_custkey", "x", "y")


@query("f8_empty_query", f"{POINTS} SELECT * FROM points")
def f8_empty_query(spark, sf_dir):
    """Queries without any text leave a layer as it is, one after the other."""
    found = layer(spark, sf_dir, "points")
    for nothing in (None, "", "  "):
        found = op.apply_query(found, nothing)
    return found


@query("f8_failed_query", f"{POINTS} SELECT _unique_id, TRUE AS has_message FROM points")
def f8_failed_query(spark, sf_dir):
    """A query that names a column the layer lacks leaves the layer as it is."""
    found, message = op.try_query(layer(spark, sf_dir, "points"), "no_such_column > 1")
    return found.select("_unique_id", F.lit("no_such_column" in message).alias("has_message"))


@query("f1_viewport_non_geo", f"{with_layers('nongeo')} SELECT _unique_id, event_type, value FROM nongeo")
def f1_viewport_non_geo(spark, sf_dir):
    found = op.filter_bounds(layer(spark, sf_dir, "nongeo"), VIEWPORT)
    return found.select("_unique_id", "event_type", "value")


F2_SQL = "SELECT _unique_id, c_acctbal / 1000 AS thousands FROM df WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'"


@query(
    "f2_sql_filter",
    f"{POINTS} SELECT _unique_id, __file_path, c_acctbal / 1000 AS thousands, x AS minx, y AS maxy FROM points "
    "WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'",
)
def f2_sql_filter(spark, sf_dir):
    df = op.apply_query(point_layer(spark, sf_dir), F2_SQL)
    return df.select("_unique_id", "__file_path", "thousands", "minx", "maxy")


@query(
    "f2_sql_keep_ids",
    f"{POINTS} SELECT _unique_id, c_custkey FROM points WHERE c_acctbal < 0",
)
def f2_sql_keep_ids(spark, sf_dir):
    df = run_sql(point_layer(spark, sf_dir), "SELECT c_custkey FROM df WHERE c_acctbal < 0", keep_ids=True)
    return df.select("_unique_id", "c_custkey")


@query(
    "f3_predicates",
    f"{POINTS} SELECT c_custkey, c_mktsegment FROM points WHERE starts_with(c_mktsegment, 'B') AND c_nationkey <> 5",
)
def f3_predicates(spark, sf_dir):
    both = (F.col("c_mktsegment").startswith("B"), F.col("c_nationkey") != 5)
    return op.apply_query(point_layer(spark, sf_dir), both).select("c_custkey", "c_mktsegment")


@query(
    "f4_text_predicate",
    f"{with_layers('dirty')} SELECT c_custkey, segment FROM dirty WHERE segment <> 'BUILDING'",
)
def f4_text_predicate(spark, sf_dir):
    return op.apply_query(layer(spark, sf_dir, "dirty"), "segment != 'BUILDING'").select("c_custkey", "segment")


@query(
    "f4_text_predicate_null_safe",
    f"{with_layers('dirty')} SELECT c_custkey, segment FROM dirty WHERE segment IS DISTINCT FROM 'BUILDING'",
)
def f4_text_predicate_null_safe(spark, sf_dir):
    df = op.apply_query(layer(spark, sf_dir, "dirty"), "segment != 'BUILDING'", null_safe=True)
    return df.select("c_custkey", "segment")


@query(
    "f5_callable_mask",
    f"{POINTS} SELECT c_custkey FROM points WHERE c_nationkey IN (3, 20)",
)
def f5_callable_mask(spark, sf_dir):
    df = op.apply_query(point_layer(spark, sf_dir), lambda df: df["c_nationkey"].isin(3, 20))
    return df.select("c_custkey")


@query(
    "f6_semi",
    f"{POINTS} SELECT _unique_id, c_mktsegment, c_acctbal FROM points WHERE c_acctbal > 9000",
)
def f6_semi(spark, sf_dir):
    keep = lambda df: df.filter("c_acctbal > 9000").select("_unique_id")
    df = op.apply_query(point_layer(spark, sf_dir), keep, keep_rows_only=True)
    return df.select("_unique_id", "c_mktsegment", "c_acctbal")


@query(
    "f7_new_geometry",
    f"""{with_layers('metric_boxes')}, sized AS (
SELECT *, (maxx - minx + 1) * (maxy - miny + 1) AS a FROM metric_boxes),
marked AS (SELECT *, median(a) OVER (PARTITION BY __file_path) AS m FROM sized)
SELECT s_suppkey, CASE WHEN m > 10 THEN trunc(a) ELSE a END AS area,
       minx - 0.5 AS minx, miny - 0.5 AS miny, maxx + 0.5 AS maxx, maxy + 0.5 AS maxy FROM marked""",
)
def f7_new_geometry(spark, sf_dir):
    df = layer(spark, sf_dir, "metric_boxes")
    grown = geo.expand_box(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy"), F.lit(0.5))
    out = with_geometry(df.withColumn(GEOM, grown), F.col(GEOM), crs=None)
    return out.select("s_suppkey", "area", "minx", "miny", "maxx", "maxy")


@query("f9_failing_query", f"{POINTS} SELECT c_custkey, c_mktsegment FROM points")
def f9_failing_query(spark, sf_dir):
    df, message = op.try_query(point_layer(spark, sf_dir), "no_such_column = 1")
    assert message
    return df.select("c_custkey", "c_mktsegment")


@query(
    "f11_rows_of_layer",
    f"{POINTS} SELECT c_custkey FROM points WHERE c_nationkey = 2",
)
def f11_rows_of_layer(spark, sf_dir):
    df = op.rows_of_layer(point_layer(spark, sf_dir), "/layers/customer_points.parquet/nation=2")
    return df.select("c_custkey")


@query(
    "f12_lookup",
    f"{POINTS} SELECT _unique_id AS id, c_custkey, c_mktsegment, c_acctbal, c_nationkey, x, y, "
    "CAST(0 AS DOUBLE) AS area FROM points WHERE c_custkey = 77",
)
def f12_lookup(spark, sf_dir):
    df = point_layer(spark, sf_dir)
    key = df.filter("c_custkey = 77").select("_unique_id").scalar()
    return op.lookup(df, key)


@query(
    "f13_missing",
    f"{with_layers('dirty')} SELECT c_custkey FROM dirty WHERE v IS NULL OR isnan(v)",
)
def f13_missing(spark, sf_dir):
    df = layer(spark, sf_dir, "dirty")
    return df.filter(is_missing(df, "v")).select("c_custkey")


@query(
    "x13_expressions",
    f"{with_layers('boxes')} SELECT s_suppkey, (maxx - minx) * (maxy - miny) / 1000000 AS area_km2 "
    "FROM boxes WHERE s_nationkey IN (3, 7, 20) AND s_acctbal <> 0",
)
def x13_expressions(spark, sf_dir):
    df = layer(spark, sf_dir, "boxes")
    kept = df.filter(F.col("s_nationkey").isin(3, 7, 20) & (F.col("s_acctbal") != 0))
    area = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))
    return kept.select("s_suppkey", (area / 1000000).alias("area_km2"))
