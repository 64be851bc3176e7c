"""Rasters as pixel tables."""

from pyspark.sql import functions as F

from geoquarry.operators import raster as op

from .base import layer, query, table, with_layers

PIXELS = with_layers("pixels")


@query(
    "r1_raster_bounds",
    f"""{PIXELS} SELECT raster_id, CAST(max(x) - min(x) AS DOUBLE) / (count(DISTINCT x) - 1) AS resolution,
min(x) - 0.5::DOUBLE AS minx, min(y) - 0.5::DOUBLE AS miny, max(x) + 0.5::DOUBLE AS maxx, max(y) + 0.5::DOUBLE AS maxy FROM pixels GROUP BY raster_id""",
)
def r1_raster_bounds(spark, sf_dir):
    return op.raster_bounds(layer(spark, sf_dir, "pixels"))


@query("r2_clip", f"{PIXELS} SELECT * FROM pixels WHERE x BETWEEN 10 AND 30.5 AND y BETWEEN 2.5 AND 12")
def r2_clip(spark, sf_dir):
    return op.clip(layer(spark, sf_dir, "pixels"), (10, 2.5, 30.5, 12))


@query(
    "r3_bands",
    f"""{PIXELS}, all_bands AS (SELECT * REPLACE (CASE WHEN raster_id % 2 = 1 AND band = 'B2' THEN 'B3' ELSE band END AS band) FROM pixels),
sizes AS (SELECT raster_id, band, count(*) AS n FROM all_bands GROUP BY ALL),
found AS (SELECT raster_id, count(*) AS n_bands, arg_min(band, (-n, band)) AS largest FROM sizes GROUP BY ALL)
SELECT p.raster_id, p.band, count(*) AS n FROM all_bands p JOIN found f ON p.raster_id = f.raster_id
WHERE n_bands = 3 OR p.band = largest GROUP BY ALL""",
)
def r3_bands(spark, sf_dir):
    band = F.expr("CASE WHEN raster_id % 2 = 1 AND band = 'B2' THEN 'B3' ELSE band END")
    pixels = layer(spark, sf_dir, "pixels").withColumn("band", band)
    return op.select_bands(pixels).groupBy("raster_id", "band").agg(F.count(F.lit(1)).alias("n"))


@query(
    "r4_first_time",
    f"{PIXELS} SELECT p.* FROM pixels p JOIN (SELECT raster_id, min(time) AS t FROM pixels GROUP BY raster_id) f ON p.raster_id = f.raster_id AND time = t",
)
def r4_first_time(spark, sf_dir):
    return op.first_time(layer(spark, sf_dir, "pixels"))


@query(
    "r5_normalise",
    f"""{PIXELS}, kept AS (SELECT * REPLACE (CASE WHEN raster_id % 2 = 1 THEN 'B4' ELSE band END AS band) FROM pixels),
ends AS (SELECT min(value) AS lo, max(value) AS hi FROM kept WHERE NOT isnan(value)),
singles AS (SELECT raster_id, count(DISTINCT band) = 1 AS single FROM kept GROUP BY raster_id)
SELECT kept.raster_id, band, y, x, CASE WHEN NOT isnan(value) THEN round(CASE WHEN single THEN (value - lo) / (hi - lo) ELSE value END, 9) END AS value
FROM kept JOIN singles ON kept.raster_id = singles.raster_id, ends""",
)
def r5_normalise(spark, sf_dir):
    band = F.expr("CASE WHEN raster_id % 2 = 1 THEN 'B4' ELSE band END")
    out = op.normalise(layer(spark, sf_dir, "pixels").withColumn("band", band))
    value = F.when(~F.isnan("value"), F.round("value", 9))
    return out.select("raster_id", "band", "y", "x", value.alias("value"))


@query(
    "r6_nan_fill",
    f"""{PIXELS} SELECT p.raster_id, band, y, x, CASE WHEN isnan(value) THEN lo ELSE value END AS value FROM pixels p
JOIN (SELECT raster_id, min(value) AS lo FROM pixels WHERE NOT isnan(value) GROUP BY raster_id) m ON p.raster_id = m.raster_id""",
)
def r6_nan_fill(spark, sf_dir):
    return op.fill_nan(layer(spark, sf_dir, "pixels")).select("raster_id", "band", "y", "x", "value")


@query(
    "r7_nearest",
    f"""{PIXELS}, near AS (SELECT raster_id, arg_min(x, (abs(x - 17.3), x)) AS nx, arg_min(y, (abs(y - 30.0), y)) AS ny FROM pixels GROUP BY raster_id)
SELECT p.* FROM pixels p JOIN near ON p.raster_id = near.raster_id AND x = nx AND y = ny""",
)
def r7_nearest(spark, sf_dir):
    return op.nearest_pixel(layer(spark, sf_dir, "pixels"), 17.3, 30.0)


@query(
    "r7_pixels_at_points",
    f"""{PIXELS}, places AS (SELECT s_suppkey, CAST(s_suppkey % 70 AS DOUBLE) - 2.25 AS px, CAST(s_suppkey % 23 AS DOUBLE) - 1.25 AS py FROM supplier)
SELECT s_suppkey, raster_id, band, value FROM places JOIN pixels ON px >= x - 0.5 AND px < x + 0.5 AND py >= y - 0.5 AND py < y + 0.5""",
)
def r7_pixels_at_points(spark, sf_dir):
    places = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey", "CAST(s_suppkey % 70 AS DOUBLE) - 2.25 AS px", "CAST(s_suppkey % 23 AS DOUBLE) - 1.25 AS py"
    )
    return op.pixels_at(places, layer(spark, sf_dir, "pixels")).select("s_suppkey", "raster_id", "band", "value")


@query("r8_series", f"{PIXELS} SELECT raster_id, band AS color, time, value FROM pixels")
def r8_series(spark, sf_dir):
    return op.series(layer(spark, sf_dir, "pixels"))


@query(
    "r8_from_wide",
    "SELECT l_orderkey, l_linenumber, l_partkey, 'l_quantity' AS band, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_tax', l_tax FROM lineitem",
)
def r8_from_wide(spark, sf_dir):
    wide = table(spark, sf_dir, "lineitem")
    return op.from_wide(wide, ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_tax"])


WIDE = f"""{PIXELS}, wide AS (SELECT raster_id, y, x, max(value) FILTER (WHERE band = 'B2') AS b2, max(value) FILTER (WHERE band = 'B3') AS b3,
max(value) FILTER (WHERE band = 'B4') AS b4 FROM pixels GROUP BY raster_id, y, x)"""


TIMES = """, times AS (SELECT raster_id, band, t.time, y, x, value + t.time AS value FROM pixels, (SELECT 0 AS time UNION ALL SELECT 1) AS t)"""


def timed(spark, sf_dir):
    """Every pixel at two times."""
    return layer(spark, sf_dir, "pixels").drop("time").selectExpr("*", "explode(array(0L, 1L)) AS time").withColumn("value", F.col("value") + F.col("time"))


@query(
    "r10_band_math_times",
    f"""{PIXELS}{TIMES} SELECT raster_id, time, y, x, round(max(value) FILTER (WHERE band = 'B4') - max(value) FILTER (WHERE band = 'B3'), 6) AS value
FROM times GROUP BY raster_id, time, y, x HAVING NOT isnan(max(value) FILTER (WHERE band = 'B4')) AND NOT isnan(max(value) FILTER (WHERE band = 'B3'))""",
)
def r10_band_math_times(spark, sf_dir):
    image = op.band_math(timed(spark, sf_dir), ["B3", "B4"], F.round(F.col("B4") - F.col("B3"), 6))
    return image.filter(F.col("value").isNotNull() & ~F.isnan("value"))


@query(
    "r9_rgb_first_time",
    f"{WIDE} SELECT raster_id, 0 AS time, y, x, b4 AS red, b3 AS green, b2 AS blue FROM wide",
)
def r9_rgb_first_time(spark, sf_dir):
    colors = [F.col("rgb")[i].alias(n) for i, n in enumerate(("red", "green", "blue"))]
    return op.rgb(op.first_time(timed(spark, sf_dir))).select("raster_id", "time", "y", "x", *colors)


@query("r9_rgb", f"{WIDE} SELECT raster_id, y, x, b4 AS red, b3 AS green, b2 AS blue FROM wide")
def r9_rgb(spark, sf_dir):
    colors = [F.col("rgb")[i].alias(n) for i, n in enumerate(("red", "green", "blue"))]
    return op.rgb(layer(spark, sf_dir, "pixels")).select("raster_id", "y", "x", *colors)


@query("r10_band_math", f"{WIDE} SELECT raster_id, y, x, round((b4 - b3) / nullif(b4 + b3, 0), 6) AS value FROM wide WHERE NOT isnan(b4) AND NOT isnan(b3)")
def r10_band_math(spark, sf_dir):
    red, green = F.col("B4"), F.col("B3")
    index = F.round((red - green) / F.nullif(red + green, F.lit(0)), 6)
    pixels = layer(spark, sf_dir, "pixels")
    image = op.transform(pixels, lambda p: op.band_math(p, ["B3", "B4"], F.when(~F.isnan("B4") & ~F.isnan("B3"), index)))
    return image.filter(F.col("value").isNotNull()).drop("time")


@query(
    "r11_raster_crs",
    "SELECT c_custkey AS raster_id, CASE WHEN c_custkey % 3 = 0 THEN 25832 ELSE 32633 END AS epsg FROM customer WHERE c_custkey % 3 < 2",
)
def r11_raster_crs(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    attributes = customers.selectExpr(
        "c_custkey AS raster_id",
        "CASE c_custkey % 3 WHEN 0 THEN 'UTM_projection' WHEN 1 THEN 'crs' ELSE 'title' END AS key",
        "CASE c_custkey % 3 WHEN 0 THEN 'urn:ogc:def:crs:EPSG::25832' WHEN 1 THEN 'EPSG:32633' ELSE 'EPSG:9999' END AS value",
    )
    return op.raster_crs(attributes)


@query(
    "r13_place_pixels",
    f"{PIXELS} SELECT raster_id, band, 100 + (x + 0.5::DOUBLE) * 10 AS x, CAST(900 AS DOUBLE) - (y + 0.5::DOUBLE) * 10 AS y FROM pixels",
)
def r13_place_pixels(spark, sf_dir):
    tiles = layer(spark, sf_dir, "pixels").selectExpr(
        "raster_id", "band", "x AS col", "y AS row", "100D AS x0", "900D AS y0", "10D AS resolution"
    )
    return op.place_pixels(tiles).select("raster_id", "band", "x", "y")


@query("o4_sort_by_time", f"{PIXELS} SELECT * FROM pixels")
def o4_sort_by_time(spark, sf_dir):
    return op.sort_by_time(layer(spark, sf_dir, "pixels"))
