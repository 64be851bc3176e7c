"""Registration, and the layers derived from the given tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` gives the same result in DuckDB."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The same text runs in Spark and in DuckDB.
LAYERS = {
    "points": """
SELECT concat(CAST(c_nationkey AS VARCHAR(9)), '.', CAST(c_custkey AS VARCHAR(20))) AS _unique_id,
       concat('/layers/customer_points.parquet/nation=', CAST(c_nationkey AS VARCHAR(9)), '/part-0.parquet') AS __file_path,
       c_custkey, c_mktsegment, c_acctbal, c_nationkey,
       CAST(4 AS DOUBLE) + CAST((c_custkey * 37) % 2700 AS DOUBLE) / CAST(100 AS DOUBLE) AS x,
       CAST(57 AS DOUBLE) + CAST((c_custkey * 53) % 1400 AS DOUBLE) / CAST(100 AS DOUBLE) AS y
FROM customer""",
    "boxes": """
SELECT s_suppkey, s_nationkey, s_acctbal,
       concat('1.', CAST(s_suppkey AS VARCHAR(20))) AS _unique_id,
       concat('/layers/supplier_boxes.parquet/part-', CAST(s_nationkey % 3 AS VARCHAR(9)), '.parquet') AS __file_path,
       CAST(4 AS DOUBLE) + CAST((s_suppkey * 271) % 2600 AS DOUBLE) / CAST(100 AS DOUBLE) AS minx,
       CAST(57 AS DOUBLE) + CAST((s_suppkey * 137) % 1300 AS DOUBLE) / CAST(100 AS DOUBLE) AS miny,
       CAST(4 AS DOUBLE) + CAST((s_suppkey * 271) % 2600 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(1 + s_suppkey % 8 AS DOUBLE) / CAST(4 AS DOUBLE) AS maxx,
       CAST(57 AS DOUBLE) + CAST((s_suppkey * 137) % 1300 AS DOUBLE) / CAST(100 AS DOUBLE) + CAST(1 + s_suppkey % 5 AS DOUBLE) / CAST(4 AS DOUBLE) AS maxy
FROM supplier""",
    # Coordinates are halves, so areas are exact; file 0 has small areas, the others large ones.
    "metric_boxes": """
SELECT s_suppkey, __file_path, minx, miny, minx + w AS maxx, miny + h AS maxy FROM (
SELECT s_suppkey,
       concat('/layers/metric.parquet/part-', CAST(s_nationkey % 3 AS VARCHAR(9)), '.parquet') AS __file_path,
       CAST(400 + (s_suppkey * 271) % 2600 AS DOUBLE) / CAST(2 AS DOUBLE) AS minx,
       CAST(5700 + (s_suppkey * 137) % 1300 AS DOUBLE) / CAST(2 AS DOUBLE) AS miny,
       CAST(1 + s_suppkey % 8 AS DOUBLE) * CASE WHEN s_nationkey % 3 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(12.5 AS DOUBLE) END AS w,
       CAST(1 + s_suppkey % 5 AS DOUBLE) * CASE WHEN s_nationkey % 3 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(12.5 AS DOUBLE) END AS h
FROM supplier) AS sized""",
    "nongeo": """
SELECT concat('2.', CAST(event_id AS VARCHAR(20))) AS _unique_id, '/layers/events.csv' AS __file_path,
       event_id, event_type, value,
       CAST(NULL AS DOUBLE) AS area, CAST(NULL AS DOUBLE) AS minx, CAST(NULL AS DOUBLE) AS miny,
       CAST(NULL AS DOUBLE) AS maxx, CAST(NULL AS DOUBLE) AS maxy
FROM events""",
    "dirty": """
SELECT c_custkey, c_mktsegment,
       CASE WHEN c_custkey % 17 = 0 THEN CAST(NULL AS DOUBLE)
            WHEN c_custkey % 19 = 0 THEN CAST('NaN' AS DOUBLE)
            ELSE c_acctbal END AS v,
       CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS segment,
       c_custkey % 4 AS few
FROM customer""",
    "listing": """
SELECT concat('/data/year=', CAST(2020 + o_orderkey % 4 AS VARCHAR(9)), '/set', CAST(o_custkey % 7 AS VARCHAR(9)),
              CASE WHEN o_orderkey % 5 = 0 THEN '.tif' WHEN o_orderkey % 11 = 0 THEN '.txt' ELSE '.parquet' END,
              '/part-', CAST(o_orderkey AS VARCHAR(20)),
              CASE WHEN o_orderkey % 5 = 0 THEN '.tif' WHEN o_orderkey % 11 = 0 THEN '.txt' ELSE '.parquet' END) AS name,
       o_orderkey * 1000 + 17 AS size, o_orderdate AS updated, 'file' AS type
FROM orders""",
}
_CELLS = {
    "spark": "SELECT vec_id, CAST(pos AS BIGINT) AS x, CAST(v AS DOUBLE) AS v FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, v",
    "duckdb": "SELECT vec_id, i - 1 AS x, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) AS u",
}
# Sixty vectors are one raster: twenty rows of three bands, two time slices.
_PIXELS = """
SELECT CAST((vec_id - vec_id % 60) / 60 AS BIGINT) AS raster_id,
       concat('B', CAST(2 + vec_id % 3 AS VARCHAR(9))) AS band,
       CAST(((vec_id - vec_id % 30) / 30) % 2 AS BIGINT) AS time,
       CAST((vec_id % 60 - vec_id % 3) / 3 AS BIGINT) AS y, x,
       CASE WHEN (vec_id + x) % 41 = 0 THEN CAST('NaN' AS DOUBLE) ELSE v END AS value
FROM ({cells}) AS cells"""
LAYERS["pixels"] = _PIXELS.format(cells=_CELLS["duckdb"])


def layer(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived layer as a Spark table."""
    text = _PIXELS.format(cells=_CELLS["spark"]) if name == "pixels" else LAYERS[name]
    found = {}

    def slot(match):
        found[match[1]] = table(spark, sf_dir, match[1])
        return f"FROM {{{match[1]}}}"

    return spark.sql(re.sub(r"FROM ([a-z]+)\b(?! AS)", slot, text), **found)


def with_layers(*names: str) -> str:
    """``WITH`` clause that defines derived layers in DuckDB."""
    return "WITH " + ", ".join(f"{n} AS ({LAYERS[n]})" for n in names)


VIEWPORT = (9.0, 59.0, 14.0, 62.0)
INSIDE = "(minx <= 14 AND maxx >= 9 AND miny <= 62 AND maxy >= 59 OR minx IS NULL)"
POINT_BOUNDS = "x AS minx, y AS miny, x AS maxx, y AS maxy"


def point_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points with bounds columns and zero area."""
    return layer(spark, sf_dir, "points").selectExpr(
        "*", "x AS minx", "y AS miny", "x AS maxx", "y AS maxy", "CAST(0 AS DOUBLE) AS area"
    )
