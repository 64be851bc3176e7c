"""What a map client gets: zoom targets, GeoJSON features, attribute rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.wkb import from_wkb
from ..model import BOUNDS_COLUMNS, FILE_PATH, GEOM, GEOMETRY, HIDDEN_COLUMNS, UNIQUE_ID


def _bounds() -> dict[str, Column]:
    return {c: F.col(c) for c in BOUNDS_COLUMNS}


def feature_view(
    df: DataFrame,
    width_px: int = 1000,
    height_px: int = 800,
    min_zoom: int = 0,
    max_zoom: int = 40,
    margin: float = 0.7,
) -> DataFrame:
    """Centre, bounds and whole zoom level that shows each feature with a margin."""
    zoom = geo.zoom_for_bounds(_bounds(), int(width_px * margin), int(height_px * margin))
    clamped = F.greatest(F.least(zoom, F.lit(max_zoom)), F.lit(min_zoom)).cast("int")
    return df.filter(F.col("minx").isNotNull()).select(
        UNIQUE_ID,
        ((F.col("minx") + F.col("maxx")) / 2).alias("center_x"),
        ((F.col("miny") + F.col("maxy")) / 2).alias("center_y"),
        *BOUNDS_COLUMNS,
        clamped.alias("zoom"),
    )


def geojson_features(df: DataFrame, number: Column | None = None) -> DataFrame:
    """One GeoJSON feature per row as text in ``feature``, its id a running number if given."""
    placed = df.withColumn(GEOM, from_wkb(F.col(GEOMETRY)))
    return placed.select(
        F.concat(
            F.lit('{"id":"'),
            (F.col(UNIQUE_ID) if number is None else number).cast("string"),
            F.lit('","type":"Feature","properties":'),
            F.to_json(F.struct(F.col(UNIQUE_ID))),
            F.lit(',"geometry":'),
            F.coalesce(geo.geojson(F.col(GEOM)), F.lit("null")),
            F.lit("}"),
        ).alias("feature")
    )


def attribute_table(df: DataFrame) -> DataFrame:
    """Attributes without hidden columns, the row id shown as ``id``."""
    hidden = [c for c in (*HIDDEN_COLUMNS, FILE_PATH, "split_index") if c != UNIQUE_ID]
    return df.drop(*hidden).withColumnRenamed(UNIQUE_ID, "id")
