"""Writers for features and attribute tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import BOUNDS_COLUMNS, UNIQUE_ID
from ..operators.features import attribute_table, geojson_features


def write_geojson_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One GeoJSON feature per line, written by all tasks."""
    geojson_features(df).write.mode(mode).text(path)


def write_attributes(df: DataFrame, path: str, file_format: str = "json", mode: str = "errorifexists") -> None:
    attribute_table(df).write.mode(mode).format(file_format).save(path)


def write_layer(
    df: DataFrame, path: str, cell: float = 1.0, files: int | None = None, mode: str = "errorifexists"
) -> None:
    """A prepared layer laid out by place, so that parquet statistics prune by viewport.

    Rows are range-partitioned by grid cell and sorted inside files; a cell with many rows is
    spread over files by the hash of the row id. Without ``files`` Spark sizes them itself.
    """
    x, y, _, _ = BOUNDS_COLUMNS
    keyed = df.withColumns(
        {
            "__cx": F.floor(F.col(x) / cell),
            "__cy": F.floor(F.col(y) / cell),
            "__spread": F.xxhash64(F.col(UNIQUE_ID if UNIQUE_ID in df.columns else x)),
        }
    )
    keys = ["__cx", "__cy", "__spread"]
    ranges = [files, *keys] if files else keys
    keyed.repartitionByRange(*ranges).sortWithinPartitions("__cx", "__cy").drop(*keys).write.mode(
        mode
    ).parquet(path)


def write_by_color(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Features split into one folder per colour."""
    df.write.mode(mode).partitionBy("_color").parquet(path)
