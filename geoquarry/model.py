"""Shared data model: column names, viewport bounds, layers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns the engine adds to every layer.
GEOMETRY = "geometry"
GEOM = "geom"
UNIQUE_ID = "_unique_id"
FILE_PATH = "__file_path"
ROW_INDEX = "__row_index"
BOUNDS_COLUMNS = ("minx", "miny", "maxx", "maxy")
AREA = "area"
HIDDEN_COLUMNS = (*BOUNDS_COLUMNS, UNIQUE_ID, FILE_PATH, GEOMETRY)
ADDED_COLUMNS = (*HIDDEN_COLUMNS, AREA)

GEOM_TYPE = (
    "struct<kind:int,parts:array<array<array<struct<x:double,y:double>>>>>"
)

# WKB geometry kinds.
POINT, LINESTRING, POLYGON = 1, 2, 3
MULTIPOINT, MULTILINESTRING, MULTIPOLYGON, COLLECTION = 4, 5, 6, 7


@dataclass(frozen=True)
class Bounds:
    """A viewport in EPSG:4326 degrees."""

    minx: float
    miny: float
    maxx: float
    maxy: float

    @classmethod
    def parse(cls, value) -> Bounds:
        """Accept flat bounds or the nested ``[[miny, minx], [maxy, maxx]]`` form."""
        if isinstance(value, Bounds):
            return value
        value = list(value)
        if len(value) == 2:
            (miny, minx), (maxy, maxx) = value
            return cls(float(minx), float(miny), float(maxx), float(maxy))
        return cls(*(float(v) for v in value))

    def as_list(self) -> list[float]:
        return [self.minx, self.miny, self.maxx, self.maxy]


Query = str | Column | Sequence[Column] | Callable | None


@dataclass(frozen=True)
class Layer:
    """A named table of the map, with the query that is applied to it."""

    path: str
    df: DataFrame = field(compare=False)
    query: Query = field(default=None, compare=False)
    visible: bool = True


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN for floating columns."""
    column = F.col(f"`{name}`")
    if df.schema[name].dataType.typeName() in ("float", "double"):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def without_nan(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null, so aggregates skip it."""
    column = F.col(f"`{name}`")
    if df.schema[name].dataType.typeName() in ("float", "double"):
        return F.nanvl(column, F.lit(None).cast("double"))
    return column
