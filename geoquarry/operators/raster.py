"""Rasters as long pixel tables ``(raster_id, band, time, y, x, value)``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.geometry import reproject_bounds
from ..model import BOUNDS_COLUMNS, Bounds
from ..session import materialise
from .relational import join_stats
from .spatial import bounds_join

RASTER = "raster_id"
# Default bands of a red, green, blue image.
RGB_BANDS = ("B4", "B3", "B2")


#: Share of a pixel by which the gaps of an axis may differ: rounding of coordinates.
UNEVEN = 1e-3


class RasterError(ValueError):
    """A raster that cannot be drawn as asked."""


def axis(pixels: DataFrame, name: str, by: Sequence[str] = (RASTER,)) -> DataFrame:
    """``(*by, at, number)``: the pixel centres along an axis of each raster, from 0 upward.

    Equal centres are combined before the shuffle, so an axis of n pixels costs n rows a task. Write
    the table when it is used more than once.
    """
    places = pixels.filter(F.col(name).isNotNull()).select(*by, F.col(name).alias("at")).distinct()
    order = Window.partitionBy(*by).orderBy("at")
    return places.withColumn("number", F.row_number().over(order) - 1)


def _axis_size(pixels: DataFrame, name: str, by: Sequence[str]) -> DataFrame:
    """First, last and number of centres along an axis, and its least and largest gap."""
    order = Window.partitionBy(*by).orderBy("number")
    gap = F.col("at") - F.lag("at").over(order)
    return axis(pixels, name, by).withColumn("gap", gap).groupBy(*by).agg(
        F.min("at").alias(f"{name}0"), F.max("at").alias(f"{name}1"), F.count("at").alias(f"n{name}"),
        F.min("gap").alias(f"least_{name}"), F.max("gap").alias(f"largest_{name}"),
    )


def raster_bounds(pixels: DataFrame, by: Sequence[str] = (RASTER,)) -> DataFrame:
    """Resolution and bounds of each raster, half a pixel beyond the outer pixel centres.

    Rasters of one row or column, with unlike resolutions, or with pixels that lie unevenly along an
    axis (by more than ``UNEVEN`` of a pixel) raise an error.
    """
    x, y = (_axis_size(pixels, name, by) for name in ("x", "y"))
    same = [x[c].eqNullSafe(y[c]) for c in by]
    raw = x.join(y, reduce(and_, same)).select(
        *[x[c] for c in by], *[c for c in x.columns + y.columns if c not in by]
    )
    step_x = (F.col("x1") - F.col("x0")) / F.nullif(F.col("nx") - 1, F.lit(0))
    step_y = (F.col("y1") - F.col("y0")) / F.nullif(F.col("ny") - 1, F.lit(0))
    sized = raw.withColumns({"rx": step_x, "ry": step_y})
    single = F.raise_error(F.lit("Cannot calculate the resolution of a single row or column"))
    unlike = F.raise_error(
        F.concat(F.lit("x and y resolution differ: "), F.col("rx").cast("string"), F.lit(", "), F.col("ry").cast("string"))
    )
    uneven = F.raise_error(F.lit("Pixels lie unevenly along an axis"))
    spread = [
        F.col(f"largest_{a}") - F.col(f"least_{a}") > UNEVEN * F.col(f"r{a}") for a in ("x", "y")
    ]
    resolution = (
        F.when(F.col("rx").isNull() | F.col("ry").isNull(), single.cast("double"))
        .when(spread[0] | spread[1], uneven.cast("double"))
        .when(F.col("rx") != F.col("ry"), unlike.cast("double"))
        .otherwise(F.col("rx"))
    )
    return sized.withColumn("resolution", resolution).select(
        *by,
        "resolution",
        (F.col("x0") - F.col("resolution") / 2).alias("minx"),
        (F.col("y0") - F.col("resolution") / 2).alias("miny"),
        (F.col("x1") + F.col("resolution") / 2).alias("maxx"),
        (F.col("y1") + F.col("resolution") / 2).alias("maxy"),
    )


def project_bounds(spark, bounds, crs) -> Bounds:
    """Viewport corners in the CRS of a raster, as bounds."""
    b = Bounds.parse(bounds)
    box = dict(zip(BOUNDS_COLUMNS, map(F.lit, b.as_list()), strict=True))
    moved = reproject_bounds(box, 4326, crs)
    row = spark.range(1).select(*[c.alias(k) for k, c in moved.items()]).first()
    return Bounds(row["minx"], row["miny"], row["maxx"], row["maxy"])


def clip(pixels: DataFrame, bounds, crs=None) -> DataFrame:
    """Pixels whose centre lies in the viewport, edges included; plain range filters.

    ``crs`` is the CRS of the pixels where it is not EPSG:4326.
    """
    b = Bounds.parse(bounds) if crs is None else project_bounds(pixels.sparkSession, bounds, crs)
    return pixels.filter(F.col("x").between(b.minx, b.maxx) & F.col("y").between(b.miny, b.maxy))


def choose_bands(bands: Sequence[str], rgb_bands: Sequence[str] | None = RGB_BANDS) -> list[str]:
    """Bands to draw: the only one, else the configured three, else all of three, else the first."""
    if len(bands) == 1:
        return list(bands)
    if rgb_bands and all(b in bands for b in rgb_bands):
        return list(rgb_bands)
    return list(bands) if len(bands) == 3 else list(bands)[:1]


def select_bands(pixels: DataFrame, rgb_bands: Sequence[str] | None = RGB_BANDS) -> DataFrame:
    """Keep the bands to draw of each raster, by the rule of :func:`choose_bands`.

    Of other band sets the band with the most pixels is kept, the first by name of equals.
    """
    sizes = pixels.groupBy(RASTER, "band").agg(F.count(F.lit(1)).alias("n"))
    found = sizes.groupBy(RASTER).agg(
        F.count(F.lit(1)).alias("n_bands"),
        F.count(F.when(F.col("band").isin(*(rgb_bands or [""])), 1)).alias("n_rgb"),
        F.min_by("band", F.struct(-F.col("n"), F.col("band"))).alias("largest"),
    )
    marked = join_stats(pixels, found, [RASTER])
    keep = F.when(F.col("n_bands") == 1, F.lit(True))
    if rgb_bands:
        keep = keep.when(F.col("n_rgb") == len(rgb_bands), F.col("band").isin(*rgb_bands))
    keep = keep.when(F.col("n_bands") == 3, F.lit(True)).otherwise(F.col("band") == F.col("largest"))
    return marked.filter(keep).select(*pixels.columns)


def first_time(pixels: DataFrame) -> DataFrame:
    """Only the earliest time slice of each raster; rasters without time stay whole."""
    first = pixels.groupBy(RASTER).agg(F.min("time").alias("__first"))
    joined = join_stats(pixels, first, [RASTER])
    return joined.filter(F.col("__first").isNull() | (F.col("time") == F.col("__first"))).select(
        *pixels.columns
    )


def sort_by_time(pixels: DataFrame) -> DataFrame:
    return pixels.orderBy("time")


def _number(name: str = "value") -> Column:
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def normalise(pixels: DataFrame) -> DataFrame:
    """Scale all single-band images to 0..1 by their common extremes; other images stay."""
    bands = pixels.select(RASTER, "band").distinct().groupBy(RASTER)
    single = bands.agg((F.count(F.lit(1)) == 1).alias("__single"))
    marked = join_stats(pixels, single, [RASTER])
    low = pixels.agg(F.min(_number()).alias("low")).scalar()
    high = pixels.agg(F.max(_number()).alias("high")).scalar()
    scaled = (F.col("value") - low) / F.nullif(high - low, F.lit(0.0))
    return marked.withColumn(
        "value", F.when(F.col("__single"), scaled).otherwise(F.col("value"))
    ).drop("__single")


def fill_nan(pixels: DataFrame) -> DataFrame:
    """Missing pixels take the smallest value of their image, unless all are missing."""
    lowest = pixels.groupBy(RASTER).agg(F.min(_number()).alias("__low"))
    return join_stats(pixels, lowest, [RASTER]).withColumn(
        "value", F.coalesce(_number(), F.col("__low"), F.col("value"))
    ).drop("__low")


def nearest_pixel(pixels: DataFrame, x: float, y: float) -> DataFrame:
    """Pixels of each raster at the x and at the y nearest to a point, found independently."""
    def nearest(axis: str, at: float) -> Column:
        return F.min(F.struct(F.abs(F.col(axis) - F.lit(at)).alias("d"), F.col(axis).alias("v")))["v"]

    found = pixels.groupBy(RASTER).agg(nearest("x", x).alias("__x"), nearest("y", y).alias("__y"))
    joined = join_stats(pixels, found, [RASTER], how="inner")
    return joined.filter((F.col("x") == F.col("__x")) & (F.col("y") == F.col("__y"))).select(
        *pixels.columns
    )


def pixels_at(points: DataFrame, pixels: DataFrame, px: str = "px", py: str = "py") -> DataFrame:
    """Pixel values of regular rasters at many points: an equi-join on grid positions.

    Each point takes the cell it falls in; points outside a raster have no row. Select the
    needed point columns first.
    """
    grid = materialise(raster_bounds(pixels), "grid")
    met = bounds_join(points, grid, left_bounds=(px, py, px, py))
    located = met.select("l.*", *[F.col("r")[c].alias(c) for c in grid.columns]).filter(
        (F.col(px) < F.col("maxx")) & (F.col(py) < F.col("maxy"))
    )
    at = located.withColumns(
        {
            "__col": F.floor((F.col(px) - F.col("minx")) / F.col("resolution")),
            "__row": F.floor((F.col(py) - F.col("miny")) / F.col("resolution")),
        }
    ).select(*points.columns, RASTER, "__col", "__row")
    numbered = join_stats(pixels, grid, [RASTER], how="inner").withColumns(
        {
            "__col": F.floor((F.col("x") - F.col("minx")) / F.col("resolution")),
            "__row": F.floor((F.col("y") - F.col("miny")) / F.col("resolution")),
        }
    ).select(*pixels.columns, "__col", "__row")
    return at.join(numbered, [RASTER, "__col", "__row"]).drop("__col", "__row")


def series(pixels: DataFrame, axis: str = "time") -> DataFrame:
    """Long form for plots: value, position on the axis, band as colour."""
    return pixels.select(RASTER, F.col("band").alias("color"), F.col(axis), "value")


def from_wide(wide: DataFrame, ids: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """Long pixel rows from one column per band."""
    return wide.unpivot(list(ids), list(bands), "band", "value")


def _pixel(pixels: DataFrame) -> list[str]:
    """What tells pixels apart: raster, place, and time where there is one."""
    return [RASTER, *(["time"] if "time" in pixels.columns else []), "y", "x"]


def by_band(pixels: DataFrame, bands: Sequence[str], by: Sequence[str] | None = None) -> DataFrame:
    """One row per pixel (and time) with a column per band."""
    by = _pixel(pixels) if by is None else by
    return pixels.groupBy(*by).pivot("band", list(bands)).agg(F.first("value", ignorenulls=True))


def rgb(pixels: DataFrame, bands: Sequence[str] = RGB_BANDS) -> DataFrame:
    """One row per pixel with the three band values as an array; other counts are errors."""
    if len(bands) not in (1, 3):
        raise RasterError("Only one band or three bands can be drawn")
    wide = by_band(pixels, bands)
    return wide.select(*_pixel(pixels), F.array(*[F.col(f"`{b}`") for b in bands]).alias("rgb"))


def band_math(pixels: DataFrame, bands: Sequence[str], expression: Column, name: str = "value") -> DataFrame:
    """A new single-band image computed from the bands of each pixel."""
    return by_band(pixels, bands).select(*_pixel(pixels), expression.alias(name))


def transform(pixels: DataFrame, function: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a user function to the pixel table; the result must stay a pixel table."""
    result = function(pixels)
    if not isinstance(result, DataFrame):
        raise RasterError(f"A raster function must give a table, not {type(result).__name__}")
    lost = {RASTER, "x", "y"} - set(result.columns)
    if lost:
        raise RasterError(f"A raster function must keep {sorted(lost)}")
    return result


def place_pixels(tiles: DataFrame, x0: str = "x0", y0: str = "y0", resolution: str = "resolution") -> DataFrame:
    """Coordinates of pixel centres from rows and columns counted from the upper left corner."""
    return tiles.withColumns(
        {
            "x": F.col(x0) + (F.col("col") + 0.5) * F.col(resolution),
            "y": F.col(y0) - (F.col("row") + 0.5) * F.col(resolution),
        }
    )


def raster_crs(attributes: DataFrame) -> DataFrame:
    """EPSG code of each raster from its attributes ``(raster_id, key, value)``.

    Attributes whose name speaks of a projection, CRS or UTM are looked at; the first by name
    that ends in an EPSG code counts.
    """
    wanted = F.lower("key").rlike("projection|crs|utm")
    code = F.regexp_extract(F.col("value"), r"(?i)(?:epsg\D{0,4})?(\d{4,6})\D*$", 1)
    return (
        attributes.filter(wanted & (code != ""))
        .groupBy(RASTER)
        .agg(F.min_by(code.cast("int"), "key").alias("epsg"))
    )
