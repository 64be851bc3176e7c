"""Turn a source table into a layer: area, bounds, WKB in EPSG:4326, file path and row ids."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as geo
from ..functions.crs import reproject
from ..functions.text import stem
from ..functions.wkb import from_wkb, to_wkb
from ..model import AREA, BOUNDS_COLUMNS, FILE_PATH, GEOM, GEOMETRY, ROW_INDEX, UNIQUE_ID
from ..session import materialise
from .relational import BROADCAST_ROWS, integer_blocks, join_stats, ranked, row_hash, with_quantile_blocks

INTEGER_AREA_FROM = 10


def drop_nested(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.drop(
        *[f.name for f in df.schema.fields if isinstance(f.dataType, nested) and f.name not in keep]
    )


def large_areas(df: DataFrame, by: Sequence[str], area: str = AREA) -> DataFrame:
    """Groups whose median area exceeds 10, from plain sums instead of a sort.

    The median needs only the count on each side of 10; when the halves are equal it is the
    mean of the largest area below and the smallest above. One missing area makes the median
    NaN, which is not above 10.
    """
    value = F.col(area)
    low = value <= INTEGER_AREA_FROM
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(value).alias("n_known"),
        F.count(F.when(low, 1)).alias("n_low"),
        F.max(F.when(low, value)).alias("below"),
        F.min(F.when(~low, value)).alias("above"),
    )
    middle = (F.col("below") + F.col("above")) / 2 > INTEGER_AREA_FROM
    above = (
        F.when(F.col("n_known") < F.col("n"), F.lit(False))
        .when(F.col("n_low") * 2 < F.col("n"), F.lit(True))
        .when(F.col("n_low") * 2 > F.col("n"), F.lit(False))
        .otherwise(F.coalesce(middle, F.lit(False)))
    )
    return sums.select(*by, above.alias("large"))


def truncate_large_areas(df: DataFrame, by: Sequence[str] = (FILE_PATH,), area: str = AREA) -> DataFrame:
    """Cut areas to whole numbers in the files whose median area exceeds 10."""
    marked = join_stats(df, large_areas(df, by, area), by)
    whole = F.col(area).cast("long").cast("double")
    return marked.withColumn(
        area, F.when(F.col("large"), whole).otherwise(F.col(area))
    ).drop("large")


def prepare(
    df: DataFrame,
    crs=None,
    geometry: str = GEOMETRY,
    truncate: bool = True,
    keep_geom: bool = False,
    label: str = "frame",
) -> DataFrame:
    """Add ``area`` (planar, in the source CRS) and bounds and WKB in EPSG:4326.

    ``geometry`` is a WKB column or a nested geometry. Without a CRS nothing is reprojected.
    A table that comes from no file is one file named ``label``. ``truncate`` cuts large areas
    to whole numbers, which takes a pass over all areas and is not for streams.
    """
    if FILE_PATH not in df.columns:
        df = df.withColumn(FILE_PATH, F.lit(label))
    binary = isinstance(df.schema[geometry].dataType, T.BinaryType)
    source = from_wkb(F.col(geometry)) if binary else F.col(geometry)
    nested = drop_nested(df, keep=(geometry,)).drop("id").withColumn(GEOM, source)
    moved = crs is not None
    with_area = nested.withColumn(AREA, geo.area(F.col(GEOM)))
    if truncate:
        with_area = truncate_large_areas(with_area)
    placed = with_area.withColumn(GEOM, reproject(F.col(GEOM), crs, 4326))
    keep_wkb = binary and not moved
    out = placed.withColumns(geo.bounds(F.col(GEOM)))
    if not keep_wkb:
        out = out.withColumn(GEOMETRY, to_wkb(F.col(GEOM)))
        out = out if geometry in (GEOM, GEOMETRY) else out.drop(geometry)
    elif geometry != GEOMETRY:
        out = out.withColumnRenamed(geometry, GEOMETRY)
    return out if keep_geom else out.drop(GEOM)


def without_geometry(df: DataFrame) -> DataFrame:
    """A table without geometry as a layer: null area, bounds and geometry."""
    doubles = {c: F.lit(None).cast("double") for c in (AREA, *BOUNDS_COLUMNS)}
    return df.withColumns({**doubles, GEOMETRY: F.lit(None).cast("binary")})


def with_geometry(df: DataFrame, geom: Column, crs=4326) -> DataFrame:
    """Replace the geometry; area, bounds and WKB are computed anew, ids stay."""
    replaced = df.drop(GEOMETRY, AREA, *BOUNDS_COLUMNS).withColumn(GEOM, geom)
    return prepare(replaced, crs=crs, geometry=GEOM)


def file_index(files: DataFrame, path: str = FILE_PATH) -> DataFrame:
    """Number distinct file paths from 0 in path order, as column ``__file_index``.

    Null paths have no number. Many paths are sorted by range and written, then numbered within
    each range after the counts of the ranges before.
    """
    files = files.filter(F.col(path).isNotNull())
    paths = [r[0] for r in files.limit(BROADCAST_ROWS + 1).collect()]
    if len(paths) <= BROADCAST_ROWS:
        numbers = pa.table(
            {
                path: pa.array(sorted(paths, key=str.encode), pa.string()),
                "__file_index": pa.array(range(len(paths)), pa.int64()),
            }
        )
        return files.sparkSession.createDataFrame(numbers)
    placed = files.repartitionByRange(path).sortWithinPartitions(path)
    kept = materialise(placed.withColumn("__at", F.monotonically_increasing_id()), "paths")
    # The upper bits number the range, the lower ones the path in it.
    part = F.shiftright("__at", 33)
    counts = kept.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    number = F.col("__shift") + F.col("__at").bitwiseAND((1 << 33) - 1)
    return (
        kept.withColumn("__part", part)
        .join(F.broadcast(shifts), "__part")  # a row for each range
        .select(path, number.alias("__file_index"))
    )


def with_unique_id(
    df: DataFrame, files: DataFrame | None = None, row: str = ROW_INDEX, path: str = FILE_PATH
) -> DataFrame:
    """Row id ``"<file number>.<row number>"``, row numbers from 0 in each file.

    ``row`` is the row position the file source reports, so nothing is sorted or shuffled.
    ``files`` is the listing of the layer's files (column ``name``); without it the paths are
    taken from the rows, which reads every file.
    """
    paths = df.select(path).distinct() if files is None else files.select(F.col("name").alias(path))
    numbered = join_stats(df, file_index(paths, path), [path])
    return numbered.withColumn(
        UNIQUE_ID, F.concat(F.col("__file_index").cast("string"), F.lit("."), F.col(row).cast("string"))
    ).drop("__file_index", "id")


def with_frame_ids(df: DataFrame, number: int, order: str) -> DataFrame:
    """Ids of an in-memory table without a file: rows are numbered along ``order``."""
    rows = row_numbers(df, order, "__n")
    return rows.withColumn(
        UNIQUE_ID, F.concat(F.lit(f"{number}."), (F.col("__n") - 1).cast("string"))
    ).drop("__n", "id")


def with_hash_ids(df: DataFrame, number: str = "h") -> DataFrame:
    """Ids for rows of any source: ``"<number>.<hash>-<which>"``, the same on every rerun.

    The hash is over all columns; rows that are equal in it are counted from 0. For sources that
    report no row position: CSV, JSON, GeoJSON, frames.
    """
    hashed = df.withColumn("__hash", row_hash(df))
    which = F.row_number().over(Window.partitionBy("__hash").orderBy("__hash")) - 1
    return hashed.withColumn(
        UNIQUE_ID,
        F.concat(F.lit(f"{number}."), F.hex("__hash"), F.lit("-"), which.cast("string")),
    ).drop("__hash", "id")


def row_numbers(df: DataFrame, order: str, name: str, by: Sequence[str] = ()) -> DataFrame:
    """1-based row number along a numeric or time column, over the table or in each group.

    Rows with equal values are numbered in the order of a hash of the row.
    """
    blocked = with_quantile_blocks(df, order, "__quantile", "__tie")
    keys = [F.col(order), F.col("__tie")]
    return ranked(blocked, by, keys, F.col("__quantile"), name).drop("__quantile", "__tie")


def with_split_index(df: DataFrame, row: str = ROW_INDEX, path: str = FILE_PATH) -> DataFrame:
    """``"<stem> <running count>"`` from 1 in each file, over the rows that are left."""
    counted = ranked(df, [path], [F.col(row)], integer_blocks(row), "__count")
    return counted.withColumn(
        "split_index", F.concat(stem(F.col(path)), F.lit(" "), F.col("__count").cast("string"))
    ).drop("__count")


def colour_columns(df: DataFrame) -> list[str]:
    """Columns a user may colour by: no nested or hidden ones, plus ``area``, sorted."""
    from ..model import HIDDEN_COLUMNS

    names = {
        c
        for c in drop_nested(df).columns
        if c not in HIDDEN_COLUMNS and not (c.startswith("__"))
    }
    return sorted(names | {AREA})


def project_for_drawing(df: DataFrame, column: str | None) -> DataFrame:
    """Only what drawing needs: geometry, id and the chosen column."""
    extra = [column] if column and column in df.columns else []
    return df.select(GEOMETRY, UNIQUE_ID, *extra)
