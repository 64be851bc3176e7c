"""Zone maps of parquet layers: rows and box of every row group, from the footers alone.

A zone map is a small table that is kept beside a layer. Reads in a viewport take the files that
hold a row group of it, so files are neither listed nor opened that have none; within a file Spark
passes over row groups by the same statistics. A refresh reads the footers of new and changed files.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import BOUNDS_COLUMNS, FILE_PATH, Bounds
from ..operators.filters import filter_bounds
from .readers import NOT_PARQUET, layer_listing, open_path, read_groups, read_parquet

ZONES = (
    f"{FILE_PATH} string, size long, updated timestamp, row_group int, first_row long, n_rows long, "
    "minx double, miny double, maxx double, maxy double, has_missing boolean, columns string, error string"
)
#: Files a scan names; where more hold rows of the viewport, the layer is read as a whole.
MAX_PATHS = 100_000


def _file_zones(path: str, size: int, names: Sequence[str]) -> list[dict]:
    """A row for each row group of a file; one without numbers if its footer can't be read."""
    from pyarrow import parquet as pq

    blank = dict.fromkeys(
        ["row_group", "first_row", "n_rows", *BOUNDS_COLUMNS, "has_missing", "columns", "error"]
    )
    try:
        system, inner = open_path(path)
        with system.open_input_file(inner) as file:
            if not size or file.read_at(4, size - 4) != b"PAR1":
                return [blank | {"error": NOT_PARQUET}]
            footer = pq.read_metadata(file)
    except (OSError, ValueError, pa.ArrowInvalid) as e:
        return [blank | {"error": f"{type(e).__name__}: {e}"}]
    columns = str(footer.schema.to_arrow_schema().remove_metadata())
    place = {footer.schema.column(k).path: k for k in range(len(footer.schema))}
    rows, first = [], 0
    for number in range(footer.num_row_groups):
        group = footer.row_group(number)
        found = blank | {
            "row_group": number, "first_row": first, "n_rows": group.num_rows,
            "columns": columns, "has_missing": False,
        }
        first += group.num_rows
        for bound, name in zip(BOUNDS_COLUMNS, names, strict=True):
            about = group.column(place[name]).statistics if name in place else None
            missing = about.null_count if about is not None and about.has_null_count else None
            found["has_missing"] |= missing is None or missing > 0
            if about is not None and about.has_min_max:
                value = float(about.min if bound.startswith("min") else about.max)
                found[bound] = value if value == value else None
        rows.append(found)
    return rows or [blank | {"row_group": 0, "first_row": 0, "n_rows": 0, "has_missing": False, "columns": columns}]


def read_zones(files: DataFrame, names: Sequence[str] = BOUNDS_COLUMNS) -> DataFrame:
    """``ZONES`` of the files of a listing; ``names`` are the layer's columns with the bounds.

    Tasks open the footers of their share of the files; no data page is read. A bound is null where
    the writer left no statistics: such a row group may hold any rows. ``has_missing`` says that
    some rows may have no bounds.
    """
    kinds = {
        "size": pa.int64(), "updated": pa.timestamp("us", "UTC"), "row_group": pa.int32(),
        "first_row": pa.int64(), "n_rows": pa.int64(), "has_missing": pa.bool_(),
        **dict.fromkeys((FILE_PATH, "columns", "error"), pa.string()),
        **dict.fromkeys(BOUNDS_COLUMNS, pa.float64()),
    }
    schema = pa.schema([(c.split()[0], kinds[c.split()[0]]) for c in ZONES.split(", ")])

    def zones(batches):
        for batch in batches:
            rows = []
            for path, size, updated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                about = {FILE_PATH: path, "size": size, "updated": updated}
                rows += [about | z for z in _file_zones(path, size, names)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    tasks = max(files.sparkSession.sparkContext.defaultParallelism, 1)
    listed = files.select("name", "size", "updated").repartition(tasks, "name")
    return listed.mapInArrow(zones, ZONES)


def _latest(spark: SparkSession, target: str) -> tuple[DataFrame | None, int]:
    try:
        held = spark.read.schema(f"{ZONES}, generation int").parquet(target)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None, 0
    last = held.agg(F.max("generation")).first()[0] or 0
    return held.filter(F.col("generation") == last).drop("generation"), last


def zone_map(
    spark: SparkSession, path, target: str, names: Sequence[str] = BOUNDS_COLUMNS
) -> DataFrame:
    """The zone map of the layer at ``path``, kept at ``target`` and brought up to date.

    Footers are read of files that are new or whose size or time has changed; zones of files that
    are gone are left out. Each refresh that finds a change writes a generation of its own, so
    readers of the one before are not disturbed; without a change nothing is written.
    """
    files = layer_listing(spark, path)
    held, generation = _latest(spark, target)
    if held is None:
        fresh, stale = read_zones(files, names), True
    else:
        same = (
            (F.col("z.__file_path") == F.col("f.name"))
            & (F.col("z.size") == F.col("f.size"))
            & (F.col("z.updated") == F.col("f.updated"))
        )
        kept = held.alias("z").join(files.alias("f"), same, "left_semi")
        new = files.alias("f").join(held.alias("z"), same, "left_anti")
        gone = held.alias("z").join(files.alias("f"), same, "left_anti")
        stale = not (new.select("name").union(gone.select(FILE_PATH))).isEmpty()
        fresh = kept.unionByName(read_zones(new, names))
    if not stale:
        return held
    fresh.write.parquet(f"{target.rstrip('/')}/generation={generation + 1}")
    return _latest(spark, target)[0]


def surviving_zones(zones: DataFrame, bounds, keep_missing: bool = True) -> DataFrame:
    """Row groups that may hold rows of the viewport, or rows without bounds if they are kept."""
    b = Bounds.parse(bounds)
    apart = (
        (F.col("minx") > b.maxx) | (F.col("maxx") < b.minx)
        | (F.col("miny") > b.maxy) | (F.col("maxy") < b.miny)
    )
    inside = ~F.coalesce(apart, F.lit(False))
    if keep_missing:
        inside = inside | F.coalesce(F.col("has_missing"), F.lit(True))
    empty = (F.col("n_rows") == 0) | (F.col("error") == NOT_PARQUET)
    return zones.filter(inside & ~F.coalesce(empty, F.lit(False)))


def row_ranges(zones: DataFrame) -> DataFrame:
    """``(__file_path, first_row, last_row)``: neighbouring row groups of each file as one range."""
    from pyspark.sql import Window

    order = Window.partitionBy(FILE_PATH).orderBy("row_group")
    begins = F.col("row_group") != F.coalesce(F.lag("row_group").over(order) + 1, F.lit(-1))
    numbered = zones.withColumn("__run", F.sum(begins.cast("int")).over(order))
    return numbered.groupBy(FILE_PATH, "__run").agg(
        F.min("first_row").alias("first_row"),
        (F.max(F.col("first_row") + F.col("n_rows")) - 1).alias("last_row"),
    ).drop("__run")


def zone_statistics(zones: DataFrame) -> DataFrame:
    """Rows and box of every file, as ``file_statistics`` has them, without reading a row.

    The box of a file is null where a row group's is not known.
    """
    known = F.bool_and(F.col("minx").isNotNull() & F.col("maxy").isNotNull() | (F.col("n_rows") == 0))
    return zones.groupBy(FILE_PATH).agg(
        F.sum("n_rows").alias("n_rows"),
        *[
            F.when(known, (F.min if c.startswith("min") else F.max)(c)).alias(c)
            for c in BOUNDS_COLUMNS
        ],
    )


def read_in_zones(spark: SparkSession, path, zones: DataFrame, bounds, names: Sequence[str] = BOUNDS_COLUMNS) -> DataFrame:
    """The rows of a parquet layer in the viewport, from files with a row group that may hold some.

    Schemas come from the zone map, so planning takes one job over it and one look at a file for
    each schema. Where more than ``MAX_PATHS`` files are left the whole layer is read, and the
    statistics prune there. A file whose footer could not be read is read too, and tells why.
    """
    found = surviving_zones(zones, bounds).select(FILE_PATH, "columns").distinct()
    rows = found.limit(MAX_PATHS + 1).collect()
    if len(rows) > MAX_PATHS:
        return _in_bounds(read_parquet(spark, path), bounds, names)
    if not rows:
        return read_parquet(spark, path).limit(0)
    groups = defaultdict(list)
    for r in rows:
        groups[r["columns"] or ""].append(r[FILE_PATH])
    return _in_bounds(read_groups(spark, groups, path), bounds, names)


def _in_bounds(df: DataFrame, bounds, names: Sequence[str]) -> DataFrame:
    if tuple(names) == BOUNDS_COLUMNS:
        return filter_bounds(df, bounds)
    b = Bounds.parse(bounds)
    minx, miny, maxx, maxy = (F.col(f"`{n}`") for n in names)
    inside = (minx <= b.maxx) & (maxx >= b.minx) & (miny <= b.maxy) & (maxy >= b.miny)
    return df.filter(inside | minx.isNull())
