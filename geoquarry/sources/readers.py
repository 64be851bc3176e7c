"""Readers by file type, each giving file path and row position columns."""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.crs import known_codes
from ..functions.geometry import reproject_bounds
from ..functions.text import file_path
from ..model import BOUNDS_COLUMNS, FILE_PATH, GEOM_TYPE, GEOMETRY, ROW_INDEX, Bounds
from ..operators.prepare import prepare, without_geometry
from ..operators.union import stack
from .inventory import list_files
from .positions import with_positions

NOT_PARQUET = "not a parquet file"
#: Files whose names a plan may hold; beyond that Spark merges the schemas itself.
MAX_NAMES = 100_000
#: Schema groups by path, with what the listing was when the footers were read.
_SEEN: dict = {}
FOOTER_SCHEMA = (
    "__file_path string, n_rows long, primary_column string, crs string, "
    "minx double, miny double, maxx double, maxy double, error string"
)


def located(reader, path, positions: bool = True) -> DataFrame:
    df = reader.load(path)
    columns = {FILE_PATH: file_path(F.col("_metadata.file_path"))}
    if positions:
        columns[ROW_INDEX] = F.col("_metadata.row_index")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*kept, *[c.alias(k) for k, c in columns.items()])


def layer_listing(spark: SparkSession, path) -> DataFrame:
    """The files of a layer; names that begin with a dot or an underscore are no data."""
    paths = [path] if isinstance(path, str) else list(path)
    return reduce(DataFrame.union, [list_files(spark, p) for p in paths]).filter(
        ~F.col("name").rlike(r"/[_.][^/]*$")
    )


def file_schemas(spark: SparkSession, path) -> DataFrame:
    """``(name, size, columns, error)`` of parquet files: their columns and types, as text.

    The footers are read by tasks. ``error`` names what is wrong with a file: it is empty, has no
    parquet mark at its end, or can't be opened. Folders of other files are no parquet files.
    """

    def schemas(batches):
        from pyarrow import parquet as pq

        for batch in batches:
            found, errors = [], []
            for name, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                columns, error = None, None
                try:
                    system, inner = open_path(name)
                    with system.open_input_file(inner) as file:
                        if not size or file.read_at(4, size - 4) != b"PAR1":
                            error = NOT_PARQUET
                        else:
                            columns = str(pq.read_schema(file).remove_metadata())
                except (OSError, ValueError, pa.ArrowInvalid) as e:
                    error = f"{type(e).__name__}: {e}"
                found.append(columns)
                errors.append(error)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(errors, pa.string())],
                names=["name", "size", "columns", "error"],
            )

    files = layer_listing(spark, path).select("name", "size")
    tasks = max(spark.sparkContext.defaultParallelism, 1)
    return files.repartition(tasks, "name").mapInArrow(
        schemas, "name string, size long, columns string, error string"
    )


def open_path(path: str):
    """File system and inner path, for paths with and without a scheme."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def file_catalogue(spark: SparkSession, path) -> DataFrame:
    """(layer, column, type) with each parquet file as a layer, from the footers."""
    line = F.explode(F.split("columns", "\n")).alias("line")
    lines = file_schemas(spark, path).filter("error IS NULL").select("name", line)
    name = F.regexp_extract("line", r"^(\S[^:]*): ", 1)
    kind = F.regexp_extract("line", r"^\S[^:]*: (.*?)(?: not null)?$", 1)
    return lines.select(
        F.col("name").alias("layer"), name.alias("column"), kind.alias("type")
    ).filter("column != ''")


def skipped_files(spark: SparkSession, path) -> DataFrame:
    """``(name, size, error)`` of the files that ``read_parquet`` passes over: no parquet files.

    Files of zero length hold no rows either; Spark's listing leaves them out.
    """
    found = file_schemas(spark, path).filter(F.col("error") == NOT_PARQUET)
    return found.select("name", "size", "error")


def _schema_groups(spark: SparkSession, path) -> list | None:
    """Files by schema and error, or None where no footer needs to be read: there is one file.

    A listing is one job. The footers of a path are read again only when a name, size or time in its
    listing has changed.
    """
    files = layer_listing(spark, path)
    state = files.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("name", "size", "updated").cast("decimal(20,0)")).alias("hash"),
    ).first()
    if state["n"] <= 1:
        return None
    key = spark.sparkContext.applicationId, path if isinstance(path, str) else tuple(path)
    if key not in _SEEN or _SEEN[key][0] != state:
        found = file_schemas(spark, path).groupBy("columns", "error").agg(F.collect_list("name").alias("names"))
        _SEEN[key] = state, found.collect()  # the paths go into the scans
    return _SEEN[key][1]


def read_parquet(spark: SparkSession, path) -> DataFrame:
    """Parquet file, directory or list of them, whatever columns and types each file has.

    Files of one schema are read as they are. Otherwise files are grouped by schema, each group is
    read with its own, and the groups are stacked: absent columns are null, differing types are
    aligned. Only files that are empty or have no parquet mark are passed over (``skipped_files``
    lists them); a file that is damaged further in is an error when its rows are read.
    """
    groups = _schema_groups(spark, path)
    reader = spark.read.format("parquet")
    if groups is None:
        return located(reader.option("mergeSchema", False), path)
    readable = {g["columns"]: g["names"] for g in groups if g["error"] is None}
    unread = [g for g in groups if g["error"] not in (None, NOT_PARQUET)]
    # A damaged footer, or a store that only Spark reads: Spark merges, or tells.
    if unread or sum(map(len, readable.values())) > MAX_NAMES:
        return located(reader.option("mergeSchema", True), path)
    if len(groups) <= 1 or not readable:
        return located(reader.option("mergeSchema", False), path)
    return read_groups(spark, readable, path)


def read_groups(spark: SparkSession, groups: dict[str, list[str]], path) -> DataFrame:
    """Files by schema, each group read with its own, stacked; ``path`` is the layer they are of."""
    reader = spark.read.format("parquet").option("mergeSchema", False)
    if isinstance(path, str) and any("=" in n[len(path) :] for names in groups.values() for n in names):
        reader = reader.option("basePath", path)
    return stack([located(reader, sorted(groups[g])) for g in sorted(groups)])


def row_slice(df: DataFrame, rows: int, batch: int) -> DataFrame:
    """The ``batch``-th run of ``rows`` rows of each file, by the row position in the file."""
    return df.filter(F.col(ROW_INDEX).between(rows * batch, rows * (batch + 1) - 1))


def read_table(spark: SparkSession, path: str, schema=None, positions: bool = False, **options) -> DataFrame:
    """A table without geometry by its suffix: csv, json, orc, xml, txt, parquet.

    With ``positions`` rows of text files get their position in the file too, at the cost of a pass
    that counts (``with_positions``).
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    formats = {"csv": "csv", "json": "json", "jsonl": "json", "orc": "orc", "xml": "xml", "txt": "text", "parquet": "parquet"}
    if suffix not in formats:
        raise ValueError(f"No reader for .{suffix} files")
    reader = spark.read.format(formats[suffix])
    if suffix == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
    if schema is not None:
        reader = reader.schema(schema)
    reader = reader.options(**options)
    if suffix == "parquet":
        return without_geometry(located(reader, path))
    if positions:
        return without_geometry(with_positions(reader.load(path)))
    # Spark numbers the rows of parquet files only.
    return without_geometry(located(reader, path, positions=False))


_POSITION = "array<double>"
_COORDINATES = {
    "Point": (1, _POSITION, 3),
    "LineString": (2, f"array<{_POSITION}>", 2),
    "Polygon": (3, f"array<array<{_POSITION}>>", 1),
    "MultiPoint": (4, f"array<{_POSITION}>", None),
    "MultiLineString": (5, f"array<array<{_POSITION}>>", None),
    "MultiPolygon": (6, f"array<array<array<{_POSITION}>>>", 0),
}


def geojson_geometry(kind: Column, coordinates: Column) -> Column:
    """Nested geometry from GeoJSON type and coordinates text."""
    def xy(p: Column) -> Column:
        return F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))

    out = None
    for name, (code, schema, wraps) in _COORDINATES.items():
        value = F.from_json(coordinates, schema)
        if name == "MultiPoint":
            parts = F.transform(value, lambda p: F.array(F.array(xy(p))))
        elif name == "MultiLineString":
            parts = F.transform(value, lambda line: F.array(F.transform(line, xy)))
        else:
            for _ in range(wraps):
                value = F.array(value)
            parts = F.transform(value, lambda part: F.transform(part, lambda ring: F.transform(ring, xy)))
        geom = F.struct(F.lit(code).alias("kind"), parts.alias("parts")).cast(GEOM_TYPE)
        out = F.when(kind == name, geom) if out is None else out.when(kind == name, geom)
    other = F.raise_error(F.concat(F.lit("No reader for GeoJSON geometries of type "), kind))
    return out.when(kind.isNotNull(), other.cast(GEOM_TYPE))


def geojson_properties(spark: SparkSession, path: str, lines: bool = False) -> T.StructType:
    """Names and types of the properties of all features, by one pass over the files."""
    found = spark.read.option("multiLine", not lines).json(path).schema
    if not lines and "features" in found.names:
        features = found["features"].dataType
        found = features.elementType if isinstance(features, T.ArrayType) else T.StructType()
    kind = found["properties"].dataType if isinstance(found, T.StructType) and "properties" in found.names else None
    return kind if isinstance(kind, T.StructType) else T.StructType()


def read_geojson(
    spark: SparkSession,
    path: str,
    properties: T.StructType | str | None = None,
    crs=4326,
    lines: bool = False,
    positions: bool = False,
) -> DataFrame:
    """GeoJSON as a prepared layer, properties as columns.

    A feature collection is one JSON document, which only one task can parse; ``lines`` reads
    one feature per line and scales with the file. Without ``properties`` their names and types are
    inferred from all features, which takes one more pass. With ``positions`` features get their position in
    the file: the place in the collection, or among the lines.
    """
    if properties is None:
        properties = geojson_properties(spark, path, lines)
    elif isinstance(properties, str):
        properties = T.StructType.fromDDL(properties)
    geometry = T.StructType(
        [T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]
    )
    named = [T.StructField("properties", properties)] if len(properties) else []
    feature = T.StructType([*named, T.StructField("geometry", geometry)])
    schema = feature if lines else T.StructType([T.StructField("features", T.ArrayType(feature))])
    reader = spark.read.format("json").schema(schema).option("multiLine", not lines)
    place = [ROW_INDEX] if positions else []
    if lines and positions:
        rows = with_positions(reader.load(path))
    else:
        rows = located(reader, path, positions=False)
    if not lines:
        rows = rows.select(F.posexplode("features").alias(ROW_INDEX, "f"), FILE_PATH)
        rows = rows.select("f.*", FILE_PATH, F.col(ROW_INDEX).cast("long").alias(ROW_INDEX))
    geom = geojson_geometry(F.col("geometry.type"), F.col("geometry.coordinates"))
    columns = ["properties.*"] if named else []
    flat = rows.select(geom.alias(GEOMETRY), *columns, FILE_PATH, *place)
    return prepare(flat, crs=None if str(crs) == "4326" else crs)


def read_footers(spark: SparkSession, files: DataFrame, name: str = "name") -> DataFrame:
    """Row count, geometry column, CRS and bounding box from the footers of parquet files.

    Each task opens the footers of its share of the paths; no data pages are read. Files
    without the metadata have nulls; ``error`` tells why a footer could not be read. A CRS without
    an authority and code is ``unknown``.
    """

    def footers(batches):
        from pyarrow import parquet as pq

        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                row = dict.fromkeys(
                    ["n_rows", "primary_column", "crs", "minx", "miny", "maxx", "maxy", "error"]
                )
                try:
                    system, inner = open_path(path)
                    footer = pq.read_metadata(inner, filesystem=system)
                    row["n_rows"] = footer.num_rows
                    meta = json.loads((footer.metadata or {}).get(b"geo", b"{}"))
                    column = meta.get("primary_column")
                    about = (meta.get("columns") or {}).get(column, {})
                    crs = about.get("crs")
                    if isinstance(crs, dict):
                        ident = crs.get("id") or {}
                        known = {"authority", "code"} <= ident.keys()
                        crs = f"{ident['authority']}:{ident['code']}" if known else "unknown"
                    row.update(primary_column=column, crs=crs)
                    box = about.get("bbox")
                    if box:
                        half = len(box) // 2
                        row.update(minx=box[0], miny=box[1], maxx=box[half], maxy=box[half + 1])
                except (OSError, ValueError, KeyError, pa.ArrowInvalid) as e:
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append({"__file_path": path, **row})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema(
        [("__file_path", pa.string()), ("n_rows", pa.int64()), ("primary_column", pa.string()),
         ("crs", pa.string()), ("minx", pa.float64()), ("miny", pa.float64()),
         ("maxx", pa.float64()), ("maxy", pa.float64()), ("error", pa.string())]
    )
    tasks = max(spark.sparkContext.defaultParallelism, 1)
    return files.select(name).repartition(tasks, name).mapInArrow(footers, FOOTER_SCHEMA)


def surviving_files(file_stats: DataFrame, bounds) -> DataFrame:
    """Files that may hold rows of the viewport: bounding box overlaps it or is unknown."""
    b = Bounds.parse(bounds)
    inside = (
        (F.col("minx") <= b.maxx) & (F.col("maxx") >= b.minx)
        & (F.col("miny") <= b.maxy) & (F.col("maxy") >= b.miny)
    )
    return file_stats.filter(inside | F.col("minx").isNull())


def read_in_bounds(spark: SparkSession, path, file_stats: DataFrame, bounds) -> DataFrame:
    """Prepared parquet layer in the viewport, reading only files that may hold rows of it.

    The scan names the surviving paths, as Spark's own file listing would; no other file is opened.
    """
    from ..operators.filters import filter_bounds

    paths = [r[0] for r in surviving_files(file_stats, bounds).select(FILE_PATH).collect()]
    if not paths:
        return read_parquet(spark, path).limit(0)
    return filter_bounds(read_parquet(spark, paths), bounds)


def stats_to_4326(file_stats: DataFrame, crs) -> DataFrame:
    """File bounding boxes of one CRS as bounding boxes in EPSG:4326 that hold all their rows."""
    box = {c: F.col(c) for c in BOUNDS_COLUMNS}
    return file_stats.withColumns(reproject_bounds(box, crs, 4326))


def footer_boxes(footers: DataFrame) -> DataFrame:
    """Bounding boxes of files in EPSG:4326, each from the CRS its footer names.

    Boxes without a CRS are taken as they are. Files without a box, or with a CRS that is not
    known here, have null bounds: they may hold any rows.
    """
    code = F.regexp_extract(F.col("crs"), r"^\s*(?:EPSG:)?(\d{4,6})\s*$", 1)
    text = F.upper(F.coalesce(F.col("crs"), F.lit("")))
    plain = F.col("crs").isNull() | text.isin("", "OGC:CRS84", "EPSG:4326", "4326")
    known = footers.withColumn("__code", F.when(plain, "4326").otherwise(code))
    present = known.select("__code").distinct().filter(
        F.col("__code").isin(*map(str, known_codes()))
    )
    codes = sorted(r[0] for r in present.collect())  # a few hundred that can be projected
    box = {c: F.col(c) for c in BOUNDS_COLUMNS}
    moved = {c: F.when(F.col("__code") == "4326", box[c]) for c in box}
    for found in codes:
        if found != "4326":
            there = reproject_bounds(box, found, 4326)
            moved = {c: v.when(F.col("__code") == found, there[c]) for c, v in moved.items()}
    return known.withColumns(moved).drop("__code")
