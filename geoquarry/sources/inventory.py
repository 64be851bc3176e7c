"""File inventory: listing, search, sort, dataset sizes, layer files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ends_with_any, file_path, match_terms, path_prefixes
from ..operators.filters import belongs_to

# File types a layer can be read from.
FORMATS = (".parquet", ".geojson", ".json", ".csv", ".orc", ".xml", ".txt", ".tif", ".tiff", ".nc", ".ncml")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """All files below a path: name, size, updated, type. Contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    )
    return files.select(
        file_path(F.col("path"), encoded=False).alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("updated"),
        F.lit("file").alias("type"),
    )


def with_directories(files: DataFrame, below: str = "") -> DataFrame:
    """Add the directories between ``below`` and the files, with size 0 and no time."""
    directories = files.select(F.explode(path_prefixes(F.col("name"))).alias("name")).distinct()
    if below:
        directories = directories.filter(F.col("name").startswith(below.rstrip("/") + "/"))
    return files.unionByName(
        directories.select(
            "name",
            F.lit(0).cast("long").alias("size"),
            F.lit(None).cast(files.schema["updated"].dataType).alias("updated"),
            F.lit("directory").alias("type"),
        )
    )


def level_of(listing: DataFrame, path: str) -> DataFrame:
    """Only the entries directly below ``path``."""
    rest = F.substring(F.col("name"), F.lit(len(path.rstrip("/")) + 2), F.length("name"))
    direct = F.col("name").startswith(path.rstrip("/") + "/") & ~rest.contains("/")
    return listing.filter(direct)


def search(
    listing: DataFrame,
    text: str | None,
    case_sensitive: bool = True,
    formats: Sequence[str] = FORMATS,
    path: str | None = None,
) -> DataFrame:
    """Directories and known file types whose name matches the search, without ``path`` itself."""
    name = F.col("name")
    known = (F.col("type") == "directory") | ends_with_any(name, formats)
    found = listing.filter(match_terms(name, text, case_sensitive) & known)
    return found if path is None else found.filter(name != path.rstrip("/"))


def sort_listing(listing: DataFrame, key: str = "name", descending: bool = False) -> DataFrame:
    """Sort by name, size or update time; entries without the key last, or first when reversed."""
    column = F.col(key)
    return listing.orderBy(column.desc_nulls_first() if descending else column.asc_nulls_last())


def dataset_sizes(listing: DataFrame) -> DataFrame:
    """Directories that are or lie in a ``*.parquet`` dataset: summed size, latest update.

    Only parquet files count; a directory without any has size 0 and the epoch as its time.
    """
    parts = listing.filter(F.col("type") == "file").select(
        F.explode(path_prefixes(F.col("name"))).alias("dataset"),
        F.col("name").endswith(".parquet").alias("counts"),
        "size",
        "updated",
    )
    inside = parts.filter(F.col("dataset").rlike(r"\.parquet(/|$)"))
    epoch = F.timestamp_seconds(F.lit(0)).cast(listing.schema["updated"].dataType)
    return inside.groupBy("dataset").agg(
        F.coalesce(F.sum(F.when(F.col("counts"), F.col("size"))), F.lit(0)).alias("size"),
        F.coalesce(F.max(F.when(F.col("counts"), F.col("updated"))), epoch).alias("updated"),
    )


def megabytes(size: Column) -> Column:
    return F.round(size / 1_000_000, 2)


def loadable(listing: DataFrame, formats: Sequence[str] = FORMATS) -> DataFrame:
    """Whether each file or directory can be loaded as a layer.

    Files can; directories can with a known suffix or when all direct children share one.
    """
    name = F.col("name")
    parent = F.regexp_replace(name, "/[^/]*$", "")
    alike = [F.bool_and(name.endswith(s)) for s in formats]
    children = listing.groupBy(parent.alias("name")).agg(
        F.array_contains(F.array(*alike), True).alias("__alike")
    )
    rows = listing.join(children, "name", "left")
    can = (
        (F.col("type") != "directory")
        | ends_with_any(name, formats)
        | F.coalesce(F.col("__alike"), F.lit(False))
    )
    return rows.select(
        "name", megabytes(F.col("size")).alias("mb"), can.alias("is_loadable")
    )


def layer_files(listing: DataFrame, layer: str) -> DataFrame:
    """Files of a layer: those below its path with its suffix, or the path itself."""
    if layer.startswith(("http://", "https://")):
        return listing.sparkSession.createDataFrame([(layer, 0)], "name string, size long")
    tail = layer.rstrip("/").rsplit("/", 1)[-1]
    suffix = "." + tail.rsplit(".", 1)[1] if "." in tail[1:] else ""
    files = listing.filter((F.col("type") == "file") & belongs_to(F.col("name"), layer))
    wanted = F.col("name").endswith(suffix) if suffix else F.col("name").rlike(r"\.[^/]*$")
    return files.filter(wanted | (F.col("name") == layer)).select("name", "size")


def schema_catalogue(layers: dict[str, DataFrame]) -> DataFrame:
    """(layer, column, type) of all layers, ``area`` always double."""
    spark = next(iter(layers.values())).sparkSession
    rows = [
        (name, f.name, "double" if f.name == "area" else f.dataType.simpleString())
        for name, df in layers.items()
        for f in df.schema.fields
    ]
    return spark.createDataFrame(rows, "layer string, column string, type string")


def schema_conflicts(catalogue: DataFrame, layer: str | None = None) -> DataFrame:
    """Columns with more than one type, over all layers or inside one."""
    rows = catalogue if layer is None else catalogue.filter(F.col("layer").startswith(layer))
    types = rows.groupBy("column").agg(F.sort_array(F.collect_set("type")).alias("types"))
    return types.filter(F.size("types") > 1)


def has_column(layers: dict[str, DataFrame], column: str) -> bool:
    return any(column in df.columns for df in layers.values())


def column_type(layers: dict[str, DataFrame], column: str) -> T.DataType:
    """The one type of a column; an error if no layer has it or types differ."""
    types = {
        f.dataType for df in layers.values() for f in df.schema.fields if f.name == column
    }
    if not types:
        raise ValueError(f"No column {column!r}")
    if len(types) > 1:
        raise ValueError(f"Several types for {column!r}: {sorted(map(str, types))}")
    return next(iter(types))
