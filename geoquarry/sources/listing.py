"""Listing of folders in tasks: one level, or level by level."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise

ENTRIES = "name string, size long, updated timestamp, type string"
_SCHEMA = pa.schema(
    [("name", pa.string()), ("size", pa.int64()), ("updated", pa.timestamp("us", "UTC")), ("type", pa.string())]
)


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it."""
    if "://" not in folder:
        return fs.LocalFileSystem(), folder.removeprefix("file:")
    scheme, rest = folder.split("://", 1)
    return fs.FileSystem.from_uri(f"{scheme}://{quote(rest, safe='/:@?&=%')}")


def _hidden(name: str) -> bool:
    """Names that Spark passes over when it lists a table."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _entries(folder: str, hidden: bool, missing_ok: bool) -> pa.RecordBatch:
    system, path = _open(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=missing_ok))
    rows = [i for i in found if i.is_file or i.type == fs.FileType.Directory]
    rows = [i for i in rows if hidden or not _hidden(i.base_name)]
    # Milliseconds, as in Spark's own listing.
    times = [None if i.mtime_ns is None or not i.is_file else i.mtime_ns // 1_000_000 * 1000 for i in rows]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([f"{folder.rstrip('/')}/{i.base_name}" for i in rows], pa.string()),
            pa.array([i.size if i.is_file else 0 for i in rows], pa.int64()),
            pa.array(times, pa.int64()).cast(pa.timestamp("us", "UTC")),
            pa.array(["file" if i.is_file else "directory" for i in rows], pa.string()),
        ],
        schema=_SCHEMA,
    )


def list_folders(folders: DataFrame, hidden: bool = False, missing_ok: bool = True) -> DataFrame:
    """``(name, size, updated, type)`` of what lies directly in each folder of ``folders(name)``.

    Each folder is one call to its file system, made by the task that holds its row; nothing below is
    looked at. Directories have size 0 and no time. Folders that have gone meanwhile have no entries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("name").to_pylist():
                yield _entries(folder, hidden, missing_ok)

    return folders.select("name").mapInArrow(run, ENTRIES)


def list_level(spark: SparkSession, path: str, hidden: bool = False) -> DataFrame:
    """What lies directly in one folder, by one call. A folder that isn't there is an error."""
    return list_folders(_one(spark, path), hidden, missing_ok=False)


def list_tree(
    spark: SparkSession, path: str, depth: int | None = None, folders_per_task: int = 256
) -> DataFrame:
    """All files and directories below a folder, to ``depth`` levels.

    Each level is listed in tasks of about ``folders_per_task`` folders and written to the scratch
    folder; the driver only learns how many folders the next level has.
    """
    levels = [materialise(list_level(spark, path), "level")]
    while depth is None or len(levels) < depth:
        folders = levels[-1].filter(F.col("type") == "directory").select("name")
        n = folders.count()
        if not n:
            break
        tasks = -(-n // folders_per_task)
        levels.append(materialise(list_folders(folders.repartition(tasks, "name")), "level"))
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found


def _one(spark: SparkSession, path: str) -> DataFrame:
    return spark.range(1, numPartitions=1).select(F.lit(path.rstrip("/") or "/").alias("name"))
