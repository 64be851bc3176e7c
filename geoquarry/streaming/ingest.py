"""Incremental reading of a growing folder of files under a budget per round."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import FILE_PATH, GEOMETRY
from ..operators.prepare import prepare as prepare_rows

# Files or bytes read in one round.
FILES_PER_ROUND = 10
BYTES_PER_ROUND = 500_000_000


def stream_files(
    spark: SparkSession,
    path: str,
    schema,
    file_format: str = "parquet",
    max_files: int | None = None,
    max_bytes: int | None = BYTES_PER_ROUND,
    **options,
) -> DataFrame:
    """Files of a folder as a stream; each round stops at the file or the byte budget."""
    reader = spark.readStream.format(file_format).schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    elif max_bytes is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader.options(**options).load(path)


def stream_layer(
    spark: SparkSession, path: str, schema, crs=None, geometry: str = GEOMETRY, **budget
) -> DataFrame:
    """Parquet files with a geometry as a stream of prepared rows: area, bounds, WKB, path.

    Areas keep their decimals, since the rule for whole numbers needs a whole file.
    """
    files = stream_files(spark, path, schema, **budget)
    located = files.select(
        "*", F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias(FILE_PATH)
    )
    return prepare_rows(located, crs=crs, geometry=geometry, truncate=False)


def ingest(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    wait: bool = True,
) -> StreamingQuery:
    """Read all files not read yet, round by round, and append them to a parquet layer.

    The checkpoint remembers which files are done, so a later call or a restart after a lost
    node goes on where the last one stopped. ``prepare`` is applied per row set and must not
    need other rows (no classes, no exact samples).
    """
    rows = prepare(stream) if prepare else stream
    query = (
        rows.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    if wait:
        query.awaitTermination()
    return query
