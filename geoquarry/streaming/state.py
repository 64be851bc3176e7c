"""State of a layer that grows: rows, file statistics and column summaries, round by round."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import FILE_PATH
from ..operators.classify import MAX_BINS, breaks_from_bins, merge_bins, value_bins
from ..sources.listing import list_folders

#: Rounds after which the summaries of all rounds so far are written as one table.
ROUNDS_PER_MERGE = 64
ROUND = "__round"
SUMMARY = "column string, bin int, anchor double, n long, low double, high double, s double, q double"


class LayerState:
    """Tables of a layer below one folder.

    ``rows/__round=i``, ``files/__round=i`` and, last, ``bins/__round=i`` belong to round i of the
    stream. They are overwritten when a round is done again, so each file counts once whatever fails
    and is retried. ``merged/__round=i`` holds the summaries of all rounds up to i. What is read from
    the state is that of the complete rounds.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _write(self, df: DataFrame, table: str, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}/{ROUND}={number}")

    def _rounds(self, table: str, after: int = -1) -> list[int]:
        """Numbers of the complete rounds of a table."""
        number = F.regexp_extract("name", rf"/{ROUND}=([0-9]+)(?:/_SUCCESS)?$", 1)
        root = self.spark.range(1, numPartitions=1).select(F.lit(f"{self.path}/{table}").alias("name"))
        folders = list_folders(root).filter((number != "") & (F.expr("type = 'directory'")))
        later = folders.filter(number.cast("int") > after)
        done = list_folders(later, hidden=True).filter(F.col("name").endswith("/_SUCCESS"))
        return sorted(r["n"] for r in done.select(number.cast("int").alias("n")).collect())

    def add(self, rows: DataFrame, number: int, columns: Sequence[str]) -> None:
        """Write a round: its rows, then what they add to the statistics of files and columns."""
        self._write(rows, "rows", number)
        rows = self.spark.read.schema(rows.schema).parquet(f"{self.path}/rows/{ROUND}={number}")
        if FILE_PATH in rows.columns:
            sizes = [F.count(F.lit(1)).alias("n_rows")]
            sizes += [F.min(c).alias(c) for c in ("minx", "miny") if c in rows.columns]
            sizes += [F.max(c).alias(c) for c in ("maxx", "maxy") if c in rows.columns]
            self._write(rows.groupBy(FILE_PATH).agg(*sizes), "files", number)
        parts = [value_bins(rows, c).select(F.lit(c).alias("column"), "*") for c in columns]
        parts = parts or [self.spark.createDataFrame([], SUMMARY)]
        self._write(reduce(DataFrame.unionByName, parts).coalesce(1), "bins", number)
        if number and number % ROUNDS_PER_MERGE == 0:
            self._write(self._summaries()[0].coalesce(1), "merged", number)

    def _summaries(self) -> tuple[DataFrame, int]:
        """Merged summaries of all columns, and the last round that they hold."""
        merged = self._rounds("merged")
        start = merged[-1] if merged else -1
        rounds = self._rounds("bins", start)
        paths = [f"{self.path}/merged/{ROUND}={start}"] if merged else []
        paths += [f"{self.path}/bins/{ROUND}={n}" for n in rounds]
        if not paths:
            return self.spark.createDataFrame([], SUMMARY), -1
        return merge_bins(self.spark.read.schema(SUMMARY).parquet(*paths), "column"), max([start, *rounds])

    def last_round(self) -> int:
        """Number of the last complete round, -1 before the first."""
        return self._summaries()[1]

    def bins(self, column: str) -> DataFrame:
        """Summary of a column over all rounds."""
        return self._summaries()[0].filter(F.col("column") == column).drop("column")

    def _table(self, table: str, last: int) -> DataFrame:
        found = self.spark.read.parquet(f"{self.path}/{table}")
        return found.filter(F.col(ROUND) <= last).drop(ROUND)

    def rows(self) -> DataFrame:
        """Rows of all rounds."""
        return self._table("rows", self.last_round())

    def files(self) -> DataFrame:
        """Rows and bounds of each file read so far; a file is read in one round."""
        return self._table("files", self.last_round())

    def breaks(self, column: str, k: int = 5, max_bins: int = MAX_BINS) -> list[float]:
        """Natural breaks of all rows so far; only values near a break are read again."""
        summaries, last = self._summaries()
        bins = summaries.filter(F.col("column") == column).drop("column")
        if last < 0:
            return []
        return breaks_from_bins(bins, self._table("rows", last), column, k, max_bins)


def ingest_with_state(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    columns: Sequence[str] = (),
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    wait: bool = True,
) -> StreamingQuery:
    """Read all files not read yet and keep rows, file statistics and summaries of ``columns``.

    Statistics of files need the path column in the stream. A round that failed half-way is written
    again under its number, so the state is that of a batch over the same files.
    """

    def add(rows: DataFrame, number: int) -> None:
        LayerState(rows.sparkSession, target).add(prepare(rows) if prepare else rows, number, columns)

    query = (
        stream.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    if wait:
        query.awaitTermination()
    return query
