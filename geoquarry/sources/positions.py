"""Row positions in text files, which report none: blocks of a file are counted, rows placed in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import file_path
from ..model import FILE_PATH, ROW_INDEX
from ..operators.relational import join_stats
from ..session import materialise

#: Where a block of a file begins, and a number that grows along the rows of a task.
BLOCK = "__block_start"
_AT = "__at"


def in_blocks(df: DataFrame) -> DataFrame:
    """Rows as a file source reads them, with their file, block and a number in their task."""
    kept = [c for c in df.columns if c not in (FILE_PATH, BLOCK, _AT)]
    return df.select(
        *[F.col(f"`{c}`") for c in kept],
        file_path(F.col("_metadata.file_path")).alias(FILE_PATH),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(_AT),
    )


def with_positions(df: DataFrame, name: str = ROW_INDEX) -> DataFrame:
    """Rows of a file source with their file and their position in it, from 0, in file order.

    ``df`` is a plain read of text files: CSV, JSON, XML or lines. Spark reads a file in blocks, each
    by one task from its first row to its last. A first pass counts the rows of each block; sums over
    the blocks before give its first position, and a row is placed by its number in the task. No row
    is shuffled or sorted: only counts of blocks are, and a large file has as many blocks as splits.

    Both passes must cut files alike, so the columns are read as they are in either one, and the cut
    depends on the files and the session's settings alone. Rows of a file with a broken cut (see
    ``cut_alike``) raise an error.
    """
    rows = in_blocks(df)
    blocks = materialise(
        rows.groupBy(FILE_PATH, BLOCK).agg(
            F.count(F.lit(1)).alias("__rows"), F.min(_AT).alias("__first"), F.max(_AT).alias("__last")
        ),
        "blocks",
    )
    before = Window.partitionBy(FILE_PATH).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        FILE_PATH, BLOCK, "__first", "__last",
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"),
        cut_alike().alias("__whole"),
    )
    joined = join_stats(rows, offsets, [FILE_PATH, BLOCK])
    inside = F.col("__whole") & F.col(_AT).between(F.col("__first"), F.col("__last"))
    place = F.col("__offset") + F.col(_AT) - F.col("__first")
    checked = F.when(F.coalesce(inside, F.lit(False)), place).otherwise(
        F.raise_error(F.lit("The blocks of a file were cut in another way when they were counted.")).cast("long")
    )
    kept = [c for c in rows.columns if c not in (BLOCK, _AT, name)]
    return joined.select(*[F.col(f"`{c}`") for c in kept], checked.alias(name))


def cut_alike():
    """Whether the rows of a block follow each other in one task."""
    return F.col("__last") - F.col("__first") + 1 == F.col("__rows")
