"""Building blocks shared by the operators: checked broadcasts, group statistics joins,
and row ranks that never bring one group together in one task."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 100_000
SALTS = 32
BLOCK_ROWS = 1 << 22
MAX_BLOCKS = 10_000
#: Rows of a task whose work on each is dear, and tasks at most.
SPREAD_ROWS = 4096
SPREAD_TASKS = 2048


def small_or_none(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """A local copy of ``df`` marked for broadcast if it has at most ``max_rows`` rows.

    The row count is checked by fetching at most ``max_rows + 1`` rows; a larger table
    gives ``None`` and stays distributed.
    """
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(table, df.schema))


def spread(df: DataFrame, rows: int = SPREAD_ROWS) -> DataFrame:
    """The rows dealt to tasks of about ``rows`` each, for work that is dear for every row.

    Spark cuts a scan by its bytes, so a small file of many rows is one task. The rows are counted.
    """
    tasks = min(-(-df.count() // rows), SPREAD_TASKS)
    return df.repartition(tasks) if tasks > 1 else df


def join_stats(
    df: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    salts: int = SALTS,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join one statistics row per key back to the rows of ``df``.

    A small ``stats`` is broadcast. Otherwise rows are salted and ``stats`` repeated once
    per salt, so a key that holds a large share of all rows is spread over ``salts`` tasks.
    """
    small = small_or_none(stats, max_rows)
    if small is not None:
        return df.join(small, list(keys), how)
    salted = df.withColumn("__salt", F.pmod(row_hash(df), F.lit(salts)).cast("int"))
    repeated = stats.withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return salted.join(repeated, [*keys, "__salt"], how).drop("__salt")


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns: the same for a row however often its task is run again."""
    return F.xxhash64(
        *[
            F.col(f"`{f.name}`")
            for f in df.schema.fields
            if f.dataType.typeName() not in ("map", "variant")
        ]
    )


def ranked(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    block: Column,
    name: str = "rank",
) -> DataFrame:
    """1-based row number in each ``by`` group, computed block by block.

    ``block`` must not decrease along ``order`` within a group. Rows are numbered inside
    (group, block) and shifted by the count of the blocks before, so one large group is
    spread over as many tasks as it has blocks.
    """
    blocked = df.withColumn("__block", block)
    counts = blocked.groupBy(*by, "__block").agg(F.count(F.lit(1)).alias("__n"))
    shift = F.sum("__n").over(
        Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(*by, "__block", F.coalesce(shift, F.lit(0)).alias("__shift"))
    keys = [*by, "__block"]
    small = small_or_none(offsets)
    joined = _null_safe_join(blocked, offsets if small is None else small, keys)
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return joined.withColumn(name, (F.col("__shift") + inside).cast("long")).drop(
        "__block", "__shift"
    )


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"__r_{key}"))
    return left.join(renamed, condition).drop(*[f"__r_{k}" for k in keys])


def integer_blocks(order: str, rows: int = BLOCK_ROWS) -> Column:
    """Blocks of consecutive integers, for orders such as a file's row index."""
    return F.floor(F.col(order) / F.lit(rows))


def quantiles(value: str, parts: int) -> Column:
    """Approximate inner quantiles that cut a column into ``parts`` of about equal size."""
    levels = json.dumps([i / parts for i in range(1, parts)])
    return F.percentile_approx(
        value, F.from_json(F.lit(levels), "array<double>"), F.lit(10 * parts)
    )


def with_quantile_blocks(df: DataFrame, order: str, name: str, tie: str) -> DataFrame:
    """Add blocks of about equal size along a numeric or time column, nulls first.

    There are as many blocks as keep each at a few million rows (256 to 10,000). ``tie`` is
    added as the second sort key. Values are put between quantiles as doubles, which keeps their
    order even where several exact ones fall on one double. Exact values that hold more than a
    block, and nulls, get blocks of their own, as many as their rows need, along ``tie``.
    """
    day = isinstance(df.schema[order].dataType, T.DateType)
    value = F.unix_date(order) if day else F.col(order)
    keyed = df.withColumn(tie, row_hash(df)).withColumn("__v", value.cast("double"))
    first = df.agg(
        F.count("*").alias("n"), F.count_if(F.col(order).isNull()).alias("nulls")
    ).first()
    blocks = min(max(first["n"] // BLOCK_ROWS, 256), MAX_BLOCKS)
    found = keyed.agg(quantiles("__v", blocks).alias("q")).first()["q"] or []
    edges = sorted(set(found))
    seen = Counter(found)
    limit = max(first["n"] // blocks, 1)
    hot: list = []
    most = first["nulls"]
    if many := [e for e in edges if seen[e] > 1]:
        counts = keyed.filter(F.col("__v").isin(*many)).groupBy(order).agg(F.count("*").alias("n"))
        # Each has more than 1/blocks of all rows, so there are fewer than blocks.
        large = counts.filter(F.col("n") > limit).select(F.col(order).alias("value"), "n").collect()
        hot = sorted(r["value"] for r in large)
        most = max([most, *(r["n"] for r in large)])
    bits = max(8, (2 * most // BLOCK_ROWS).bit_length())
    part = F.shiftrightunsigned(F.col(tie).bitwiseXOR(F.lit(-(1 << 63))), 64 - bits)
    if hot:
        kind = df.schema[order].dataType
        values = F.array(*[F.lit(v).cast(kind) for v in hot])
        below = F.size(F.filter(values, lambda v: v < F.col(order)))
        own = F.array_contains(values, F.col(order)).cast("int")
    else:
        below, own = F.lit(0), F.lit(0)
    place = (F.col(name).cast("long") * (len(hot) + 1) + below) * 2 + own
    position = F.when(F.col("__v").isNull(), part - (1 << bits)).otherwise(
        place * (1 << bits) + F.when(own == 1, part).otherwise(0)
    )
    bucketed = bucketize(keyed, "__v", edges, name)
    return bucketed.withColumn(name, position.cast("long")).drop("__v")


def bucketize(df: DataFrame, value: str, edges: Sequence[float], name: str) -> DataFrame:
    """Number of the sorted ``edges`` that are ``<= value`` (JVM binary search)."""
    finite = [e for e in edges if e == e and abs(e) != float("inf")]
    if not finite:
        return df.withColumn(name, F.lit(0))
    splits = [float("-inf"), *finite, float("inf")]
    out = Bucketizer(
        splits=splits, inputCol=value, outputCol=name, handleInvalid="keep"
    ).transform(df)
    return out.withColumn(name, F.col(name).cast("int"))
