"""Exact samples of at most n rows per layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relational import join_stats, row_hash

_DIGITS = 13
_STEPS = 8
#: Layers whose limits are put into the plan as they are; more are joined.
_LITERALS = 50
_SPREAD = 4096


def sample_per_layer(df: DataFrame, layer: str, key: str, n: int = 10_000, seed: int = 0) -> DataFrame:
    """Keep ``min(n, rows)`` rows of each layer, the first ones by ``md5(seed|key)``.

    A null key is replaced by a hash of the row, which breaks ties too. A histogram of the hash in
    buckets that shrink towards its low end finds the bucket in which a layer has its n-th row. Rows
    of buckets before it are kept as they are, those behind it dropped; only that bucket is ranked.
    Layers of n rows or fewer are not touched.
    """
    own = F.coalesce(F.col(key).cast("string"), row_hash(df).cast("string"))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), own))
    head = F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") + 1
    bucket = F.ceil(F.log2(head) * _STEPS).cast("int")
    counts = (
        df.select(layer, bucket.alias("__bucket"))
        .groupBy(layer, "__bucket")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    order = Window.partitionBy(layer).orderBy("__bucket")
    up_to = F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = (
        counts.withColumn("__up_to", up_to)
        .filter((F.col("__up_to") >= n) & (F.col("__up_to") - F.col("__n") < n))
        .select(layer, F.col("__bucket").alias("__cut"), (n - F.col("__up_to") + F.col("__n")).alias("__left"))
    )
    cuts = cut.limit(_LITERALS + 1).collect()
    if not cuts:
        return df
    marked = df.withColumns({"__md5": digest, "__bucket": bucket})
    if len(cuts) <= _LITERALS:
        same = [(F.col(layer).eqNullSafe(F.lit(r[layer])), r) for r in cuts]
        near = marked.withColumns(
            {c: F.coalesce(*[F.when(m, F.lit(r[c])) for m, r in same]) for c in ("__cut", "__left")}
        )
    else:
        near = join_stats(marked, cut, [layer])
    near = near.filter(F.col("__cut").isNull() | (F.col("__bucket") <= F.col("__cut")))
    edge = F.coalesce(F.col("__bucket") == F.col("__cut"), F.lit(False))
    # Rows that need no rank are spread, so that only the bucket of the n-th row is together.
    spread = F.when(edge, -1).otherwise(F.pmod(row_hash(df), F.lit(_SPREAD)))
    rank = F.row_number().over(
        Window.partitionBy(layer, "__spread").orderBy("__md5", key, "__row")
    )
    ranked = near.withColumns({"__spread": spread, "__row": row_hash(df)}).withColumn("__rank", rank)
    return ranked.filter((F.col("__spread") >= 0) | (F.col("__rank") <= F.col("__left"))).select(
        *[F.col(f"`{c}`") for c in df.columns]
    )


def hidden_rows(df: DataFrame, layer: str, n: int | None = 10_000) -> DataFrame:
    """Rows per layer and whether the sample leaves some out."""
    counts = df.groupBy(layer).agg(F.count(F.lit(1)).alias("n_rows"))
    hidden = F.lit(False) if n is None else F.col("n_rows") > n
    return counts.withColumn("rows_are_hidden", hidden)
