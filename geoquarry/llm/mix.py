"""Mixing sources to target weights: repetition rates by source, copies by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

#: Weights of the sources in code point order, nulls last, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the whole mix for each word of the input.
SHARE = 1.5
#: Copies of a document at most, and so words of a target for each word of its source.
MOST = 2
SEED = "mix"


def word_count(text: Column) -> Column:
    """Runs of characters other than space and 0x09 to 0x0D."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"))


def targets(
    sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, source_size)``, one row a source.

    Weights are dealt to the sources in code point order, null last. Every target is its weight
    times one level, or ``most`` times its source's size if that is less; the level makes them add
    up to ``share`` of all sizes. That is where sharing the excess again and again ends. Sources
    are ordered by the level at which they are full: with the first k of them full, the level is
    what is left of the total over what is left of the weights. A source without words has target
    0. This is a window over one row a source, the smallest table that has the answer.
    """
    deal = F.array(*[F.lit(float(w)) for w in weights])
    order = Window.orderBy(F.col("source").isNull(), "source")
    full = Window.orderBy("full_at", F.col("source").isNull(), "source")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    weighed = sizes.withColumn(
        "weight", F.element_at(deal, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ).withColumn("full_at", most * F.col("source_size") / F.col("weight"))
    levels = weighed.select(
        "*",
        (
            (
                share * F.sum("source_size").over(all_rows)
                - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))
            )
            / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        ).alias("level"),
    )
    # The first source that is not full at its level ends the full ones, and gives the level.
    level = F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "level"))).over(all_rows)
    return levels.select("*", level["level"].alias("at")).select(
        "source",
        "source_size",
        F.coalesce(
            F.least(most * F.col("source_size").cast("double"), F.col("weight") * F.col("at")),
            most * F.col("source_size").cast("double"),
        ).alias("target"),
    )


def draw(seed: str = SEED) -> Column:
    """A number in [0, 1) from a hash of the seed, the id and the text of a row."""
    text = F.concat_ws(
        "|",
        F.lit(seed),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
        F.coalesce(F.col("text").cast("string"), F.lit("")),
    )
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def plan_mix(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: str = SEED,
) -> DataFrame:
    """``(doc_id, source, key, size, source_size, target, copies)`` for each row of ``docs``.

    ``docs(doc_id, text, source)``. A source's rate is its target over its size. A document gets
    floor(rate) copies, and one more with the probability of the rest, by a hash of the seed, its
    id and its text, so reruns agree. Rows equal in id and text are drawn alike. Null texts are
    empty, null sources are one source; a source without words has rate 0. ``key`` is a hash of
    the text. Rows of a large source are summed before they are shuffled, and the table of sources
    has a row for each, so a join with it can be split.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.xxhash64(text).alias("key"),
            word_count(F.col("text")).cast("long").alias("size"),
            draw(seed).alias("draw"),
        ),
        "sized",
    )
    # Written, so that Spark knows its size before it plans the join.
    by_source = materialise(
        targets(
            sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most
        ).withColumnRenamed("source", "of"),
        "targets",
    )
    rate = F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0))
    copies = F.floor(rate) + (F.col("draw") < rate - F.floor(rate)).cast("long")
    return sized.join(by_source, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "key", "size", "source_size", "target", copies.alias("copies")
    )


def mix(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: str = SEED,
) -> DataFrame:
    """The documents of the mix with all their columns, each as often as ``plan_mix`` has it.

    Rates depend on the sources alone, so rows are repeated where they are read; only the table of
    sources is joined with them.
    """
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(
        F.sum(word_count(F.col("text"))).cast("long").alias("source_size")
    )
    rates = materialise(
        targets(sizes, weights, share, most).select(
            F.col("source").alias("mix_of"),
            F.col("source_size").alias("mix_size"),
            F.col("target").alias("mix_target"),
        ),
        "targets",
    )
    rate = F.coalesce(
        F.col("mix_target") / F.when(F.col("mix_size") > 0, F.col("mix_size")), F.lit(0.0)
    )
    copies = F.floor(rate) + (draw(seed) < rate - F.floor(rate)).cast("long")
    joined = docs.join(rates, docs.source.cast("string").eqNullSafe(F.col("mix_of")))
    each = F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias("mix_copy")
    return joined.select(*[docs[f"`{c}`"] for c in docs.columns], each).drop("mix_copy")
