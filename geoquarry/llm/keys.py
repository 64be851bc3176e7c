"""A bounded filter over keys, so that only rows which may have a partner are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: Bits a key has at first, and bits of the largest filter: a million rows of 64, which are broadcast.
SPREAD = 32
LARGEST = 1 << 26


def filter_words(hashes: DataFrame) -> tuple[DataFrame, int]:
    """``(word, bits)``: words of 64 bits with one bit set for each of ``hashes(hash)``; and all bits.

    The filter grows with the keys up to ``LARGEST`` bits. Beyond that more rows pass that have no
    partner, at last all: they cost a shuffle, never a result.
    """
    wanted = SPREAD * max(hashes.count(), 1)
    bits = min(1 << max((wanted - 1).bit_length(), 12), LARGEST)
    place = hashes.select(F.col("hash").bitwiseAND(F.lit(bits - 1)).alias("place"))
    words = place.groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(place & 63 AS int)))").alias("bits")
    )
    return materialise(words, "filter"), bits


def parted(docs: DataFrame, key: Column, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` whose key is surely not among ``hashes(hash)``, and the others.

    ``key`` is a hash of the row, over columns that are qualified by ``d``.
    """
    words, bits = filter_words(hashes)
    place = key.bitwiseAND(F.lit(bits - 1))
    word = F.coalesce(F.col("f.bits"), F.lit(0).cast("long"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    held = word.bitwiseAND(mask) != 0
    joined = docs.alias("d").join(
        F.broadcast(words).alias("f"), F.shiftright(place, 6) == F.col("f.word"), "left"
    )
    return joined.where(~held).select("d.*"), joined.where(held).select("d.*")
