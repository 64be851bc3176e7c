"""Stack tables with different columns and types, and small set operations on them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGERS = (T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType())


def common_type(types: Sequence[T.DataType]) -> T.DataType:
    """Smallest type that holds all: text wins, integers widen, mixed numbers are double."""
    distinct = [t for t in dict.fromkeys(types) if not isinstance(t, T.NullType)]
    if not distinct:
        return T.NullType()
    if len(distinct) == 1:
        return distinct[0]
    if all(t in _INTEGERS for t in distinct):
        return max(distinct, key=_INTEGERS.index)
    if all(isinstance(t, T.NumericType | T.BooleanType) for t in distinct):
        numbers = [t for t in distinct if isinstance(t, T.NumericType)]
        if all(t in _INTEGERS for t in numbers):
            return max(numbers, key=_INTEGERS.index)
        if all(isinstance(t, T.DecimalType) or t in _INTEGERS for t in numbers):
            scale = max(t.scale for t in numbers if isinstance(t, T.DecimalType))
            return T.DecimalType(38, scale)
        return T.DoubleType()
    if all(isinstance(t, T.DateType | T.TimestampType | T.TimestampNTZType) for t in distinct):
        return T.TimestampType() if T.TimestampType() in distinct else T.TimestampNTZType()
    if all(isinstance(t, T.AtomicType) for t in distinct):
        return T.BinaryType() if T.BinaryType() in distinct else T.StringType()
    raise ValueError(f"No common type for {distinct}")


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; absent columns are null and differing types are aligned first.

    Names that differ in capitals alone are an error where the session takes them for one.
    """
    types: dict[str, list[T.DataType]] = {}
    for df in frames:
        for field in df.schema.fields:
            types.setdefault(field.name, []).append(field.dataType)
    if frames and frames[0].sparkSession.conf.get("spark.sql.caseSensitive") != "true":
        spellings: dict[str, set[str]] = {}
        for name in types:
            spellings.setdefault(name.lower(), set()).add(name)
        if unclear := [sorted(s) for s in spellings.values() if len(s) > 1]:
            raise ValueError(f"Columns that differ in capitals alone, rename them first: {unclear}")
    target = {name: common_type(found) for name, found in types.items()}

    def align(df: DataFrame) -> DataFrame:
        return df.select(
            *[
                F.col(f"`{f.name}`")
                if f.dataType == target[f.name]
                else F.col(f"`{f.name}`").cast(target[f.name]).alias(f.name)
                for f in df.schema.fields
            ]
        )

    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [align(df) for df in frames]
    )


def first_per_key(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key, the first by ``order``; combined before the shuffle."""
    place = F.struct(order.isNull(), order)  # a key whose orders are all null keeps a row too
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), place)
    return df.groupBy(key).agg(row.alias("__row")).select("__row.*")


def replace_rows(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Drop the rows whose key is in ``new`` and add the new rows."""
    return df.join(new.select(key), key, "left_anti").unionByName(new)


def still_missing(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` whose key is not in ``present``."""
    return wanted.join(present.select(key), key, "left_anti")
