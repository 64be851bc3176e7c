"""Row filters of a layer: viewport, expressions, text, functions, lookups."""

from __future__ import annotations

import inspect
import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import FILE_PATH, HIDDEN_COLUMNS, UNIQUE_ID, Bounds, Query


class QueryError(ValueError):
    """A layer query that cannot be applied."""


def in_bounds(bounds, keep_null: bool = True) -> Column:
    """Closed overlap with the viewport; rows without bounds pass too."""
    b = Bounds.parse(bounds)
    inside = (
        (F.col("minx") <= b.maxx)
        & (F.col("maxx") >= b.minx)
        & (F.col("miny") <= b.maxy)
        & (F.col("maxy") >= b.miny)
    )
    return inside | F.col("minx").isNull() if keep_null else inside


def filter_bounds(df: DataFrame, bounds) -> DataFrame:
    """Rows in the viewport; a table without bounds columns has no place and stays whole."""
    return df.filter(in_bounds(bounds)) if "minx" in df.columns else df


def is_select(query) -> bool:
    return isinstance(query, str) and re.match(r"\s*(select|with)\b", query, re.I) is not None


_TEXT = r"'(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\"\"|\\.)*\""
_OPERAND = rf"(?:{_TEXT}|(?:`[^`]+`|[^\W\d]\w*)(?:\.(?:`[^`]+`|[^\W\d]\w*))*(?![\w(])|-?\d+(?:\.\d+)?)"
# A comparison, or else a text, so that what texts hold is passed over.
_NOT_EQUAL = re.compile(rf"({_OPERAND})\s*(?:!=|<>)\s*({_OPERAND})|{_TEXT}|`[^`]+`")


def _null_safe(match: re.Match) -> str:
    return f"NOT ({match[1]} <=> {match[2]})" if match[1] else match[0]


def text_predicate(df: DataFrame, text: str, null_safe: bool = False) -> DataFrame:
    """Filter by SQL condition text. With ``null_safe``, ``x != value`` keeps null rows."""
    if null_safe:
        text = _NOT_EQUAL.sub(_null_safe, text)
    return df.where(text)


def semi_by_id(df: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of ``df`` whose id is left in ``kept``."""
    return df.join(kept.select(UNIQUE_ID), UNIQUE_ID, "left_semi")


def _call(function, df: DataFrame, layers: Mapping[str, DataFrame]):
    parameters = inspect.signature(function).parameters.values()
    positional = [p for p in parameters if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]
    required = [p for p in positional if p.default is p.empty]
    return function(df, layers) if len(required) >= 2 else function(df)


def apply_query(
    df: DataFrame,
    query: Query,
    layers: Mapping[str, DataFrame] | None = None,
    null_safe: bool = False,
    keep_rows_only: bool = False,
) -> DataFrame:
    """Apply one layer query of any kind.

    SELECT text runs as SQL with the layer as ``df``; other text is a condition. A Column or a
    sequence of them filters. A function of the table (or of the table and a mapping of the
    other layers) gives a condition or a table; a table must keep the row id, and with
    ``keep_rows_only`` only decides which of the original rows are kept.
    """
    from .layer_sql import run_sql

    layers = layers or {}
    if query is None or (isinstance(query, str) and not query.strip()):
        return df
    if is_select(query):
        return run_sql(df, query, layers)
    if isinstance(query, str):
        return text_predicate(df, query, null_safe)
    if isinstance(query, Column):
        return df.filter(query)
    if callable(query):
        result = _call(query, df, layers)
        if isinstance(result, Column):
            return df.filter(result)
        if isinstance(result, DataFrame):
            if UNIQUE_ID in df.columns and UNIQUE_ID not in result.columns:
                raise QueryError(f"A layer function must keep the column {UNIQUE_ID}")
            return semi_by_id(df, result) if keep_rows_only else result
        raise QueryError(f"A layer function gave {type(result).__name__}, not a column or table")
    if isinstance(query, Sequence) and all(isinstance(q, Column) for q in query):
        return df.filter(reduce(and_, query)) if query else df
    raise QueryError(f"Cannot use {type(query).__name__} as a layer query")


def try_query(
    df: DataFrame, query: Query, layers: Mapping[str, DataFrame] | None = None, **options
) -> tuple[DataFrame, str | None]:
    """The filtered table, or the table as it was and a message when the query is invalid.

    Only errors found while the plan is made can be passed over, not errors of single rows.
    """
    try:
        return apply_query(df, query, layers, **options), None
    except (AnalysisException, QueryError, KeyError, TypeError) as error:
        return df, f"Query failed ({type(error).__name__}: {error})"


def rows_of_layer(df: DataFrame, layer: str) -> DataFrame:
    """Rows of a union that come from one layer: its file or any file below it."""
    path = F.col(FILE_PATH)
    return df.filter((path == layer) | path.startswith(layer.rstrip("/") + "/"))


def belongs_to(path: Column, layer: str, strict: bool = True) -> Column:
    """Whether a file is part of a layer: at or below its path, or (not ``strict``) when all
    parts of the layer's path occur among the file's parts."""
    if strict:
        return (path == layer) | path.startswith(layer.rstrip("/") + "/")
    wanted = F.array(*[F.lit(p) for p in layer.split("/") if p])
    return F.size(F.array_except(wanted, F.split(path, "/"))) == 0


def lookup(df: DataFrame, unique_id: str, hidden: bool = False) -> DataFrame:
    """The row of one id, without the hidden columns."""
    found = df.filter(F.col(UNIQUE_ID) == unique_id)
    if hidden:
        return found
    return found.drop(*[c for c in HIDDEN_COLUMNS if c != UNIQUE_ID]).withColumnRenamed(UNIQUE_ID, "id")
