"""SQL over layers: each query sees its own layer as ``df`` and the others by short name.

Layers are bound as common table expressions in front of the query, so names are scoped to
the query and shadow nothing in the session.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from ..model import ADDED_COLUMNS, HIDDEN_COLUMNS, UNIQUE_ID


def mentions(text: str, name: str) -> bool:
    if re.fullmatch(r"\w+", name):
        return re.search(rf"(?<![\w.`]){re.escape(name)}(?!\w)|`{re.escape(name)}`", text) is not None
    return f"`{name}`" in text


def reads_table(text: str, name: str) -> bool:
    """Whether a query has ``name`` in a FROM or JOIN."""
    quoted = rf"`{re.escape(name)}`"
    table = rf"(?:{quoted}|{re.escape(name)}(?![\w.]))" if re.fullmatch(r"\w+", name) else quoted
    if re.search(rf"\b(?:from|join)\s+\(*\s*{table}", text, re.I):
        return True
    tail = re.split(r"\bfrom\b", text, maxsplit=1, flags=re.I)[-1]
    return re.search(rf",\s*{table}", tail, re.I) is not None


def run_sql(
    df: DataFrame,
    text: str,
    layers: Mapping[str, DataFrame] | None = None,
    keep_ids: bool = False,
) -> DataFrame:
    """Run SELECT text on a layer and the layers it names.

    A result that keeps the row id keeps the hidden columns too: they are added to the select
    list, or joined back by id where the query does not allow that. ``keep_ids`` adds the id
    itself to a flat select list. A joined layer without rows is an error; its first row is looked for
    while the plan is made.
    """
    from .filters import QueryError

    text = text.strip().rstrip(";")
    if not reads_table(text, "df"):
        raise QueryError(f"The table to be queried must be called df: {text}")
    bound = {"df": df}
    for name in layers or {}:
        if name != "df" and reads_table(text, name):
            other = layers[name]
            if other.isEmpty():
                raise QueryError(f"Layer {name!r} has no rows to join")
            bound[name] = _attributes(other, df, text, name)
    if keep_ids:
        text = _with_hidden_columns(df, text)
    result = _bind(df, text, bound)
    if UNIQUE_ID not in df.columns or UNIQUE_ID not in result.columns:
        return result
    lost = [c for c in HIDDEN_COLUMNS if c in df.columns and c not in result.columns]
    if not lost:
        return result
    try:
        widened = _bind(df, _with_hidden_columns(df, text), bound)
        if set(lost) <= set(widened.columns):
            return widened.select(*result.columns, *lost)
    except AnalysisException:
        pass
    return result.join(df.select(UNIQUE_ID, *lost), UNIQUE_ID, "left")


def _attributes(other: DataFrame, df: DataFrame, text: str, name: str) -> DataFrame:
    """A joined layer without the added columns ``df`` has too, unless the query names them
    as ``name.column``; so plain names mean the columns of ``df``."""
    def named(column: str) -> bool:
        return re.search(rf"{re.escape(name)}`?\.`?{column}\b", text, re.I) is not None

    return other.drop(*[c for c in ADDED_COLUMNS if c in df.columns and not named(c)])


def _bind(df: DataFrame, text: str, bound: Mapping[str, DataFrame]) -> DataFrame:
    slots = {f"layer_{i}": table for i, table in enumerate(bound.values())}
    ctes = ", ".join(
        f"`{name}` AS (SELECT * FROM {{{slot}}})" for name, slot in zip(bound, slots, strict=True)
    )
    body = text.replace("{", "{{").replace("}", "}}")
    if re.match(r"with\b", body, re.I):
        body = f"SELECT * FROM ({body})"
    return df.sparkSession.sql(f"WITH {ctes} {body}", **slots)


def _with_hidden_columns(df: DataFrame, text: str) -> str:
    """Put the added columns a flat select list does not name in front of it."""
    match = re.match(r"\s*select\s+(distinct\s+)?", text, re.I)
    if not match:
        return text
    listed = _select_list(text[match.end() :])
    if any(re.fullmatch(r"\s*(?:(?:`[^`]+`|\w+)\s*\.\s*)*\*.*", item, re.S) for item in listed):
        return text
    listed = ", ".join(listed)
    added = [f"df.`{c}`" for c in ADDED_COLUMNS if c in df.columns and not mentions(listed, c)]
    return text[: match.end()] + "".join(f"{c}, " for c in added) + text[match.end() :]


def _select_list(text: str) -> list[str]:
    """Items of a select list: up to the first FROM, by commas, both outside of brackets and texts."""
    items, depth, start = [], 0, 0
    for part in re.finditer(r"'(?:[^'\\]|''|\\.)*'|\"[^\"]*\"|`[^`]*`|[(),]|\bfrom\b", text, re.I):
        token = part[0].lower()
        depth += (token == "(") - (token == ")")
        if depth == 0 and token in (",", "from"):
            items.append(text[start : part.start()])
            start = part.end()
            if token == "from":
                return items
    return [*items, text[start:]]


def join_using(df: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """``other.*, df.*`` of an inner join on one shared column, without repeated columns."""
    extra = [c for c in other.columns if c not in df.columns]
    return df.join(other.select(column, *extra), column, "inner")


def with_totals(df: DataFrame, **totals) -> DataFrame:
    """Add table-wide aggregates to every row as scalar subqueries, so no row is shuffled."""
    return df.withColumns(
        {
            name: df.agg(expression.alias(name)).scalar()
            for name, expression in totals.items()
        }
    )
