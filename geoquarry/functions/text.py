"""Path and text columns: stems, unique names, search terms."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def stem(path: Column) -> Column:
    """Last path part without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(file_name(path), r"(?<=[^/])\.[^./]+$", "")


def parent_stem(path: Column) -> Column:
    """``parent/stem`` of a path."""
    parent = F.regexp_extract(path, r"([^/]+)/+[^/]*/*$", 1)
    return F.concat(F.regexp_replace(parent, r"(?<=[^/])\.[^./]+$", ""), F.lit("/"), stem(path))


def path_prefixes(path: Column) -> Column:
    """All directories above a path, shortest first."""
    parts = F.split(path, "/")
    return F.filter(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
            lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
        ),
        lambda d: (d != "") & (d != path),
    )


def match_terms(column: Column, search: str | None, case_sensitive: bool = True) -> Column:
    """Substring search: ``,`` is AND, ``|`` is OR, blanks are dropped, no terms match all."""
    groups = [g.split("|") for g in (search or "").split(",") if g.strip()]
    if not groups:
        return F.lit(True)

    def all_of(text: Column) -> Column:
        return reduce(and_, [one_of(text, g) for g in groups])

    def one_of(text: Column, terms: list[str]) -> Column:
        wanted = [t.strip() for t in terms if t.strip()]
        hits = [text.contains(t if case_sensitive else t.lower()) for t in wanted]
        return reduce(or_, hits, F.lit(False))

    if case_sensitive:
        return all_of(column)
    # Inside exists() the text is lowered once for all terms.
    return F.coalesce(F.exists(F.array(F.lower(column)), all_of), F.lit(False))


def ends_with_any(column: Column, suffixes) -> Column:
    return reduce(or_, [column.endswith(s) for s in suffixes], F.lit(False))


def with_unique_stem(df: DataFrame, path: str, name: str) -> DataFrame:
    """Add the stem of each path, or ``parent/stem`` where several rows share the stem."""
    from ..operators.relational import join_stats

    stems = df.withColumn(name, stem(F.col(path)))
    repeated = (
        stems.groupBy(name).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1)
    )
    marked = join_stats(stems, repeated, [name])
    return marked.select(
        *[c for c in df.columns if c != name],
        F.when(F.col("__n") > 1, parent_stem(F.col(path))).otherwise(F.col(name)).alias(name),
    )


def file_path(path: Column, encoded: bool = True) -> Column:
    """A file's path as listings show it: no ``file:`` scheme, and blanks and letters as they are.

    Paths in row metadata are URL-encoded, those of a listing are not.
    """
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))) if encoded else path
    return F.regexp_replace(plain, "^file:/+", "/")
