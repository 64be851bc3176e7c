"""Statistics of layers, query suggestions and join keys between layers."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import ADDED_COLUMNS, AREA, BOUNDS_COLUMNS, FILE_PATH, HIDDEN_COLUMNS, is_missing, without_nan

SUGGESTION_SCHEMA = "column string, rule string, value string, n_rows long, query string"


def rows_per(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


def buffer_hint(df: DataFrame, zoom: float = 0) -> DataFrame:
    """Largest area, and whether features are too small to see below zoom 11."""
    top = F.max(AREA)
    small = (top > 0) & (top < 10_000) & F.lit(zoom < 11)
    return df.agg(top.alias("max_area"), small.alias("buffer_hint"))


def column_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per numeric column: rows, missing, mean, min, max; a single pass."""
    aggregates = []
    for c in columns:
        value = without_nan(df, c).cast("double")
        aggregates += [
            F.struct(
                F.lit(c).alias("column"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count(F.when(is_missing(df, c), 1)).alias("n_missing"),
                F.avg(value).alias("mean"),
                F.min(value).alias("min"),
                F.max(value).alias("max"),
            )
        ]
    return df.agg(F.array(*aggregates).alias("s")).select(F.inline("s"))


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-missing values of each column, exact by default."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(without_nan(df, c)).alias(c) for c in columns])


def value_frequencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) of several columns as text, counted in one shuffle."""
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                without_nan(df, c).cast("string").alias("value"),
            )
            for c in columns
        ]
    )
    long = df.select(F.inline(cells)).filter(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value of each column (the smallest of equals) and how many values it has.

    Values are counted first, so no task ever holds the value table of a column.
    """
    return (
        value_frequencies(df, columns)
        .groupBy("column")
        .agg(
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"),
            F.max("n").alias("mode_rows"),
            F.count(F.lit(1)).alias("n_distinct"),
        )
    )


def total_bounds(df: DataFrame, *keys: str) -> DataFrame:
    """Bounds of a whole layer and their centre."""
    grouped = df.groupBy(*keys).agg(
        F.min("minx").alias("minx"), F.min("miny").alias("miny"),
        F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"),
    )
    return grouped.withColumns(
        {
            "center_x": (F.col("minx") + F.col("maxx")) / 2,
            "center_y": (F.col("miny") + F.col("maxy")) / 2,
        }
    )


def missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: any missing (null or NaN) value, any null."""
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.coalesce(F.bool_or(is_missing(df, c)), F.lit(False)).alias("any_missing"),
            F.coalesce(F.bool_or(F.col(f"`{c}`").isNull()), F.lit(False)).alias("any_null"),
        )
        for c in columns
    ]
    return df.agg(F.array(*cells).alias("s")).select(F.inline("s"))


def extremes(df: DataFrame, column: str) -> DataFrame:
    value = without_nan(df, column)
    return df.agg(F.min(value).alias("lowest"), F.max(value).alias("highest"))


def drop_all_null(df: DataFrame) -> DataFrame:
    """Drop the columns that hold no value at all."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if counts[c] == 0])


def layer_sizes(files: DataFrame, layer: str = "layer", size: str = "size") -> DataFrame:
    """Summed file size per layer, and whether queries on it will be heavy."""
    total = files.groupBy(layer).agg(F.sum(size).alias("total_size"))
    return total.withColumn("is_large", F.col("total_size") > 100_000_000)


def exceeds_table_budget(df: DataFrame, query: str = "", budget: int = 1_000_000) -> bool:
    """Whether rows x columns is more than a table view may hold; a LIMIT query may always.

    Stops reading once the budget is passed.
    """
    if " limit " in (query or "").lower():
        return False
    rows = budget // max(len(df.columns), 1)
    return df.limit(rows + 1).count() > rows


_PLAIN_NAME = "^[A-Za-z_][A-Za-z0-9_]*$"


def quoted(name: str) -> str:
    """A name as SQL text, in backticks where it isn't a plain one."""
    return name if re.match(_PLAIN_NAME, name) else f"`{name.replace('`', '``')}`"


def _quoted_column(column: str) -> Column:
    name = F.col(column)
    tick = F.lit("`")
    inside = F.replace(name, tick, F.lit("``"))
    return F.when(name.rlike(_PLAIN_NAME), name).otherwise(F.concat(tick, inside, tick))


def _quote(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def suggest_queries(df: DataFrame) -> DataFrame:
    """Example queries of a layer: large areas first, values above the mean, the commonest text.

    Columns are taken by name. Columns with fewer than two values and queries without rows are
    left out; queries with over 100,000 rows get a LIMIT.
    """
    spark = df.sparkSession
    shown = sorted(
        f.name
        for f in df.schema.fields
        if f.name not in HIDDEN_COLUMNS
        and not f.name.startswith("_")
        and not isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType | T.BinaryType)
    )
    numeric = [c for c in shown if isinstance(df.schema[c].dataType, T.NumericType)]
    others = [c for c in shown if c not in numeric]
    stats = {r["column"]: r for r in column_statistics(df, numeric).collect()} if numeric else {}
    means = {c: s["mean"] for c, s in stats.items() if s["mean"] is not None}
    above = (
        df.agg(
            *[
                F.count(F.when(without_nan(df, c) > F.lit(m), 1)).alias(c)
                for c, m in means.items()
            ]
        ).first()
        if means
        else {}
    )
    common = {r["column"]: r for r in modes(df, others).collect()} if others else {}

    def limited(query: str, rows: int) -> str:
        return f"{query} LIMIT 100000" if rows > 100_000 else query

    rest = [c for c in shown if c != AREA][:3]
    area = stats.get(AREA)
    if area is not None and area["mean"] is not None and area["mean"] > area["min"]:
        where = f"WHERE area > {area['mean']} ORDER BY area DESC "
        rows = [("area", "default", str(area["mean"]), int(above[AREA]),
                 f"SELECT {', '.join(['area', *map(quoted, rest)])} FROM df {where}LIMIT 10000")]
    else:
        n = next(iter(stats.values()))["n_rows"] if stats else None
        rows = [(None, "default", None, n, f"SELECT {', '.join(map(quoted, rest)) or '*'} FROM df LIMIT 10000")]
    for c in shown:
        picked = ", ".join(map(quoted, [c, *[o for o in shown if o != c][:3]]))
        if c in means and stats[c]["min"] < stats[c]["max"] and above[c]:
            query = f"SELECT {picked} FROM df WHERE {quoted(c)} > {means[c]} ORDER BY {quoted(c)} DESC"
            rows.append((c, "above mean", str(means[c]), int(above[c]), limited(query, above[c])))
        elif c in common and common[c]["n_distinct"] > 1:
            m = common[c]
            query = f"SELECT {picked} FROM df WHERE {quoted(c)} = {_quote(m['mode'])}"
            rows.append((c, "mode", m["mode"], int(m["mode_rows"]), limited(query, m["mode_rows"])))
    return spark.createDataFrame(rows, SUGGESTION_SCHEMA)


def profile_layer(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Statistics of numeric columns with the number of rows above the mean."""
    stats = column_statistics(df, columns)
    means = {r["column"]: r["mean"] for r in stats.collect() if r["mean"] is not None}
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(F.when(without_nan(df, c) > F.lit(m), 1)).alias("n_above_mean"),
        )
        for c, m in means.items()
    ]
    if not cells:
        return stats.withColumn("n_above_mean", F.lit(0).cast("long"))
    above = df.agg(F.array(*cells).alias("s")).select(F.inline("s"))
    return stats.join(F.broadcast(above), "column", "left")


def shared_key_columns(layers: Mapping[str, DataFrame]) -> list[tuple[str, str, str]]:
    """(layer, other, column) where both share a non-float column of one type and the other
    layer has columns to add."""
    floats = (T.FloatType, T.DoubleType)
    found = []
    for left, right in permutations(layers, 2):
        a, b = layers[left].schema, layers[right].schema
        if not set(b.names) - set(a.names):
            continue
        b_types = {f.name: f.dataType for f in b.fields}
        for f in a.fields:
            if f.name in ADDED_COLUMNS or f.name.startswith("__") or f.name not in b_types:
                continue
            kinds = (f.dataType, b_types[f.name])
            integers = all(isinstance(t, T.IntegralType) for t in kinds)
            if any(isinstance(t, floats) or not isinstance(t, T.AtomicType) for t in kinds):
                continue
            if integers or kinds[0] == kinds[1]:
                found.append((left, right, f.name))
    return found


JOIN_SCHEMA = (
    "left string, right string, column string, n_common_keys long, "
    "n_joined decimal(38,0), query string"
)


def join_keys(layers: Mapping[str, DataFrame]) -> DataFrame:
    """Columns an inner join with another layer would find rows on, with the number of common
    keys and of joined rows, and the query.

    All layers are counted by (column, value) in one shuffle with counts per layer side by
    side; the rows of a join are the sum of their products, so nothing is joined.
    """
    suggested = shared_key_columns(layers)
    names = list(layers)
    spark = next(iter(layers.values())).sparkSession
    if not suggested:
        return spark.createDataFrame([], JOIN_SCHEMA)
    wanted = {n: sorted({c for a, b, c in suggested if n in (a, b)}) for n in names}
    long = None
    for i, name in enumerate(names):
        if not wanted[name]:
            continue
        cells = [
            F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value"))
            for c in wanted[name]
            if c in layers[name].columns
        ]
        part = layers[name].select(F.inline(F.array(*cells))).select(
            "column", "value", F.lit(i).alias("layer")
        )
        long = part if long is None else long.unionByName(part)
    counts = (
        long.filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(*[F.count(F.when(F.col("layer") == i, 1)).alias(f"n{i}") for i in range(len(names))])
    )
    index = {n: i for i, n in enumerate(names)}
    sums = []
    for i, j in sorted({tuple(sorted((index[a], index[b]))) for a, b, _ in suggested}):
        a, b = F.col(f"n{i}"), F.col(f"n{j}")
        product = a.cast("decimal(19,0)") * b.cast("decimal(19,0)")
        sums += [
            F.count(F.when((a > 0) & (b > 0), 1)).alias(f"c{i}_{j}"),
            F.sum(product).cast("decimal(38,0)").alias(f"r{i}_{j}"),
        ]
    cells, valid = [], F.lit(False)
    for left, right in dict.fromkeys((a, b) for a, b, _ in suggested):
        i, j = sorted((index[left], index[right]))
        extra = [f"{quoted(right)}.{quoted(c)}" for c in layers[right].columns if c not in layers[left].columns]
        text = f"SELECT {', '.join(extra)}, df.* FROM df INNER JOIN {quoted(right)} USING ("
        cells.append(
            F.struct(
                F.lit(left).alias("left"),
                F.lit(right).alias("right"),
                F.col(f"c{i}_{j}").alias("n_common_keys"),
                F.col(f"r{i}_{j}").alias("n_joined"),
                F.concat(F.lit(text), _quoted_column("column"), F.lit(")")).alias("query"),
            )
        )
        columns = [c for a, b, c in suggested if (a, b) == (left, right)]
        valid = valid | (
            (F.col("left") == left) & (F.col("right") == right) & F.col("column").isin(*columns)
        )
    table = counts.groupBy("column").agg(*sums).select("column", F.inline(F.array(*cells)))
    return table.filter(valid & (F.col("n_common_keys") > 0)).select(
        "left", "right", "column", "n_common_keys", "n_joined", "query"
    )


def file_statistics(df: DataFrame, path: str = FILE_PATH) -> DataFrame:
    """Rows and bounding box of every file of a prepared layer."""
    return df.groupBy(path).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[(F.min if c.startswith("min") else F.max)(c).alias(c) for c in BOUNDS_COLUMNS],
    )
