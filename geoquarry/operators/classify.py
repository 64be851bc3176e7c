"""Values into classes and colours: natural breaks, ramps, categories."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import colors
from ..model import is_missing, without_nan
from ..session import materialise
from .relational import bucketize

MAX_BINS = 1000
#: Bins of :func:`value_bins` for a factor of e, 128 for a factor of two; their numbers start beyond
#: those of the smallest double.
BINS_PER_LOG = 128 / math.log(2)
BIN_OFFSET = 1 << 18
CLASS, COLOR = "_class", "_color"
LEGEND_SCHEMA = "class_idx int, lower double, upper double, label string, color string"


@dataclass
class _Bins:
    """Sums per bin of sorted values; values are taken relative to ``shift``.

    ``open`` is 0 for bins that no optimal break can cut.
    """

    low: np.ndarray
    high: np.ndarray
    n: np.ndarray
    total: np.ndarray
    squares: np.ndarray
    open: np.ndarray

    def __len__(self) -> int:
        return len(self.n)

    def take(self, index) -> _Bins:
        return _Bins(*(getattr(self, f)[index] for f in self.__dataclass_fields__))

    def merge(self, starts: np.ndarray) -> _Bins:
        """Join each run of bins that begins at ``starts``."""
        ends = np.append(starts[1:], len(self)) - 1
        sums = [np.add.reduceat(v, starts) for v in (self.n, self.total, self.squares, self.open)]
        return _Bins(self.low[starts], self.high[ends], *sums)


def _concat(a: _Bins, b: _Bins) -> _Bins:
    joined = _Bins(
        *(np.concatenate([getattr(a, f), getattr(b, f)]) for f in a.__dataclass_fields__)
    )
    return joined.take(np.argsort(joined.low, kind="stable"))


def _best_costs(bins: _Bins, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest cost of the first j bins in m classes, and where the last class begins."""
    n, s, q = (
        np.concatenate([[0.0], np.cumsum(v)]) for v in (bins.n, bins.total, bins.squares)
    )
    size = len(bins)
    best = np.full((k + 1, size + 1), np.inf)
    begin = np.zeros((k + 1, size + 1), dtype=np.int64)
    best[0, 0] = 0.0
    for j in range(1, size + 1):
        dn, ds = n[j] - n[:j], s[j] - s[:j]
        cost = np.maximum(q[j] - q[:j] - ds * ds / dn, 0.0)
        options = best[:-1, :j] + cost
        at = np.argmin(options, axis=1)
        begin[1:, j] = at
        best[1:, j] = options[np.arange(k), at]
    return best, begin


def _reverse(bins: _Bins) -> _Bins:
    flipped = bins.take(slice(None, None, -1))
    return _Bins(
        -flipped.high, -flipped.low, flipped.n, -flipped.total, flipped.squares, flipped.open
    )


def _open_places(bins: _Bins, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins an optimal break may cut, and bin borders it may lie on.

    Shifting the breaks of the best partition to a border of their bin costs at most
    ``2 * range * rows * width`` of each cut bin, because every value lies nearest to its own
    class mean. A place is out when the best partition through it is worse than the best known
    one by more than that.
    """
    if len(bins) < k:
        return (bins.high > bins.low) & (bins.open > 0), np.ones(len(bins) + 1, dtype=bool)
    forward, _ = _best_costs(bins, k)
    backward = _best_costs(_reverse(bins), k)[0][:, ::-1]
    spread = bins.high[-1] - bins.low[0]
    slack = 2 * spread * bins.n * (bins.high - bins.low) * bins.open
    best = forward[k, len(bins)]
    noise = 1e-12 * max(bins.squares.sum(), 1e-300)
    limit = best + noise
    through = np.array([forward[i] + backward[k - i] for i in range(1, k)])
    at_bin = np.minimum(through[:, :-1], through[:, 1:])
    worst = np.full(k - 1, slack.max(initial=0.0))
    open_bins = np.zeros(at_bin.shape, dtype=bool)
    for _ in range(4):
        others = worst.sum() - worst[:, None]
        open_bins = (at_bin - slack - others <= limit) & (slack > 0)
        tighter = np.where(open_bins, slack, 0.0).max(axis=1, initial=0.0)
        if (tighter >= worst).all():
            break
        worst = np.minimum(worst, tighter)
    borders = (through - worst.sum() <= limit).any(axis=0)
    return open_bins.any(axis=0), borders


def _collect_bins(values: DataFrame, bucket: str, shift: float) -> _Bins:
    v = F.col("v")
    rows = (
        values.groupBy(bucket)
        .agg(
            F.min(v).alias("low"),
            F.max(v).alias("high"),
            F.count(v).alias("n"),
            F.sum(v - shift).alias("s"),
            F.sum((v - shift) * (v - shift)).alias("q"),
        )
        .toPandas()
        .sort_values("low")
    )
    sums = [rows[c].to_numpy(dtype=float) for c in ("low", "high", "n", "s", "q")]
    return _Bins(*sums, np.ones(len(rows)))


def _refine(values: DataFrame, bins: _Bins, cut: np.ndarray, parts: int, shift: float) -> _Bins:
    """Split the bins marked ``cut`` into ``parts`` of equal width, from the data."""
    inner = [
        np.linspace(low, high, parts + 1)
        for low, high in zip(bins.low[cut], bins.high[cut], strict=True)
    ]
    edges = np.unique(np.concatenate([*inner, bins.low]))
    low, high = float(bins.low[cut].min()), float(bins.high[cut].max())
    near = values.filter(F.col("v").between(low, high))
    found = _collect_bins(bucketize(near, "v", edges.tolist(), "bucket"), "bucket", shift)
    owner = np.searchsorted(bins.low, found.low, side="right") - 1
    return _concat(bins.take(~cut), found.take(cut[owner]))


def value_bins(df: DataFrame, column: str) -> DataFrame:
    """Sums of a column by bins that depend on the value alone, so summaries add up.

    ``(bin, anchor, n, low, high, s, q)``: 128 bins an octave on either side of zero; ``s`` and ``q``
    are sums of the distance to the anchor and of its square. Missing and infinite values are in no
    bin. Tables of several files or rounds are stacked and merged by :func:`merge_bins`.
    """
    values = df.select(without_nan(df, column).cast("double").alias("v")).filter(
        F.abs("v") < float("inf")
    )
    v, number = F.col("v"), F.col("bin")
    size = F.floor(F.ln(F.abs(v)) * BINS_PER_LOG).cast("int") + BIN_OFFSET
    binned = values.withColumn("bin", F.when(v == 0, 0).when(v > 0, size).otherwise(-size))
    edge = F.signum(number) * F.exp((F.abs(number) - BIN_OFFSET) / BINS_PER_LOG)
    placed = binned.withColumn("anchor", F.when(number == 0, 0.0).otherwise(edge))
    away = v - F.col("anchor")
    return placed.groupBy("bin").agg(
        F.min("anchor").alias("anchor"),
        F.count(F.lit(1)).alias("n"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
        F.sum(away).alias("s"),
        F.sum(away * away).alias("q"),
    )


def merge_bins(summaries: DataFrame, *by: str) -> DataFrame:
    """One row per bin (and ``by``) of stacked summaries."""
    return summaries.groupBy(*by, "bin").agg(
        F.min("anchor").alias("anchor"),
        F.sum("n").alias("n"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.sum("s").alias("s"),
        F.sum("q").alias("q"),
    )


def _from_summary(summary: DataFrame, max_bins: int) -> tuple[_Bins, float]:
    """Bins relative to their mean, neighbours joined until there are ``max_bins`` about.

    All doubles together have fewer than 540,000 bins, so the table that reaches the driver is bounded.
    """
    rows = summary.toPandas().sort_values("low")
    anchor, n, low, high, s, q = (
        rows[c].to_numpy(dtype=float) for c in ("anchor", "n", "low", "high", "s", "q")
    )
    if not len(n):
        return _Bins(low, high, n, s, q, n), 0.0
    shift = float((s + n * anchor).sum() / n.sum())
    off = anchor - shift
    bins = _Bins(low, high, n, s + n * off, q + 2 * off * s + n * off * off, np.ones(len(n)))
    if len(n) > max_bins:
        part = np.floor((np.cumsum(n) - n) * max_bins / n.sum())
        bins = bins.merge(np.flatnonzero(np.append(True, part[1:] != part[:-1])))
        bins.open = np.ones(len(bins))
    return bins, shift


def natural_breaks(
    df: DataFrame, column: str, k: int = 5, max_bins: int = MAX_BINS, write_values: bool = False
) -> list[float]:
    """Jenks natural breaks: smallest value and the top of each of ``k`` classes.

    One pass sums the column in bins (see :func:`value_bins`); bins no optimal break can cut are set
    aside, the others are split and summed again, until the breaks are exact. Only the bin sums reach
    the driver. With at most ``k`` distinct values the breaks are these values. ``write_values``
    writes the column to the scratch folder first, for tables that are costly to compute.
    """
    if write_values:
        df = materialise(df.select(without_nan(df, column).alias("v")), "values")
        column = "v"
    return breaks_from_bins(value_bins(df, column), df, column, k, max_bins)


def breaks_from_bins(
    summary: DataFrame, df: DataFrame, column: str, k: int = 5, max_bins: int = MAX_BINS
) -> list[float]:
    """Natural breaks of a column whose summary is known already.

    ``df`` is read only for the bins that a break may cut, in their range of values.
    """
    bins, shift = _from_summary(summary, max_bins)
    if not len(bins):
        return []
    values = df.select(without_nan(df, column).cast("double").alias("v")).filter(
        F.abs("v") < float("inf")  # infinite values fall into the outer classes
    )
    while True:
        cut, borders = _open_places(bins, k)
        if not cut.any():
            break
        bins.open = cut.astype(float)
        starts = borders[:-1] | cut | np.append(False, cut[:-1])
        starts[0] = True
        bins = bins.merge(np.flatnonzero(starts))
        cut = bins.open > 0
        parts = max(4, (max_bins - len(bins)) // int(cut.sum()))
        bins = _refine(values, bins, cut, parts, shift)
    if len(bins) <= k:
        return bins.high.tolist()
    _, begin = _best_costs(bins, k)
    tops, end = [], len(bins)
    for m in range(k, 0, -1):
        tops.append(float(bins.high[end - 1]))
        end = begin[m, end]
    return [float(bins.low[0]), *reversed(tops)]


def class_index(value: Column, breaks: Sequence[float]) -> Column:
    """Class of a value: below the second break 0, else the last break that is ``<= value``.

    A single break puts all values in class 0; null gives null.
    """
    index = F.lit(0)
    for i, b in enumerate(breaks[1:], start=1):
        index = F.when(value >= F.lit(float(b)), F.lit(i)).otherwise(index)
    return F.when(value.isNotNull(), index)


def class_colors(breaks: Sequence[float], k: int, cmap: str = "viridis") -> list[str]:
    """One ramp colour per class; the last class has the last colour of the ramp."""
    steps = colors.ramp(cmap, k + 1)
    return [*steps[: len(breaks) - 1], steps[-1]]


def legend(spark, breaks: Sequence[float], k: int = 5, cmap: str = "viridis") -> DataFrame:
    """Class table: index, interval, label with one decimal, colour."""
    tops = [*breaks[1:], breaks[-1]] if breaks else []
    lows = list(breaks)
    rows = [
        (i, float(lo), float(hi), f"{round(lo, 1)} - {round(hi, 1)}", color)
        for i, (lo, hi, color) in enumerate(
            zip(lows, tops, class_colors(breaks, k, cmap) if breaks else [], strict=True)
        )
    ]
    return spark.createDataFrame(rows, LEGEND_SCHEMA)


def classify(
    df: DataFrame,
    column: str,
    breaks: Sequence[float],
    k: int = 5,
    cmap: str = "viridis",
    nan_color: str = colors.NAN_COLOR,
) -> DataFrame:
    """Add class and colour of a numeric column; missing values have neither.

    Without breaks every row has the colour for missing values.
    """
    if not breaks:
        return df.withColumns({CLASS: F.lit(None).cast("int"), COLOR: F.lit(colors.to_hex(nan_color))})
    value = without_nan(df, column)
    palette = F.array(*[F.lit(c) for c in class_colors(breaks, k, cmap)])
    classed = df.withColumn(CLASS, class_index(value, breaks))
    return classed.withColumn(COLOR, F.get(palette, F.col(CLASS)))


def is_numeric(df: DataFrame, column: str, categorical: bool = False) -> bool:
    return not categorical and isinstance(df.schema[column].dataType, T.NumericType)


def visible_values(df: DataFrame, column: str, bounds=None) -> DataFrame:
    """Distinct non-missing values of a column inside the viewport."""
    from .filters import filter_bounds

    inside = df if bounds is None else filter_bounds(df, bounds)
    return inside.filter(~is_missing(df, column)).select(F.col(f"`{column}`").alias("value")).distinct()


def category_colors(
    df: DataFrame,
    column: str,
    color_dict: Mapping[str, str] | None = None,
    bounds=None,
) -> dict[str, str]:
    """Colours of the user's values and of as many new values as the palette has room for.

    Values are taken in sorted order; all further values get :func:`hashed_color`, so the
    driver holds a handful of values however many there are.
    """
    fixed = {str(v): colors.to_hex(c) for v, c in (color_dict or {}).items()}
    free = [c for c in colors.PALETTE if c not in set(fixed.values())]
    seen = visible_values(df, column, bounds).select(F.col("value").cast("string").alias("value"))
    taken = seen.filter(F.col("value").isin(*fixed)).count() if fixed else 0
    room = free[taken:]
    new = seen.filter(~F.col("value").isin(*fixed)) if fixed else seen
    names = [r[0] for r in new.orderBy("value").limit(len(room)).collect()] if room else []
    return {**fixed, **dict(zip(names, room, strict=False))}


def category_color(value: Column, missing: Column, mapping: Mapping[str, str], nan_color: str) -> Column:
    text = value.cast("string")
    color = colors.hashed_color(text)
    if mapping:
        pairs = [F.lit(v) for item in mapping.items() for v in item]
        color = F.coalesce(F.try_element_at(F.create_map(*pairs), text), color)
    return F.when(missing, F.lit(colors.to_hex(nan_color))).otherwise(color)


def classify_categories(
    df: DataFrame,
    column: str,
    mapping: Mapping[str, str],
    nan_color: str = colors.NAN_COLOR,
) -> DataFrame:
    """Add the colour of a categorical column; missing values have ``nan_color``."""
    return df.withColumn(
        COLOR, category_color(F.col(f"`{column}`"), is_missing(df, column), mapping, nan_color)
    )


def category_legend(
    df: DataFrame,
    column: str,
    mapping: Mapping[str, str],
    bounds=None,
    nan_color: str = colors.NAN_COLOR,
    nan_label: str = colors.NAN_LABEL,
) -> DataFrame:
    """Visible values with their colours, and one row for missing values if there are any."""
    from .filters import filter_bounds

    inside = df if bounds is None else filter_bounds(df, bounds)
    missing = is_missing(df, column)
    label = F.when(missing, F.lit(nan_label)).otherwise(F.col(f"`{column}`").cast("string"))
    color = category_color(F.col(f"`{column}`"), missing, mapping, nan_color)
    return inside.select(label.alias("label"), color.alias("color")).distinct()


def color_layers(
    names: Sequence[str], color_dict: Mapping[str, str] | None = None
) -> dict[str, str]:
    """One colour per layer name: the user's, else the palette, else a hashed one."""
    import hashlib

    fixed = {n: colors.to_hex(c) for n, c in (color_dict or {}).items()}
    out = {}
    for i, name in enumerate(names):
        if name in fixed:
            out[name] = fixed[name]
        elif i < len(colors.PALETTE):
            out[name] = colors.PALETTE[i]
        else:
            digest = hashlib.md5(name.encode()).hexdigest()
            red, green, blue = (int(digest[j : j + 2], 16) for j in (0, 2, 4))
            red = (red + 128) % 256 if abs(red - green) + abs(red - blue) <= 50 else red
            out[name] = f"#{red:02x}{green:02x}{blue:02x}"
    return out


def color_groups(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Feature count per colour; the group of missing values has a null colour."""
    return df.groupBy(*by, COLOR).agg(F.count(F.lit(1)).alias("n"))
