"""A saved view: which layers, how filtered, coloured, sampled, and where on the map."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import MISSING, asdict, dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.colors import NAN_COLOR, NAN_LABEL
from ..model import UNIQUE_ID, Bounds, Layer, is_missing
from ..operators import classify as cls
from ..operators.filters import is_select
from ..operators.prepare import with_hash_ids
from ..operators.sample import hidden_rows, sample_per_layer
from .layers import LAYER, LayerSet


@dataclass
class ViewSpec:
    """Everything needed to draw a map again. ``layers`` maps a path to its query text."""

    layers: dict[str, str | None]
    column: str | None = None
    k: int = 5
    cmap: str = "viridis"
    categorical: bool = False
    color_dict: dict[str, str] = field(default_factory=dict)
    bounds: list[float] | None = None
    hidden: list[str] = field(default_factory=list)
    max_rows: int | None = 10_000
    nan_color: str = NAN_COLOR
    nan_label: str = NAN_LABEL
    seed: int = 0

    def to_json(self) -> str:
        """The view without the settings that have their default value."""
        kept = {}
        for f in fields(self):
            value = getattr(self, f.name)
            default = f.default_factory() if f.default_factory is not MISSING else f.default
            if value != default:
                kept[f.name] = value
        return json.dumps(kept, ensure_ascii=False)

    @classmethod
    def from_json(cls_, text: str) -> ViewSpec:
        return cls_(**json.loads(text))

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass
class View:
    """Plans of a drawn view: features with ``_color``, the legend, all visible rows.

    ``hidden`` has a row for each layer: its visible rows and whether the sample leaves some out.
    """

    features: DataFrame
    legend: DataFrame
    union: DataFrame
    hidden: DataFrame


def build_view(
    spec: ViewSpec,
    load: Callable[[str], DataFrame] | Mapping[str, DataFrame],
    queries: Mapping[str, object] | None = None,
) -> View:
    """Layers, viewport, queries, union, colours, sample: one lazy plan.

    ``load`` gives the prepared table of a path. ``queries`` may add queries that are not text.
    Breaks and palette come from all visible values, before the sample is taken; ``max_rows``
    None draws all rows. A layer without row ids gets them as hashes of its rows.
    """
    load_one = load if callable(load) else load.__getitem__

    def get(path: str) -> DataFrame:
        rows = load_one(path)
        return rows if UNIQUE_ID in rows.columns else with_hash_ids(rows)

    queries = queries or {}
    layers = LayerSet(
        Layer(path, get(path), queries.get(path, query), path not in spec.hidden)
        for path, query in spec.layers.items()
    )
    bounds = Bounds.parse(spec.bounds) if spec.bounds else None
    rows = layers.union(bounds)
    spark = rows.sparkSession
    column = spec.column if spec.column in rows.columns else None
    if column is None:
        shown = [layers.names[p] for p in layers.layers]
        colors = cls.color_layers(shown, spec.color_dict)
        legend = spark.createDataFrame(list(colors.items()), "label string, color string")
        pairs = [F.lit(v) for item in colors.items() for v in item]
        colored = rows.withColumn(cls.COLOR, F.try_element_at(F.create_map(*pairs), F.col(LAYER)))
    elif cls.is_numeric(rows, column, spec.categorical):
        costly = any(callable(q.query) or is_select(q.query) for q in layers.layers.values())
        breaks = cls.natural_breaks(rows, column, spec.k, write_values=costly)
        legend = cls.legend(spark, breaks, spec.k, spec.cmap)
        colored = cls.classify(rows, column, breaks, spec.k, spec.cmap, spec.nan_color)
        colored = colored.withColumn(cls.COLOR, F.coalesce(cls.COLOR, F.lit(spec.nan_color)))
    else:
        nan_color = spec.color_dict.get(spec.nan_label, spec.nan_color)
        named = {k: v for k, v in spec.color_dict.items() if k != spec.nan_label}
        mapping = cls.category_colors(rows, column, named)
        legend = cls.category_legend(rows, column, mapping, None, nan_color, spec.nan_label)
        colored = cls.classify_categories(rows, column, mapping, nan_color)
    if spec.max_rows is None:
        return View(colored, legend, rows, hidden_rows(rows, LAYER, None))
    features = sample_per_layer(colored, LAYER, UNIQUE_ID, spec.max_rows, spec.seed)
    return View(features, legend, rows, hidden_rows(rows, LAYER, spec.max_rows))


def missing_rows(view: View, column: str) -> DataFrame:
    """Visible rows without a value in the coloured column."""
    return view.union.filter(is_missing(view.union, column))
