"""An ordered set of layers whose queries may name each other."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import FILE_PATH, Bounds, Layer
from ..operators.filters import QueryError, apply_query, filter_bounds, try_query
from ..operators.union import stack

LAYER = "layer"


def stem_of(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name[: name.rindex(".")] if "." in name[1:] else name


def short_names(paths: Iterable[str]) -> dict[str, str]:
    """Stem of each path, or ``parent/stem`` where several paths share the stem."""
    paths = list(paths)
    stems = [stem_of(p) for p in paths]

    def name(path: str, stem: str) -> str:
        parent = path.rstrip("/").rsplit("/", 1)[0] if "/" in path.rstrip("/") else ""
        return f"{stem_of(parent)}/{stem}" if stems.count(stem) > 1 and parent else stem

    return {p: name(p, s) for p, s in zip(paths, stems, strict=True)}


class _Others(Mapping):
    """The other layers of a query by short name or full path, filtered when looked up."""

    def __init__(self, owner: LayerSet, current: str, trail: tuple[str, ...]):
        self._owner, self._trail = owner, trail
        self._paths = {n: p for p, n in owner.names.items() if p != current}
        self._paths |= {p: p for p in owner.layers if p != current}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._paths:
            raise QueryError(f"No layer named {name!r}; known: {sorted(self._paths)}")
        return self._owner.table(self._paths[name], _trail=self._trail)

    def __iter__(self):
        return iter(self._paths)

    def __len__(self) -> int:
        return len(self._paths)


class LayerSet:
    """Layers in drawing order, bound to each other for SQL and functions."""

    def __init__(self, layers: Iterable[Layer]):
        self.layers = {layer.path: layer for layer in layers}
        self.names = short_names(self.layers)

    def table(
        self, path: str, bounds: Bounds | None = None, on_error: str = "raise", _trail: tuple[str, ...] = ()
    ) -> DataFrame:
        """A layer after viewport and query. Joined layers have their own query, no viewport."""
        if path in _trail:
            raise QueryError(f"Circular layer queries: {' -> '.join([*_trail, path])}")
        layer = self.layers[path]
        df = layer.df if bounds is None else filter_bounds(layer.df, bounds)
        others = _Others(self, path, (*_trail, path))
        if on_error == "passthrough":
            return try_query(df, layer.query, others)[0]
        return apply_query(df, layer.query, others)

    def message(self, path: str) -> str | None:
        """Why the query of a layer cannot be applied, if it cannot."""
        layer = self.layers[path]
        return try_query(layer.df, layer.query, _Others(self, path, (path,)))[1]

    def union(self, bounds: Bounds | None = None, on_error: str = "raise") -> DataFrame:
        """All visible layers stacked, with the layer's short name as column ``layer``."""
        frames = [
            self.table(p, bounds, on_error).withColumn(LAYER, F.lit(self.names[p]))
            for p, layer in self.layers.items()
            if layer.visible
        ]
        if not frames:
            raise QueryError("No visible layers")
        return stack(frames)


def layer_of_path(df: DataFrame, paths: Iterable[str]) -> DataFrame:
    """Tag rows of a union with the layer their file belongs to, the first that matches."""
    from ..operators.filters import belongs_to

    names = short_names(paths)
    tag = F.lit(None).cast("string")
    for path in reversed(list(names)):
        tag = F.when(belongs_to(F.col(FILE_PATH), path), F.lit(names[path])).otherwise(tag)
    return df.withColumn(LAYER, tag)
