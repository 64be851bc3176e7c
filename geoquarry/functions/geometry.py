"""Measures and constructors of nested geometry columns, as Spark higher-order functions."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import (
    BOUNDS_COLUMNS,
    GEOM_TYPE,
    LINESTRING,
    MULTILINESTRING,
    MULTIPOINT,
    MULTIPOLYGON,
    POINT,
    POLYGON,
)
from .crs import reproject

EARTH_CIRCUMFERENCE = 40075016.686


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _geom(kind: int, parts: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), parts.alias("parts")).cast(GEOM_TYPE)


def point(x: Column, y: Column) -> Column:
    """Point geometry; null where a coordinate is null."""
    geom = _geom(POINT, F.array(F.array(F.array(_xy(x, y)))))
    return F.when(x.isNotNull() & y.isNotNull(), geom)


def box(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Rectangle polygon, counter-clockwise from the lower left corner."""
    ring = F.array(
        _xy(minx, miny), _xy(maxx, miny), _xy(maxx, maxy), _xy(minx, maxy), _xy(minx, miny)
    )
    return F.when(minx.isNotNull(), _geom(POLYGON, F.array(F.array(ring))))


def dense_box(minx: Column, miny: Column, maxx: Column, maxy: Column, parts: int) -> Column:
    """The rectangle with every edge cut into ``parts``, for projections that bend edges."""

    def point(b: Column, k: Column) -> Column:
        side, step = F.floor(k / parts), (k % parts) / parts
        across, up = (b["x1"] - b["x0"]) * step, (b["y1"] - b["y0"]) * step
        x = F.when(side == 0, b["x0"] + across).when(side == 1, b["x1"])
        y = F.when(side == 1, b["y0"] + up).when(side == 2, b["y1"])
        return _xy(
            x.when(side == 2, b["x1"] - across).otherwise(b["x0"]),
            y.when(side == 3, b["y1"] - up).otherwise(b["y0"]),
        )

    # Columns stand outside of the functions: inside, new columns of the same names would be meant.
    corners = F.struct(minx.alias("x0"), miny.alias("y0"), maxx.alias("x1"), maxy.alias("y1"))
    steps = F.sequence(F.lit(0), F.lit(4 * parts))
    ring = let(corners, lambda b: F.transform(steps, lambda k: point(b, k)))
    return F.when(minx.isNotNull(), _geom(POLYGON, F.array(F.array(ring))))


EDGE_PARTS = 20


def reproject_bounds(box: dict[str, Column], source, target) -> dict[str, Column]:
    """Bounds that hold a box after it is moved to another CRS.

    Edges bend, so each is followed in ``EDGE_PARTS`` steps. Between two steps a bend reaches at
    most about 1/``EDGE_PARTS``² of itself further; the bounds are widened by twice that, and by
    a rounding error. A pole or a seam inside the box is not looked for.
    """
    dense = reproject(dense_box(*[box[c] for c in BOUNDS_COLUMNS], EDGE_PARTS), source, target)
    share = 2 / EDGE_PARTS**2

    def ends(points: Column, axis: str) -> list[Column]:
        values = F.transform(points, lambda p: p[axis])
        return [F.array_min(values), F.array_max(values)]

    def held(points: Column, corners: Column) -> Column:
        fields = []
        for axis in ("x", "y"):
            # What the steps add to the corners is the bend.
            (low, high), (low_c, high_c) = ends(points, axis), ends(corners, axis)
            near = (F.abs(low) + F.abs(high)) * 1e-12
            fields.append((low - (low_c - low) * share - near).alias(f"min{axis}"))
            fields.append((high + (high - high_c) * share + near).alias(f"max{axis}"))
        return F.struct(*fields)

    corner_at = F.array(*[F.lit(k * EDGE_PARTS) for k in range(4)])
    found = let(
        points_of(dense),
        lambda points: let(
            F.transform(corner_at, lambda k: F.get(points, k)), lambda corners: held(points, corners)
        ),
    )
    return {c: found[c] for c in BOUNDS_COLUMNS}


def polygon(rings: Column) -> Column:
    """Polygon of an array of rings (arrays of ``struct<x,y>``), the first one outer."""
    return F.when(rings.isNotNull(), _geom(POLYGON, F.array(rings)))


def linestring(points: Column) -> Column:
    return F.when(points.isNotNull(), _geom(LINESTRING, F.array(F.array(points))))


def points_of(geom: Column) -> Column:
    return F.flatten(F.flatten(geom["parts"]))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _steps(ring: Column) -> Column:
    """Consecutive point pairs of a ring as ``struct<p,q>``."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(
        F.slice(ring, F.lit(1), n),
        F.slice(ring, F.lit(2), n),
        lambda p, q: F.struct(p.alias("p"), q.alias("q")),
    )


def ring_area(ring: Column) -> Column:
    """Signed shoelace area, coordinates taken relative to the first point."""
    origin = F.get(ring, F.lit(0))
    cross = F.transform(
        _steps(ring),
        lambda s: (s["p"]["x"] - origin["x"]) * (s["q"]["y"] - origin["y"])
        - (s["q"]["x"] - origin["x"]) * (s["p"]["y"] - origin["y"]),
    )
    return F.when(F.size(ring) > 2, _sum(cross) / 2).otherwise(F.lit(0.0))


def area(geom: Column) -> Column:
    """Planar area: outer rings minus holes; 0 for points and lines."""
    def part_area(part: Column) -> Column:
        sizes = F.transform(part, lambda r: F.abs(ring_area(r)))
        outer_minus_rest = let(sizes, lambda v: F.get(v, F.lit(0)) * 2 - _sum(v))
        return F.when(F.size(part) > 0, outer_minus_rest).otherwise(0.0)

    def of(g: Column) -> Column:
        polygonal = g["kind"].isin(POLYGON, MULTIPOLYGON)
        return F.when(polygonal, _sum(F.transform(g["parts"], part_area))).when(
            g.isNotNull(), F.lit(0.0)
        )

    return let(geom, of)


def length(geom: Column) -> Column:
    """Planar length of all rings or lines; 0 for points."""
    rings = F.flatten(geom["parts"])
    each = F.transform(
        rings,
        lambda r: _sum(
            F.transform(
                _steps(r),
                lambda s: F.hypot(s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]),
            )
        ),
    )
    return _sum(each)


def bounds(geom: Column) -> dict[str, Column]:
    """minx, miny, maxx, maxy; null for null or empty geometries."""
    xs = F.transform(points_of(geom), lambda p: p["x"])
    ys = F.transform(points_of(geom), lambda p: p["y"])
    values = (F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))
    return dict(zip(BOUNDS_COLUMNS, values, strict=True))


def is_empty(geom: Column) -> Column:
    return F.size(points_of(geom)) == 0


def centroid(geom: Column) -> Column:
    """Area-weighted centroid of polygons, length-weighted of lines, mean of points."""
    return let(geom, lambda g: let(F.get(points_of(g), F.lit(0)), lambda o: _centroid(g, o)))


def _moment(w: Column, mx: Column, my: Column) -> Column:
    return F.struct(w.alias("w"), mx.alias("mx"), my.alias("my"))


def _centroid(geom: Column, origin: Column) -> Column:
    def ring_moment(ring: Column, sign: Column) -> Column:
        def moment(s: Column) -> Column:
            px, py = s["p"]["x"] - origin["x"], s["p"]["y"] - origin["y"]
            qx, qy = s["q"]["x"] - origin["x"], s["q"]["y"] - origin["y"]
            corners = F.struct((sign * (px * qy - qx * py)).alias("c"), (px + qx).alias("x"), (py + qy).alias("y"))
            return let(corners, lambda v: _moment(v["c"] / 2, v["x"] * v["c"] / 6, v["y"] * v["c"] / 6))

        return F.transform(_steps(ring), moment)

    def line_moment(ring: Column) -> Column:
        def moment(s: Column) -> Column:
            x = (s["p"]["x"] + s["q"]["x"]) / 2 - origin["x"]
            y = (s["p"]["y"] + s["q"]["y"]) / 2 - origin["y"]
            size = F.hypot(s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"])
            return let(size, lambda w: _moment(w, w * x, w * y))

        return F.transform(_steps(ring), moment)

    def oriented(part: Column) -> Column:
        """Moments with the outer ring counted positive and holes negative."""
        def signed(ring: Column, i: Column) -> Column:
            sign = F.signum(ring_area(ring)) * F.when(i == 0, 1.0).otherwise(-1.0)
            return let(sign, lambda v: ring_moment(ring, v))

        return F.flatten(F.transform(part, signed))

    polygonal = geom["kind"].isin(POLYGON, MULTIPOLYGON)
    linear = geom["kind"].isin(LINESTRING, MULTILINESTRING)
    moments = (
        F.when(polygonal, F.flatten(F.transform(geom["parts"], oriented)))
        .when(linear, F.flatten(F.transform(F.flatten(geom["parts"]), line_moment)))
        .otherwise(
            F.transform(
                points_of(geom),
                lambda p: _moment(F.lit(1.0), p["x"] - origin["x"], p["y"] - origin["y"]),
            )
        )
    )
    zero = _moment(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    total = F.aggregate(
        moments,
        zero,
        lambda a, m: _moment(a["w"] + m["w"], a["mx"] + m["mx"], a["my"] + m["my"]),
    )
    return let(
        total,
        lambda t: F.when(
            t["w"] != 0, _xy(origin["x"] + t["mx"] / t["w"], origin["y"] + t["my"] / t["w"])
        ),
    )


def to_lines(geom: Column) -> Column:
    """Rings of polygons as a multi-line; lines stay, points give null."""
    rings = F.transform(F.flatten(geom["parts"]), lambda ring: F.array(ring))
    return F.when(
        geom["kind"].isin(POLYGON, MULTIPOLYGON), _geom(MULTILINESTRING, rings)
    ).when(geom["kind"].isin(LINESTRING, MULTILINESTRING), geom)


def buffer_points(geom: Column, metres: float, crs=4326, segments: int = 64) -> Column:
    """Circles of ``metres`` around points, drawn in EPSG:3035 and moved back to ``crs``.

    Other geometries give an error: polygon offsets are not offered.
    """
    angles = [2 * math.pi * i / segments for i in range(segments)]
    offsets = F.from_json(
        F.lit(json.dumps([[metres * math.cos(a), -metres * math.sin(a)] for a in [*angles, 0.0]])),
        "array<array<double>>",
    )

    def circle(p: Column) -> Column:
        return F.array(F.transform(offsets, lambda t: _xy(p["x"] + t[0], p["y"] + t[1])))

    def around(g: Column) -> Column:
        kind = F.when(g["kind"] == POINT, POLYGON).otherwise(MULTIPOLYGON)
        circles = F.struct(
            kind.alias("kind"), F.transform(points_of(g), circle).alias("parts")
        ).cast(GEOM_TYPE)
        return F.when(g.isNull() | g["kind"].isin(POINT, MULTIPOINT), circles).otherwise(
            F.raise_error(F.lit("buffer_points takes points only")).cast(GEOM_TYPE)
        )

    metric = let(reproject(geom, crs, 3035), around)
    return F.when(geom.isNotNull(), reproject(metric, 3035, crs))


def expand_box(minx: Column, miny: Column, maxx: Column, maxy: Column, by: Column) -> Column:
    """A rectangle grown by ``by`` on all sides, corners kept square."""
    return box(minx - by, miny - by, maxx + by, maxy + by)


def bounds_intersect(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Closed overlap of two bounding boxes."""
    return (
        (a["minx"] <= b["maxx"])
        & (a["maxx"] >= b["minx"])
        & (a["miny"] <= b["maxy"])
        & (a["maxy"] >= b["miny"])
    )


def box_intersection(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Bounds of the shared part of two boxes; null where they do not meet."""
    meet = bounds_intersect(a, b)
    shared = {
        "minx": F.greatest(a["minx"], b["minx"]),
        "miny": F.greatest(a["miny"], b["miny"]),
        "maxx": F.least(a["maxx"], b["maxx"]),
        "maxy": F.least(a["maxy"], b["maxy"]),
    }
    return {k: F.when(meet, c) for k, c in shared.items()}


def box_covers(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether box ``a`` holds box ``b``, edges included."""
    return (
        (a["minx"] <= b["minx"])
        & (a["maxx"] >= b["maxx"])
        & (a["miny"] <= b["miny"])
        & (a["maxy"] >= b["maxy"])
    )


def box_within(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return box_covers(b, a)


def box_overlaps(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two boxes share an area and neither holds the other."""
    return (box_overlap_area(a, b) > 0) & ~box_covers(a, b) & ~box_covers(b, a)


def box_overlap_area(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Area shared by two axis-parallel boxes."""
    width = F.least(a["maxx"], b["maxx"]) - F.greatest(a["minx"], b["minx"])
    height = F.least(a["maxy"], b["maxy"]) - F.greatest(a["miny"], b["miny"])
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def zoom_for_bounds(b: dict[str, Column], width_px, height_px) -> Column:
    """Web map zoom at which the bounds fill a window of the given pixel size."""
    lat = F.radians((b["miny"] + b["maxy"]) / 2)
    lon_delta = F.abs(b["maxx"] - b["minx"])
    lat_delta = F.abs(b["maxy"] - b["miny"])
    metres_per_pixel = F.greatest(
        lon_delta * (EARTH_CIRCUMFERENCE / 360.0) * F.cos(lat) / width_px,
        lat_delta * (EARTH_CIRCUMFERENCE / 360.0) / height_px,
    )
    zoom = F.log2(F.lit(EARTH_CIRCUMFERENCE) * F.cos(lat) / (metres_per_pixel * 256))
    return F.when((lon_delta == 0) & (lat_delta == 0), F.lit(16.0)).otherwise(F.round(zoom, 2))


def geojson(geom: Column) -> Column:
    """GeoJSON text of a nested geometry."""
    def bracket(values: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))

    def coordinate(p: Column) -> Column:
        return F.concat(F.lit("["), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit("]"))

    def ring(r: Column) -> Column:
        return bracket(F.transform(r, coordinate))

    def rings(part: Column) -> Column:
        return bracket(F.transform(part, ring))

    def text(kind: str, coordinates: Column) -> Column:
        return F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), coordinates, F.lit("}"))

    def of(g: Column) -> Column:
        lines = F.flatten(g["parts"])
        first = F.coalesce(F.get(F.transform(F.flatten(lines), coordinate), F.lit(0)), F.lit("[]"))
        return (
            F.when(g["kind"] == 1, text("Point", first))
            .when(g["kind"] == 2, text("LineString", ring(F.flatten(lines))))
            .when(g["kind"] == 3, text("Polygon", rings(lines)))
            .when(g["kind"] == 4, text("MultiPoint", ring(F.flatten(lines))))
            .when(g["kind"] == 5, text("MultiLineString", rings(lines)))
            .when(g["kind"] == 6, text("MultiPolygon", bracket(F.transform(g["parts"], rings))))
        )

    return let(geom, of)
