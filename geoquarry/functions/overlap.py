"""Whether one geometry meets another, for the refine step of the spatial join.

The shared area of two polygons is a sum over pairs of edges. A polygon is the signed sum of
the vertical trapezoids below its edges, so the intersection is the signed sum of trapezoid
intersections, and each of those is the integral of the lower of two straight lines. This
holds for concave polygons, holes and multi-polygons alike.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..model import LINESTRING, MULTILINESTRING, MULTIPOINT, MULTIPOLYGON, POINT, POLYGON
from .wkb import decode_batch, unnest

PAIRS_PER_CHUNK = 1_000_000
#: Pairs of edges that are measured together where each pair of polygons has few.
PAIRS_PER_CACHE = 1 << 13
#: Pairs of edges from which two polygons are compared strip by strip, and edge ends in a strip.
SWEEP_PAIRS = 65_536
#: Pairs of edges up to which all are taken; beyond that only those above the same stretch of x.
FEW_PAIRS = 1_024
#: Pairs of edges that are measured together where only some of many are.
PAIRS_PER_RUN = 1 << 17
#: The middle stretch of two polygons that is compared first, as a share of what both reach over.
FIRST_STRETCH = 1 / 8
EDGES_PER_STRIP = 16
#: Cells along each axis of a polygon's grid, in which a box inside it is looked for.
INNER_CELLS = 16
#: Cells and points of polygons that are looked at together.
CELLS_PER_RUN = 1 << 18
#: A share of two polygons that lies nearer than this to the least one asked for is left to the exact
#: sum, and so is a relative difference of bounds: an error of rounding must not settle a pair.
SURE, SURE_OF_BOUNDS = 1e-6, 1e-6
_BOUNDS, _INNER = ([f"{c}{i}" for i in range(4)] for c in ("b", "i"))
POLYGONS = (POLYGON, MULTIPOLYGON)
LINES = (LINESTRING, MULTILINESTRING)
POINTS = (POINT, MULTIPOINT)


class _Rows:
    """The geometries of a batch as flat arrays of points and edges."""

    def __init__(self, geoms: pa.Array):
        self.kinds, parts, rings, points, self.x, self.y = unnest(geoms)
        part_row = np.repeat(np.arange(len(parts)), parts)
        ring_part = np.repeat(np.arange(len(rings)), rings)
        self.ring_row = part_row[ring_part]
        first_ring = np.cumsum(rings) - rings
        self.hole = np.arange(len(points)) > first_ring[ring_part]
        self.point_end = np.cumsum(points)
        self.point_at = self.point_end - points

        ring = np.repeat(np.arange(len(points)), points)
        start = np.flatnonzero(np.arange(len(self.x)) < (self.point_end - 1)[ring])
        self.edge_ring = ring[start]
        self.x1, self.y1 = self.x[start], self.y[start]
        self.x2, self.y2 = self.x[start + 1], self.y[start + 1]
        x0, y0 = (v[self.point_at[self.edge_ring]] for v in (self.x, self.y))
        cross = (self.x1 - x0) * (self.y2 - y0) - (self.x2 - x0) * (self.y1 - y0)
        signed = np.bincount(self.edge_ring, cross, len(points)) / 2
        turn = np.sign(signed) * np.where(self.hole, -1, 1)
        self.sign = turn[self.edge_ring]
        self.edges = np.bincount(self.ring_row[self.edge_ring], minlength=len(parts))
        self.edge_at = np.cumsum(self.edges) - self.edges
        inside = np.abs(signed) * np.where(self.hole, -1, 1)
        self.area = np.bincount(self.ring_row, inside, len(parts))
        self.area[~np.isin(self.kinds, POLYGONS)] = 0.0
        self.low = np.full(len(parts), np.inf)
        np.minimum.at(self.low, np.repeat(self.ring_row, points), self.y)

    def rings(self, row: int):
        """x and y of each ring or line of one geometry."""
        for ring in np.flatnonzero(self.ring_row == row):
            s = slice(self.point_at[ring], self.point_end[ring])
            yield self.x[s], self.y[s]

    @cached_property
    def wide(self) -> _Wide:
        return _Wide(self)

    def segments(self, row: int) -> np.ndarray:
        s = slice(self.edge_at[row], self.edge_at[row] + self.edges[row])
        return np.stack([self.x1[s], self.y1[s], self.x2[s], self.y2[s]])


class _Wide:
    """The edges of a batch that have a width, by geometry and left end."""

    def __init__(self, g: _Rows):
        n = len(g.kinds)
        left, right = np.minimum(g.x1, g.x2), np.maximum(g.x1, g.x2)
        self.plain = np.flatnonzero(right > left)  # in the order of the rings
        row = g.ring_row[g.edge_ring[self.plain]]
        order = np.lexsort((left[self.plain], row))
        self.edge, row = self.plain[order], row[order]
        self.left, self.right = left[self.edge], right[self.edge]
        self.n = np.bincount(row, minlength=n)
        self.at = np.cumsum(self.n) - self.n
        self.ends = np.sort(self.left)
        self.keys = row * (len(order) + 1) + np.searchsorted(self.ends, self.left)
        self.longest, self.low, self.high = np.zeros(n), np.full(n, np.inf), np.full(n, -np.inf)
        np.maximum.at(self.longest, row, self.right - self.left)
        np.minimum.at(self.low, row, self.left)
        np.maximum.at(self.high, row, self.right)
        self.top = np.full(n, -np.inf)
        np.maximum.at(self.top, row, np.maximum(g.y1, g.y2)[self.edge])
        self.bottom = np.full(n, np.inf)
        np.minimum.at(self.bottom, row, np.minimum(g.y1, g.y2)[self.edge])

    def rank(self, x: np.ndarray, side: str = "left") -> np.ndarray:
        """Left ends of all geometries before each place."""
        return np.searchsorted(self.ends, x, side)

    def place(self, row: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """First edge of each geometry from the left end of that rank on."""
        return np.searchsorted(self.keys, row * (len(self.edge) + 1) + rank)

    def between(self, row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stretch of each geometry's edges that holds those between two places along x."""
        first = self.place(row, self.rank(low - self.longest[row]))
        return first, np.maximum(self.place(row, self.rank(high)), first)


def _runs(sizes: np.ndarray, limit: int):
    """Slices of consecutive items whose sizes add up to about ``limit``."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + limit, side="right")), start + 1)
        yield slice(start, stop)
        start = stop


def _expand(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items with ``sizes`` members from ``first`` on: the owner and number of each member."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return owner, first[owner] + step


def shared_areas(a: _Rows, ai: np.ndarray, b: _Rows, bi: np.ndarray) -> np.ndarray:
    """Area of the intersection of polygon ``ai[n]`` of ``a`` and ``bi[n]`` of ``b``."""
    out = np.zeros(len(ai))
    work = a.edges[ai].astype(np.int64) * b.edges[bi]
    few = np.flatnonzero(work <= FEW_PAIRS)
    out[few] = _all_pairs_areas(a, ai[few], b, bi[few])
    more = np.flatnonzero(work > FEW_PAIRS)
    out[more] = _stretch_areas(a, ai[more], b, bi[more], *_both_reach(a, ai[more], b, bi[more]))
    return np.maximum(out, 0.0)


def shares_above(a: _Rows, ai: np.ndarray, b: _Rows, bi: np.ndarray, min_ratio: float) -> np.ndarray:
    """Whether more than ``min_ratio`` of polygon ``ai[n]`` lies in ``bi[n]``.

    What lies in one stretch along x is a part of the whole, so pairs of many edges are compared
    over a stretch in the middle first; only where that doesn't settle it over all they reach.
    """
    out = np.zeros(len(ai), dtype=bool)
    area = a.area[ai]
    work = a.edges[ai].astype(np.int64) * b.edges[bi]
    few = np.flatnonzero(work <= FEW_PAIRS)
    out[few] = np.maximum(_all_pairs_areas(a, ai[few], b, bi[few]), 0.0) / area[few] > min_ratio
    more = np.flatnonzero(work > FEW_PAIRS)
    low, high = _both_reach(a, ai[more], b, bi[more])
    p, q = a.wide, b.wide
    height = np.minimum(p.top[ai[more]], q.top[bi[more]]) - np.maximum(p.bottom[ai[more]], q.bottom[bi[more]])
    # No more than this can be shared.
    may = (high > low) & ((high - low) * height >= min_ratio * (1 - SURE_OF_BOUNDS) * area[more])
    more, low, high = more[may], low[may], high[may]
    side = (high - low) * (1 - FIRST_STRETCH) / 2
    first = _stretch_areas(a, ai[more], b, bi[more], low + side, high - side)
    out[more] = first > (min_ratio + SURE) * area[more]
    rest = ~out[more]
    more, low, high = more[rest], low[rest], high[rest]
    out[more] = np.maximum(_stretch_areas(a, ai[more], b, bi[more], low, high), 0.0) / area[more] > min_ratio
    return out


def _both_reach(a: _Rows, ai: np.ndarray, b: _Rows, bi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where along x both polygons of each pair have edges."""
    p, q = a.wide, b.wide
    return np.maximum(p.low[ai], q.low[bi]), np.minimum(p.high[ai], q.high[bi])


def _stretch_areas(a: _Rows, ai, b: _Rows, bi, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Shared area of each pair of polygons between two places along x.

    Only edges above the same place are paired: each edge with those of the other polygon that
    begin above it, which are neighbours in the order of left ends.
    """
    out = np.zeros(len(ai))
    use = np.flatnonzero(high > low)
    one = a.wide.between(ai[use], low[use], high[use])
    two = b.wide.between(bi[use], low[use], high[use])
    for own, oi, other, ti, (first, last), swapped in (
        (a, ai, b, bi, one, False), (b, bi, a, ai, two, True)
    ):
        p, q = own.wide, other.wide
        # Edges that begin at the same place are paired once, in the first round.
        begin, end, stop = q.rank(p.left, "right" if swapped else "left"), q.rank(p.right), q.rank(high)
        for part in _runs(last - first, PAIRS_PER_RUN):
            at, e = _expand(first[part], (last - first)[part])
            pair = use[part][at]
            row = ti[pair]
            meets = p.right[e] > low[pair]
            e, pair, row = e[meets], pair[meets], row[meets]
            start = q.place(row, begin[e])
            size = np.maximum(q.place(row, np.minimum(end[e], stop[pair])) - start, 0)
            for run in _runs(size, PAIRS_PER_RUN):
                each, f = _expand(start[run], size[run])
                if not len(each):
                    continue
                n, mine, others = pair[run][each], p.edge[e[run][each]], q.edge[f]
                i, j = (others, mine) if swapped else (mine, others)
                sums = _trapezoids(a, i, ai[n], b, j, bi[n], low[n], high[n])
                out += np.bincount(n, sums, len(out))
    return out


def _all_pairs_areas(a: _Rows, ai: np.ndarray, b: _Rows, bi: np.ndarray) -> np.ndarray:
    out = np.zeros(len(ai))
    v, w = a.wide, b.wide
    # Whole pairs are taken together, and few enough that what is computed stays in the cache.
    for some in _runs(v.n[ai] * w.n[bi], PAIRS_PER_CACHE):
        i, j = ai[some], bi[some]
        owner, edge = _expand(v.at[i], v.n[i])
        for run in _runs(w.n[j[owner]], PAIRS_PER_CHUNK):
            p, e = owner[run], v.plain[edge[run]]
            each, other = _expand(w.at[j[p]], w.n[j[p]])
            sums = _trapezoids(a, e[each], i[p][each], b, w.plain[other], j[p][each])
            out[some] += np.bincount(p[each], sums, len(i))
    return out


def _edges_between(g: _Rows, row: int, low: float, high: float) -> tuple[np.ndarray, ...]:
    """Edges of a polygon that have a width between two places, with their ends along x."""
    edges = np.arange(g.edge_at[row], g.edge_at[row] + g.edges[row])
    left = np.minimum(g.x1[edges], g.x2[edges])
    right = np.maximum(g.x1[edges], g.x2[edges])
    use = (right > left) & (right > low) & (left < high)
    return edges[use], left[use], right[use]


def _in_strips(cuts: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First strip of each edge, and the number of strips it reaches into."""
    last = len(cuts) - 2
    first = np.clip(np.searchsorted(cuts, left, side="right") - 1, 0, last)
    return first, np.clip(np.searchsorted(cuts, right, side="left") - 1, 0, last) - first + 1


def _met(cuts: np.ndarray, sides) -> float:
    """Pairs of edges that share a strip."""
    counts = []
    for left, right in sides:
        first, n = _in_strips(cuts, left, right)
        steps = np.bincount(first, minlength=len(cuts)) - np.bincount(first + n, minlength=len(cuts) + 1)[: len(cuts)]
        counts.append(np.cumsum(steps)[:-1].astype(float))
    return float(counts[0] @ counts[1])


def swept_area(a: _Rows, i: int, b: _Rows, j: int, part: int = 0, parts: int = 1) -> float:
    """Shared area of two polygons, or the ``part``-th of ``parts`` stretches of it along x.

    Only edges above the same stretch of the x axis have a part in it. The axis is cut into strips
    of about equally many edges, edges are paired within strips, and what a pair shares is counted
    between the ends of the strip. Strips are made wider while that makes fewer pairs, as it does
    where edges reach through many strips.
    """
    if not a.edges[i] or not b.edges[j]:
        return 0.0
    spans = []
    for g, row in ((a, i), (b, j)):
        x = g.x1[g.edge_at[row] : g.edge_at[row] + g.edges[row]]
        spans.append((x.min(), x.max()))
    low, high = max(s[0] for s in spans), min(s[1] for s in spans)
    if low >= high:
        return 0.0
    (ea, la, ra), (eb, lb, rb) = (_edges_between(g, row, low, high) for g, row in ((a, i), (b, j)))
    ends = np.sort(np.clip(np.concatenate((la, ra, lb, rb)), low, high))
    # The stretches depend on the edges alone, so all tasks of a pair agree on them.
    stretch = np.unique(ends[np.linspace(0, len(ends) - 1, parts + 1).astype(np.int64)])
    if part >= len(stretch) - 1:
        return 0.0
    low, high = stretch[part], stretch[part + 1]
    (ea, la, ra), (eb, lb, rb) = (_edges_between(g, row, low, high) for g, row in ((a, i), (b, j)))
    ends = ends[(ends > low) & (ends < high)]
    best, step = np.array([low, high]), EDGES_PER_STRIP
    least = _met(best, ((la, ra), (lb, rb)))
    while step < len(ends):
        cuts = np.unique(np.concatenate(([low], ends[::step], [high])))
        found = _met(cuts, ((la, ra), (lb, rb))) + 2.0 * len(cuts)
        if found < least:
            best, least = cuts, found
        step *= 8
    first_a, n_a = _in_strips(best, la, ra)
    first_b, n_b = _in_strips(best, lb, rb)
    owner_a, strip_a = _expand(first_a, n_a)
    owner_b, strip_b = _expand(first_b, n_b)
    order = np.argsort(strip_b, kind="stable")
    owner_b, strip_b = owner_b[order], strip_b[order]
    start = np.searchsorted(strip_b, strip_a, side="left")
    size = np.searchsorted(strip_b, strip_a, side="right") - start
    total = 0.0
    rows = (np.full(1, i), np.full(1, j))
    for run in _runs(size, PAIRS_PER_CHUNK):
        each, other = _expand(start[run], size[run])
        if not len(each):
            continue
        strip = strip_a[run][each]
        total += _trapezoids(
            a, ea[owner_a[run][each]], rows[0], b, eb[owner_b[other]], rows[1], best[strip], best[strip + 1]
        ).sum()
    return float(total)


def _trapezoids(a: _Rows, i, a_row, b: _Rows, j, b_row, low=None, high=None) -> np.ndarray:
    """Signed area the trapezoids below edge ``i`` and edge ``j`` have in common.

    With ``low`` and ``high`` only what lies between these places along x.
    """
    base_x, base_y = a.x1[a.edge_at[a_row]], np.minimum(a.low[a_row], b.low[b_row])

    def line(g: _Rows, e):
        x1, x2 = g.x1[e] - base_x, g.x2[e] - base_x
        y1, y2 = g.y1[e] - base_y, g.y2[e] - base_y
        slope = (y2 - y1) / np.where(x1 == x2, 1.0, x2 - x1)
        return np.minimum(x1, x2), np.maximum(x1, x2), x1, y1, slope, -np.sign(x2 - x1) * g.sign[e]

    a_low, a_high, ax, ay, a_slope, a_sign = line(a, i)
    b_low, b_high, bx, by, b_slope, b_sign = line(b, j)
    left, right = np.maximum(a_low, b_low), np.minimum(a_high, b_high)
    if low is not None:
        left, right = np.maximum(left, low - base_x), np.minimum(right, high - base_x)
    width = np.maximum(right - left, 0.0)
    a0, a1 = ay + a_slope * (left - ax), ay + a_slope * (right - ax)
    b0, b1 = by + b_slope * (left - bx), by + b_slope * (right - bx)
    d0, d1 = a0 - b0, a1 - b1
    lower = np.where(d0 + d1 <= 0, a0 + a1, b0 + b1) / 2
    crossing = (d0 * d1 < 0) & (width > 0)
    t = np.where(crossing, -d0 / np.where(crossing, d1 - d0, 1.0), 0.0)
    height = a0 + (a1 - a0) * t
    split = ((np.minimum(a0, b0) + height) * t + (np.minimum(a1, b1) + height) * (1 - t)) / 2
    return a_sign * b_sign * np.where(crossing, split, lower) * width


def _on_segments(px, py, e) -> np.ndarray:
    """Which points lie on any of the segments."""
    x1, y1, x2, y2 = (v[None, :] for v in e[:4])
    px, py = px[:, None], py[:, None]
    cross = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
    size = np.abs(x2 - x1) + np.abs(y2 - y1)
    inside = (
        (px >= np.minimum(x1, x2)) & (px <= np.maximum(x1, x2))
        & (py >= np.minimum(y1, y2)) & (py <= np.maximum(y1, y2))
    )
    return ((np.abs(cross) <= 1e-12 * np.maximum(size, 1e-300)) & inside).any(axis=1)


def _in_polygon(px, py, e) -> np.ndarray:
    """Closed point in polygon: even-odd rule, or on an edge."""
    x1, y1, x2, y2 = (v[None, :] for v in e[:4])
    height = np.where(y2 == y1, 1.0, y2 - y1)
    out = np.zeros(len(px), dtype=bool)
    rows = max(1, PAIRS_PER_CHUNK // max(e.shape[1], 1))
    for start in range(0, len(px), rows):
        part = slice(start, start + rows)
        x, y = px[part, None], py[part, None]
        hits = ((y1 > y) != (y2 > y)) & (x < x1 + (y - y1) * (x2 - x1) / height)
        out[part] = (hits.sum(axis=1) % 2 == 1) | _on_segments(px[part], py[part], e)
    return out


def _pieces(e, f) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Midpoints and lengths of segments ``e`` cut where they meet segments ``f``."""
    mx, my, length = [], [], []
    for x1, y1, x2, y2 in e[:4].T:
        dx, dy = x2 - x1, y2 - y1
        norm = dx * dx + dy * dy
        if norm == 0:
            continue
        fx, fy = f[2] - f[0], f[3] - f[1]
        det = dx * fy - dy * fx
        safe = np.where(det == 0, 1.0, det)
        t = ((f[0] - x1) * fy - (f[1] - y1) * fx) / safe
        cuts = [t[det != 0]]
        for ex, ey in ((f[0], f[1]), (f[2], f[3])):
            cuts.append(((ex - x1) * dx + (ey - y1) * dy)[det == 0] / norm)
        t = np.unique(np.clip(np.concatenate([[0.0, 1.0], *cuts]), 0, 1))
        mid = (t[1:] + t[:-1]) / 2
        mx.append(x1 + mid * dx)
        my.append(y1 + mid * dy)
        length.append(np.diff(t) * np.sqrt(norm))
    if not mx:
        return np.empty(0), np.empty(0), np.empty(0)
    return np.concatenate(mx), np.concatenate(my), np.concatenate(length)


def _covered_length(e, f) -> tuple[float, float]:
    """Length of lines ``e`` that runs along lines ``f``, and their whole length."""
    x, y, length = _pieces(e, f)
    along = _on_segments(x, y, f) if len(x) else np.empty(0, bool)
    return float(length[along].sum()), float(length.sum())


def _holds(this: _Rows, i: int, other: _Rows, j: int) -> bool:
    """For a geometry without area: the other one holds it, or both run along each other."""
    kind, other_kind = this.kinds[i], other.kinds[j]
    points = list(this.rings(i))
    if not points:
        return False
    e, f = this.segments(i), other.segments(j)
    px, py = (np.concatenate(v) for v in zip(*points, strict=True))
    if kind in POINTS:
        if other_kind in POLYGONS:
            return bool(_in_polygon(px, py, f).all())
        if other_kind in LINES:
            return bool(f.size and _on_segments(px, py, f).all())
        own = set(zip(px, py, strict=True))
        others = {p for x, y in other.rings(j) for p in zip(x, y, strict=True)}
        return bool(own & others) and (own <= others or not others <= own)
    if kind not in LINES:
        return False
    if other_kind in POLYGONS:
        mx, my, _ = _pieces(e, f)
        return bool(
            _in_polygon(px, py, f).all() and (not len(mx) or _in_polygon(mx, my, f).all())
        )
    if other_kind in LINES:
        shared, length = _covered_length(e, f)
        tolerance = 1e-9 * max(length, 1e-300)
        if shared <= tolerance:
            return False
        back, other_length = _covered_length(f, e)
        holds_other = back >= other_length - 1e-9 * other_length
        return shared >= length - tolerance or not holds_other
    return False


def relate(a: _Rows, ai, b: _Rows, bi, min_ratio: float) -> np.ndarray:
    """Share of geometry ``ai[n]`` inside ``bi[n]`` above ``min_ratio``; for geometries
    without an area, whether the other one holds or overlaps them."""
    out = np.zeros(len(ai), dtype=bool)
    area, to_polygon = a.area[ai], np.isin(b.kinds[bi], POLYGONS)
    flat = np.flatnonzero((area > 0) & to_polygon)
    out[flat] = shares_above(a, ai[flat], b, bi[flat], min_ratio)
    filled = np.bincount(a.ring_row, minlength=len(a.kinds)) > 0
    single = (a.kinds[ai] == POINT) & filled[ai] & to_polygon
    first = np.zeros(len(a.kinds), dtype=np.int64)
    first[a.ring_row[::-1]] = a.point_at[::-1]
    for j in np.unique(bi[single]):
        n = np.flatnonzero(single & (bi == j))
        at = first[ai[n]]
        out[n] = _in_polygon(a.x[at], a.y[at], b.segments(j))
    for n in np.flatnonzero((area <= 0) & ~single):
        out[n] = _holds(a, ai[n], b, bi[n])
    return out


def _distinct(wkb: pa.Array) -> tuple[_Rows, np.ndarray, np.ndarray]:
    """Each different geometry of a batch once, the one of each row, and which rows have one."""
    encoded = wkb.dictionary_encode()
    valid = encoded.is_valid().to_numpy(zero_copy_only=False)
    index = encoded.indices.fill_null(0).to_numpy(zero_copy_only=False)
    return _Rows(decode_batch(encoded.dictionary)), index.astype(np.int64), valid


def geometries_relate(this, other, min_ratio: float = 0.01):
    """Boolean column over two WKB columns; see :func:`relate`.

    A geometry that is in many pairs of a batch is decoded once, and points are tested
    together against each polygon.
    """

    @F.arrow_udf("boolean")
    def compare(left: pa.Array, right: pa.Array) -> pa.Array:
        a, ai, a_valid = _distinct(left)
        b, bi, b_valid = _distinct(right)
        both = np.flatnonzero(a_valid & b_valid)
        out = np.zeros(len(ai), dtype=bool)
        out[both] = relate(a, ai[both], b, bi[both], min_ratio)
        return pa.array(out, type=pa.bool_())

    return compare(this, other)


def is_polygon(wkb):
    """Whether a WKB column (little-endian or big-endian) holds polygons."""
    little = F.substring(wkb, 1, 1) == F.lit(b"\x01")
    code = F.when(little, F.substring(wkb, 2, 1)).otherwise(F.substring(wkb, 5, 1))
    return code.isin(*[F.lit(bytes([k])) for k in POLYGONS])


def strip_share(this, other, part, parts):
    """Share of a polygon that lies in another one and in one of ``parts`` vertical strips."""

    @F.arrow_udf("double")
    def measure(left: pa.Array, right: pa.Array, part: pa.Array, parts: pa.Array) -> pa.Array:
        a, ai, _ = _distinct(left)
        b, bi, _ = _distinct(right)
        shares = [
            swept_area(a, i, b, j, k, n) / a.area[i] if a.area[i] > 0 and b.area[j] > 0 else 0.0
            for i, j, k, n in zip(ai.tolist(), bi.tolist(), part.to_pylist(), parts.to_pylist(), strict=True)
        ]
        return pa.array(shares, pa.float64())

    return measure(this, other, part, parts)


class _Grid:
    """Where points lie between the lines of one axis, of a grid of equal cells for each polygon."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.size = low, high - low
        self.lines = low[:, None] + self.size[:, None] * (np.arange(INNER_CELLS + 1) / INNER_CELLS)
        self.lines[:, -1] = high
        self.middles = (self.lines[:, 1:] + self.lines[:, :-1]) / 2

    def cells(self, row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First cell whose inside a span reaches into, and how many it does; edges are not inside."""
        first, _ = self._line(row, low)
        last, on_line = self._line(row, high)
        return first, np.maximum(last - on_line - first + 1, 0)

    def below(self, row: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Cells whose middle lies below a place that is not inside a cell, or is in any one of them."""
        at = (value - self.low[row]) / self.size[row] * INNER_CELLS
        return np.clip(np.ceil(at - 0.5), 0, INNER_CELLS).astype(np.int64)

    def _line(self, row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last line up to each value, and whether it lies on it."""
        at = np.floor((value - self.low[row]) / self.size[row] * INNER_CELLS)
        at = np.clip(at, 0, INNER_CELLS).astype(np.int64)
        # Rounding is off by one line at most.
        at -= (self.lines[row, at] > value) & (at > 0)
        after = np.minimum(at + 1, INNER_CELLS)
        at = np.where(self.lines[row, after] <= value, after, at)
        return at, self.lines[row, at] == value


def _inside(g: _Rows, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each polygon, and a box that lies in it (of no size where none is found). The bounds of
    polygons that count a place more than once, or less than not at all, are NaN.

    The cells of a grid that no edge reaches into are inside or outside as a whole, by the edges above
    them. The largest box of cells inside is taken.
    """
    n, k = len(rows), INNER_CELLS
    owner, edge = _expand(g.edge_at[rows], g.edges[rows])
    x1, y1, x2, y2 = g.x1[edge], g.y1[edge], g.x2[edge], g.y2[edge]
    left, right, bottom, top = np.minimum(x1, x2), np.maximum(x1, x2), np.minimum(y1, y2), np.maximum(y1, y2)
    starts = np.cumsum(g.edges[rows]) - g.edges[rows]
    x = _Grid(np.minimum.reduceat(left, starts), np.maximum.reduceat(right, starts))
    y = _Grid(np.minimum.reduceat(bottom, starts), np.maximum.reduceat(top, starts))
    slope = (y2 - y1) / np.where(x1 == x2, 1.0, x2 - x1)
    way = -np.sign(x2 - x1) * g.sign[edge]
    slack = y.size * 1e-9
    met, above = (np.zeros(n * k * (k + 1)) for _ in range(2))
    first, columns = x.cells(owner, left, right)
    for run in _runs(columns, CELLS_PER_RUN):
        e, column = _expand(first[run], columns[run])
        e += run.start
        row = owner[e]
        place = (row * k + column) * (k + 1)
        ends = [np.clip(x.lines[row, column + i], left[e], right[e]) for i in (0, 1)]
        at = [np.where(x1[e] == x2[e], v, y1[e] + slope[e] * (w - x1[e])) for v, w in zip((bottom[e], top[e]), ends, strict=True)]
        low = np.maximum(np.minimum(*at) - slack[row], bottom[e])
        high = np.minimum(np.maximum(*at) + slack[row], top[e])
        cell, cells = y.cells(row, low, high)
        some = cells > 0
        met += np.bincount((place + cell)[some], minlength=len(met))
        met -= np.bincount((place + cell + cells)[some], minlength=len(met))
        middle = x.middles[row, column]
        over = (left[e] <= middle) & (middle < right[e])
        height = y.below(row, y1[e] + slope[e] * (middle - x1[e]))
        above += np.bincount(place[over], way[e][over], len(met))
        above -= np.bincount((place + height)[over], way[e][over], len(met))
    shape = (n, k, k + 1)
    clear = np.cumsum(met.reshape(shape), axis=2)[:, :, :k] == 0
    times = np.cumsum(above.reshape(shape), axis=2)[:, :, :k]
    odd = (clear & (times != 0) & (times != 1)).any(axis=(1, 2))
    free = clear & (times == 1) & ~odd[:, None, None]
    bounds = np.column_stack((x.lines[:, 0], y.lines[:, 0], x.lines[:, -1], y.lines[:, -1]))
    bounds[odd] = np.nan
    each = np.arange(n)
    c0, c1, r0, r1 = _largest_box(free)
    box = np.column_stack((x.lines[each, c0], y.lines[each, r0], x.lines[each, c1], y.lines[each, r1]))
    return bounds, box


def _largest_box(free: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each grid of columns and rows, the box of most cells that are all free: its ends in columns and
    rows, which are equal where no cell is free."""
    n, k, _ = free.shape
    bits = free @ (1 << np.arange(k))
    most, c0, c1, height, starts = (np.zeros(n, dtype=np.int64) for _ in range(5))
    for first in range(k):
        shared = bits[:, first]
        for last in range(first, k):
            shared = shared & bits[:, last]
            runs, rows = shared, 1
            # Bits are left where that many free rows begin.
            while runs.any():
                size = np.where(runs > 0, rows * (last - first + 1), 0)
                more = size > most
                if more.any():
                    most[more], c0[more], c1[more] = size[more], first, last + 1
                    height[more], starts[more] = rows, runs[more]
                runs, rows = runs & (runs >> 1), rows + 1
    r0 = np.log2(np.maximum(starts & -starts, 1)).astype(np.int64)
    return c0, c1, r0, r0 + height


def inside_boxes(wkb):
    """Struct column of what settles most pairs of a polygon: its area, its bounds, a box inside it and the
    share of the bounds that the box leaves.

    Null where it is no polygon, has no area or counts a place twice. A box inside a polygon is its
    progressive approximation (Brinkhoff et al., SIGMOD 1994).
    """
    names = ["area", *_BOUNDS, *_INNER, "left"]

    @F.arrow_udf(f"struct<{', '.join(f'{c}:double' for c in names)}>")
    def look(values: pa.Array) -> pa.Array:
        out = np.full((len(values), len(names)), np.nan)
        sizes = pa.compute.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False)
        for part in _runs(sizes // 16 + INNER_CELLS**2, CELLS_PER_RUN):
            g = _Rows(decode_batch(values.slice(part.start, part.stop - part.start)))
            rows = np.flatnonzero((g.area > 0) & (g.area < np.inf))
            if not len(rows):
                continue
            with np.errstate(all="ignore"):
                bounds, box = _inside(g, rows)
                whole, inner = ((v[:, 2] - v[:, 0]) * (v[:, 3] - v[:, 1]) for v in (bounds, box))
                out[part][rows] = np.column_stack((g.area[rows], bounds, box, 1 - inner / whole))
        known = np.isfinite(out).all(axis=1)
        return pa.StructArray.from_arrays([pa.array(c) for c in out.T], names, mask=pa.array(~known))

    return look(F.when(is_polygon(wkb), wkb))


def settled(this, other, min_ratio: float = 0.01) -> tuple:
    """Whether the boxes inside two polygons share enough of the first one, and whether their bounds don't.

    Takes two columns of :func:`inside_boxes`. Where neither holds, :func:`relate` is to decide.
    """

    def shared(names):
        x, y = (
            F.least(this[names[i + 2]], other[names[i + 2]]) - F.greatest(this[names[i]], other[names[i]]) for i in (0, 1)
        )
        return F.greatest(x, F.lit(0.0)) * F.greatest(y, F.lit(0.0))

    enough = shared(_INNER) > F.lit(min_ratio + SURE) * this["area"]
    too_little = shared(_BOUNDS) < F.lit(min_ratio * (1 - SURE_OF_BOUNDS)) * this["area"]
    # ``least`` and ``greatest`` pass over nulls.
    known = this.isNotNull() & other.isNotNull()
    return known & enough, known & too_little
