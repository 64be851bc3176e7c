"""WKB to and from the nested geometry column, one Arrow batch at a time.

All rows of a batch are walked together: step ``i`` reads part ``i`` (or ring ``i``) of every
geometry that has one, so the loop runs over the largest part count and not over rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..model import COLLECTION, GEOM_TYPE, LINESTRING, POINT, POLYGON


def _gather(buffer: np.ndarray, position: np.ndarray, little: np.ndarray, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = buffer[position[:, None] + np.arange(width)]
    raw[~little] = raw[~little, ::-1]
    return np.ascontiguousarray(raw).view(kind).ravel()


def _header(buffer: np.ndarray, position: np.ndarray):
    """Byte order, kind, coordinates per point and body position of each geometry."""
    little = buffer[position] == 1
    code = _gather(buffer, position + 1, little, "<u4")
    srid = (code & 0x20000000) > 0
    extra = ((code & 0x80000000) > 0).astype(int) + ((code & 0x40000000) > 0)
    code = (code & 0x1FFFFFFF).astype(int)
    extra = extra + np.choose(np.minimum(code // 1000, 3), [0, 1, 1, 2])
    return little, code % 1000, 2 + extra, position + 5 + 4 * srid


def decode_batch(array: pa.Array) -> pa.Array:
    valid = array.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(valid)
    values = array.drop_null().cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)
    offsets = offsets[values.offset : values.offset + len(values)]
    buffer = (
        np.frombuffer(values.buffers()[2], dtype=np.uint8) if len(values) else np.empty(0, np.uint8)
    )
    kinds = np.zeros(len(array), dtype=np.int32)
    runs: list[np.ndarray] = []

    def add(row, part, ring, start, points, dims, little):
        runs.append(np.stack([row, part, ring, start, points, dims, little.astype(int)]))

    if len(rows):
        little, kind, dims, body = _header(buffer, offsets)
        if (kind >= COLLECTION).any():
            raise ValueError("Geometry collections and curves are not supported")
        kinds[rows] = kind
        multi = kind > POLYGON
        count = np.ones(len(rows), dtype=np.int64)
        count[multi] = _gather(buffer, body[multi], little[multi], "<u4")
        cursor = np.where(multi, body + 4, offsets)
        part = 0
        active = np.flatnonzero(count > 0)
        while len(active):
            row = rows[active]
            little, kind, dims, body = _header(buffer, cursor[active])
            number = np.full(len(active), part)
            zero = np.zeros(len(active), dtype=np.int64)
            size = np.ones(len(active), dtype=np.int64)
            counted = kind != POINT
            size[counted] = _gather(buffer, body[counted], little[counted], "<u4")
            at = body + 4 * counted
            flat = kind != POLYGON
            add(row[flat], number[flat], zero[flat], at[flat], size[flat], dims[flat], little[flat])
            at = at + np.where(flat, size * 8 * dims, 0)
            ring = 0
            left = np.flatnonzero(~flat & (size > ring))
            while len(left):
                points = _gather(buffer, at[left], little[left], "<u4").astype(np.int64)
                add(
                    row[left], number[left], np.full(len(left), ring),
                    at[left] + 4, points, dims[left], little[left],
                )
                at[left] += 4 + points * 8 * dims[left]
                ring += 1
                left = left[size[left] > ring]
            cursor[active] = at
            part += 1
            active = active[count[active] > part]

    table = np.concatenate(runs, axis=1) if runs else np.empty((7, 0), dtype=np.int64)
    table = table[:, np.lexsort(table[2::-1])]
    row, part, _, start, points, dims, order = table
    first = np.repeat(np.cumsum(points) - points, points)
    step = np.arange(points.sum()) - first
    position = np.repeat(start, points) + step * np.repeat(8 * dims, points)
    order = np.repeat(order, points) == 1
    x = _gather(buffer, position, order, "<f8")
    y = _gather(buffer, position + 8, order, "<f8")
    empty = np.repeat(kinds[row] == POINT, points) & np.isnan(x)
    if empty.any():
        gone = np.unique(np.repeat(np.arange(len(row)), points)[empty])
        keep = np.setdiff1d(np.arange(len(row)), gone)
        x, y = x[~empty], y[~empty]
        row, part, points = row[keep], part[keep], points[keep]
    return _nest(kinds, valid, row, part, points, x, y)


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))


def _nest(kinds, valid, row, part, points, x, y) -> pa.Array:
    coordinates = pa.StructArray.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])
    rings = pa.ListArray.from_arrays(_offsets(points), coordinates)
    new_part = np.ones(len(row), dtype=bool)
    new_part[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
    starts = np.flatnonzero(new_part)
    parts = pa.ListArray.from_arrays(
        _offsets(np.diff(np.append(starts, len(row)))), rings
    )
    geoms = pa.ListArray.from_arrays(
        _offsets(np.bincount(row[starts].astype(int), minlength=len(kinds))), parts
    )
    return pa.StructArray.from_arrays(
        [pa.array(kinds), geoms], names=["kind", "parts"], mask=pa.array(~valid)
    )


def unnest(geoms: pa.Array):
    """Kind per row, and row / part / point counts with flat coordinates, of a geometry batch."""
    kinds = geoms.field("kind").fill_null(0).to_numpy(zero_copy_only=False)
    parts = geoms.field("parts")
    lengths = parts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    lengths[~geoms.is_valid().to_numpy(zero_copy_only=False)] = 0
    part_list = parts.filter(geoms.is_valid()).flatten()
    ring_counts = part_list.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    rings = part_list.flatten()
    points = rings.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = rings.flatten()
    x = flat.field("x").to_numpy(zero_copy_only=False)
    y = flat.field("y").to_numpy(zero_copy_only=False)
    return kinds, lengths, ring_counts, points, x, y


def encode_batch(geoms: pa.Array) -> pa.Array:
    valid = geoms.is_valid().to_numpy(zero_copy_only=False)
    kinds, parts, rings, points, x, y = unnest(geoms)
    part_row = np.repeat(np.arange(len(kinds)), parts)
    ring_part = np.repeat(np.arange(len(rings)), rings)
    kind_of_part = np.where(kinds[part_row] > 3, kinds[part_row] - 3, kinds[part_row])
    kind_of_ring = kind_of_part[ring_part]
    multi = kinds > 3

    ring_bytes = np.where(kind_of_ring == POLYGON, 4, 0) + 16 * points
    part_head = np.where(kind_of_part == POINT, 5, 9)
    part_bytes = part_head + np.bincount(ring_part, ring_bytes, len(rings)).astype(np.int64)
    row_bytes = np.bincount(part_row, part_bytes, len(kinds)).astype(np.int64) + 9 * multi
    hollow = (parts == 0) & ~multi
    row_bytes[hollow] = np.where(kinds[hollow] == POINT, 21, 9)
    row_bytes[~valid] = 0

    row_at = np.cumsum(row_bytes) - row_bytes
    buffer = np.zeros(int(row_bytes.sum()), dtype=np.uint8)

    def put(position, values, kind):
        width = np.dtype(kind).itemsize
        raw = np.ascontiguousarray(values, dtype=kind).view(np.uint8).reshape(-1, width)
        buffer[position[:, None] + np.arange(width)] = raw

    headed = valid & (multi | hollow)
    buffer[row_at[headed]] = 1
    put(row_at[headed] + 1, kinds[headed], "<u4")
    put(row_at[valid & multi] + 5, parts[valid & multi], "<u4")
    nothing = valid & hollow & (kinds == POINT)
    for shift in (5, 13):
        put(row_at[nothing] + shift, np.full(nothing.sum(), np.nan), "<f8")

    part_at = np.cumsum(part_bytes) - part_bytes
    row_first = np.cumsum(parts) - parts
    base = part_at[np.minimum(row_first[part_row], len(part_at) - 1)] if len(part_at) else part_at
    part_at = part_at - base + row_at[part_row] + 9 * multi[part_row]
    buffer[part_at] = 1
    put(part_at + 1, kind_of_part, "<u4")
    counted = kind_of_part == POLYGON
    put(part_at[counted] + 5, rings[counted], "<u4")

    ring_at = np.cumsum(ring_bytes) - ring_bytes
    part_first = np.cumsum(rings) - rings
    base = ring_at[np.minimum(part_first[ring_part], len(ring_at) - 1)] if len(ring_at) else ring_at
    ring_at = ring_at - base + part_at[ring_part] + part_head[ring_part]
    polygon = kind_of_ring == POLYGON
    put(ring_at[polygon], points[polygon], "<u4")
    line = kind_of_ring == LINESTRING
    put(part_at[ring_part[line]] + 5, points[line], "<u4")

    first = np.repeat(np.cumsum(points) - points, points)
    step = np.arange(len(x)) - first
    at = np.repeat(ring_at + 4 * polygon, points) + 16 * step
    put(at, x, "<f8")
    put(at + 8, y, "<f8")
    offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(row_bytes)]).astype(np.int64))
    out = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(kinds), [None, offsets, pa.py_buffer(buffer)]
    )
    masked = pa.compute.if_else(pa.array(valid), out, pa.scalar(None, pa.large_binary()))
    return masked.cast(pa.binary())


def from_wkb(column):
    """Nested geometry of a WKB column; null stays null."""
    return _decode()(column)


def to_wkb(column):
    """Little-endian WKB of a nested geometry column; null stays null."""
    return _encode()(column)


def _decode():
    @F.arrow_udf(GEOM_TYPE)
    def decode(values: pa.Array) -> pa.Array:
        return decode_batch(values)

    return decode


def _encode():
    @F.arrow_udf("binary")
    def encode(geoms: pa.Array) -> pa.Array:
        return encode_batch(geoms)

    return encode
