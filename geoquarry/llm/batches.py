"""Helpers for functions over Arrow batches: cuts of bounded size, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at once.
CUT_BYTES = 1 << 20

#: ASCII whitespace, as ``bytes.split`` has it: space and 0x09 to 0x0D.
WHITESPACE = " \t\n\x0b\x0c\r"

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def cuts(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CUT_BYTES):
    """The same rows in batches whose texts have about ``limit`` bytes, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(
            zero_copy_only=False
        )
        if not len(sizes):
            continue
        block = (np.cumsum(sizes) - sizes) // limit
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        for start, end in zip(starts, [*starts[1:], len(sizes)], strict=True):
            yield batch.slice(start, end - start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return pc.fill_null(batch.column(column), "").to_pylist()


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _word_bytes() -> np.ndarray:
    """Lower-case letter or digit for each byte of a word, 0 for bytes between words."""
    table = np.zeros(256, np.uint8)
    table[128:] = np.arange(128, 256)
    for first, last in (("0", "9"), ("a", "z"), ("A", "Z")):
        codes = np.arange(ord(first), ord(last) + 1)
        table[codes] = codes | 0x20 if first != "0" else codes
    return table


def word_hashes(column: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of a text column, and where they are.

    Words are runs of letters and digits in lower case; other ASCII characters part them, all
    others belong to words. Returns the 64-bit hashes in order, the byte starts and ends in each
    word's text, and for each row the index of its first word, with the total at the end. Without
    ``fold`` only A-Z are lowered.
    """
    column = pc.fill_null(column, "")
    column = (pc.fill_null(pc.utf8_lower(column), "") if fold else column).cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[first:last]
    if not len(raw):
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none, none, np.zeros(len(column) + 1, np.int64)
    letters = _word_bytes()[raw]
    inside = letters > 0
    edges = np.empty(len(raw), bool)
    edges[0] = inside[0]
    np.not_equal(inside[1:], inside[:-1], out=edges[1:])
    row_starts = offsets - first
    cut = row_starts[:-1][np.diff(offsets) > 0]
    whole = np.flatnonzero(inside & (edges | _marks(cut, len(raw))))
    after = np.zeros(len(raw), bool)
    after[:-1] = ~inside[1:]
    after[-1] = True
    after[cut[1:] - 1] = True
    ends = np.flatnonzero(inside & after) + 1
    powers = np.empty(len(raw), np.uint64)
    powers[0] = 1
    powers[1:] = _ODD
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(letters * powers, out=sums[1:])
    back = np.full(len(raw), _INVERSE)
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    hashes = mix((sums[ends] - sums[whole]) * back[whole])
    rows = np.searchsorted(whole, row_starts)
    base = np.repeat(row_starts[:-1], np.diff(rows))
    return hashes, whole - base, ends - base, rows


def _marks(at: np.ndarray, size: int) -> np.ndarray:
    found = np.zeros(size, bool)
    found[at] = True
    return found


def gram_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n`` words from each word on, and whether they lie within one row."""
    grams = np.zeros(len(words), np.uint64)
    count = len(words) - n + 1
    if count <= 0:
        return grams, np.zeros(len(words), bool)
    for k in range(n):
        grams[:count] = grams[:count] * _ODD + words[k : k + count]
    ends = np.repeat(rows[1:], np.diff(rows))
    return mix(grams), np.arange(len(words)) + n <= ends
