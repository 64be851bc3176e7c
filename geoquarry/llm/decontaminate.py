"""Benchmark decontamination: every shared gram is a seed, Smith-Waterman aligns the passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .batches import cuts, gram_hashes, mix, word_hashes

#: Words of a seed.
SEED_WORDS = 3
#: Items of more words are aligned in parts of so many words that overlap by half.
PART_WORDS = 256
#: Least score of an alignment, as a share of what the whole part would score.
MIN_SHARE = 0.6
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of benchmark parts that are held by a task at once; a larger benchmark is taken in blocks.
BLOCK_WORDS = 4_000_000
#: Alignments that are computed side by side.
LANES = 512
#: Places of seeds that are followed at once.
PLACES = 500_000
#: Words of passages that are judged at once.
WORTH_WORDS = 200_000


@dataclass
class Block:
    """Some parts of items as arrays: word hashes of all parts, where each starts, item and id."""

    words: np.ndarray
    starts: np.ndarray
    items: list
    grams: np.ndarray  # hashes of seeds, sorted
    gram_part: np.ndarray
    gram_at: np.ndarray
    members: np.ndarray  # hashes of (part, word), sorted

    def holds(self, name: str, keys: np.ndarray) -> np.ndarray:
        """Which keys occur in one of the sorted arrays."""
        own = getattr(self, name)
        if not len(own):
            return np.zeros(len(keys), bool)
        # A table of the upper bits, made at the first use, answers for nearly all keys without a search.
        bits = np.uint64(64 - 22)
        tables = self.__dict__.setdefault("tables", {})
        if name not in tables:
            tables[name] = np.zeros(1 << 22, bool)
            tables[name][(own >> bits).astype(np.int64)] = True
        maybe = np.flatnonzero(tables[name][(keys >> bits).astype(np.int64)])
        at = np.minimum(np.searchsorted(own, keys[maybe]), len(own) - 1)
        found = np.zeros(len(keys), bool)
        found[maybe[own[at] == keys[maybe]]] = True
        return found


def _parts(items: DataFrame) -> DataFrame:
    """``(item_id, part, words)`` of ``items(item_id, text)``: word hashes in bounded parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cuts(batches):
            hashes, _, _, rows = word_hashes(batch.column("text"))
            found = []
            for item, first, last in zip(
                batch.column("item_id").to_pylist(), rows[:-1], rows[1:], strict=True
            ):
                step = PART_WORDS // 2
                for part, start in enumerate(range(first, max(last - step, first + 1), step)):
                    words = hashes[start : min(start + PART_WORDS, last)]
                    if len(words):
                        found.append((item, part, words.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.int32()),
                    pa.array([f[2] for f in found], pa.list_(pa.int64())),
                ],
                names=["item_id", "part", "words"],
            )

    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "item_id long, part int, words array<long>")


def _block(rows: list) -> Block:
    words = [np.array(r["words"], np.int64).view(np.uint64) for r in rows]
    starts = np.cumsum([0, *map(len, words)])
    flat = np.concatenate(words) if words else np.empty(0, np.uint64)
    # A part of fewer words than a seed has none.
    grams, whole = gram_hashes(flat, starts, SEED_WORDS)
    at = np.flatnonzero(whole)
    part = np.searchsorted(starts, at, side="right") - 1
    order = np.argsort(grams[at], kind="stable")
    at, part = at[order], part[order]
    members = np.unique(_members(np.repeat(np.arange(len(rows)), np.diff(starts)), flat))
    return Block(
        flat,
        starts,
        [r["item_id"] for r in rows],
        grams[at],
        part,
        at - starts[:-1][part],
        members,
    )


def _members(parts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A hash for each word of a part."""
    return mix(words + mix(parts.astype(np.uint64)))


def align(parts: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman of each part with its passage, all side by side.

    Returns score, first and last matched word of the passage (exclusive) for each pair. Rows of
    the table are words of the part; the places where alignments begin travel with the scores.
    """
    lanes = len(parts)
    wide = max(map(len, passages))
    tall = max(map(len, parts))
    text = np.zeros((lanes, wide), np.uint64)
    inside = np.zeros((lanes, wide), bool)
    part = np.zeros((lanes, tall), np.uint64)
    for k, (p, t) in enumerate(zip(parts, passages, strict=True)):
        text[k, : len(t)], inside[k, : len(t)], part[k, : len(p)] = t, True, p
    heights = np.array([len(p) for p in parts])
    # Score and begin share a number: a higher score wins, then a later begin.
    base = np.int64(wide + 1)
    fresh = np.broadcast_to(np.arange(wide + 1, dtype=np.int64), (lanes, wide + 1))
    last = fresh.copy()
    best = np.zeros(lanes, np.int64)
    best_end = np.zeros(lanes, np.int64)
    steps = -GAP * base * np.arange(wide + 1, dtype=np.int64)
    for row in range(tall):
        equal = (text == part[:, row, None]) & inside
        score = np.where(equal, MATCH, MISMATCH) * base
        now = fresh.copy()
        np.maximum(now[:, 1:], last[:, :-1] + score, out=now[:, 1:])
        np.maximum(now, last + GAP * base, out=now)
        # Gaps along the passage: a running maximum of values raised by what gaps would cost.
        now = np.maximum.accumulate(now + steps, axis=1) - steps
        np.maximum(now, fresh, out=now)
        last = now
        end = now.argmax(axis=1)
        top = now[np.arange(lanes), end]
        better = (row < heights) & (top // base > best // base)
        best[better], best_end[better] = top[better], end[better]
    return np.stack([best // base, best % base, best_end], axis=1)


def _passages(
    block: Block, grams: np.ndarray, whole: np.ndarray, rows: np.ndarray, min_share: float = MIN_SHARE
) -> Iterator[np.ndarray]:
    """(row, part, first word, last word) of the stretches of a batch to be aligned."""
    hits = np.flatnonzero(whole)[block.holds("grams", grams[whole])]
    if not len(hits):
        return
    low = np.searchsorted(block.grams, grams[hits], side="left")
    times = np.searchsorted(block.grams, grams[hits], side="right") - low
    group = (np.cumsum(times) - times) // PLACES
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(hits)], strict=True):
        yield _stretches(block, hits[a:b], low[a:b], times[a:b], rows, min_share)


def _stretches(block: Block, hits, low, times, rows, min_share: float) -> np.ndarray:
    at = np.repeat(hits, times)
    seed = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    part = block.gram_part[seed]
    size = np.diff(block.starts)[part]
    row = np.searchsorted(rows, at, side="right") - 1
    # More words put in than this cost more than a share of ``min_share`` leaves.
    slack = np.floor(MATCH * (1 - min_share) * size / -GAP + 1e-6).astype(np.int64)
    first = np.maximum(at - block.gram_at[seed] - slack, rows[row])
    last = np.minimum(at - block.gram_at[seed] + size + slack, rows[row + 1])
    # Passages of one part that meet are one, up to four times its size. Passages that begin earlier
    # end earlier, so the stretch of each is that from its first begin to its last end.
    order = np.lexsort((first, part, row))
    row, part, first, last, size, slack = (a[order] for a in (row, part, first, last, size, slack))
    apart = np.ones(len(row), bool)
    apart[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1]) | (first[1:] >= last[:-1])
    begin = first[np.maximum.accumulate(np.where(apart, np.arange(len(row)), 0))]
    block_at = (first - begin) // np.maximum(3 * size - 2 * slack + 16, 1)
    apart[1:] |= block_at[1:] != block_at[:-1]
    starts = np.flatnonzero(apart)
    ends = np.maximum.reduceat(last, starts) if len(starts) else last
    return np.stack([row[starts], part[starts], first[starts], ends], axis=1)


def _keep(block: Block, words: np.ndarray, spots: np.ndarray, min_share: float) -> np.ndarray:
    """The passages worth aligning, short ones first; judged some words at a time."""
    spots = spots[np.argsort(spots[:, 3] - spots[:, 2], kind="stable")]
    cut = np.cumsum(spots[:, 3] - spots[:, 2]) // WORTH_WORDS
    edges = np.flatnonzero(np.diff(cut)) + 1
    some = [s[_worth(block, words, s, min_share)] for s in np.split(spots, edges) if len(s)]
    return np.concatenate(some) if some else spots


def _worth(block: Block, words: np.ndarray, spots: np.ndarray, min_share: float) -> np.ndarray:
    """Which passages hold so many words of their part that an alignment can reach the share."""
    sizes = spots[:, 3] - spots[:, 2]
    before = np.cumsum(sizes) - sizes
    at = np.arange(sizes.sum()) + np.repeat(spots[:, 2] - before, sizes)
    held = block.holds("members", _members(np.repeat(spots[:, 1], sizes), words[at]))
    return np.add.reduceat(held, before, dtype=np.int64) >= min_share * np.diff(block.starts)[spots[:, 1]] - 1e-6


MATCHES = "doc_id long, key long, item_id long, share double, start long, end long"


def _scan(docs: DataFrame, held, min_share: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(**held.value)
        for batch in cuts(batches):
            words, starts, ends, rows = word_hashes(batch.column("text"))
            grams, whole = gram_hashes(words, rows, SEED_WORDS)
            out = []
            for spots in _passages(block, grams, whole, rows, min_share):
                spots = _keep(block, words, spots, min_share)
                for at in range(0, len(spots), LANES):
                    some = spots[at : at + LANES]
                    parts = [block.words[block.starts[p] : block.starts[p + 1]] for p in some[:, 1]]
                    found = align(parts, [words[f:e] for f, e in some[:, 2:]])
                    share = found[:, 0] / (MATCH * np.array([len(p) for p in parts]))
                    for k in np.flatnonzero(share >= min_share):
                        first, last = some[k, 2] + found[k, 1:]
                        out.append((some[k, 0], block.items[some[k, 1]], share[k], starts[first], ends[last - 1]))
            rows_ = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(rows_),
                    batch.column("key").take(rows_),
                    pa.array([o[1] for o in out], pa.int64()),
                    *(pa.array([o[k] for o in out], t) for k, t in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64()))),
                ],
                names=["doc_id", "key", "item_id", "share", "start", "end"],
            )

    return docs.mapInArrow(run, MATCHES)


def find_leaks(docs: DataFrame, items: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """``(doc_id, key, item_id, share, start, end)``: where a document holds a benchmark item.

    ``docs(doc_id, text)``, ``items(item_id, text)``; ``key`` is a hash of the document's text,
    ``share`` the alignment's part of the full score, start and end are bytes of the lower-case
    text. Words are runs of letters and digits. Every 3-word gram of an item is a seed, however
    frequent. The passage around a seed is as wide as an alignment of the least share can be, and is
    aligned unless it holds too few of the item's words to reach that share. A document and an item
    make one row, with the best alignment. The items are taken in blocks of a bounded number of
    words, each in one pass over the documents, so no text is shuffled and a frequent passage is met
    where it stands. Null and empty texts hold nothing, items
    of fewer words than a seed neither; repeated rows and ids give one row per different text.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("key")
    )
    parts = materialise(_parts(items), "parts")
    words = parts.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = -(-words // BLOCK_WORDS)
    found = None
    for k in range(blocks):
        mine = parts.where(F.pmod(F.xxhash64("item_id", "part"), F.lit(blocks)) == k)
        block = _block(mine.orderBy("item_id", "part").collect())  # about BLOCK_WORDS words
        held = spark.sparkContext.broadcast(vars(block))  # plain arrays need no import
        some = materialise(_scan(rows, held, min_share), "leaks")
        found = some if found is None else found.union(some)
    if found is None:
        return spark.createDataFrame([], MATCHES)
    best = F.max_by(F.struct("share", "start", "end"), F.struct("share", -F.col("start")))
    return (
        found.groupBy("doc_id", "key", "item_id")
        .agg(best.alias("best"))
        .select("doc_id", "key", "item_id", "best.*")
    )


def keep_clean(docs: DataFrame, items: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """The documents without a benchmark item, with all their columns.

    Rows go by id and text hash, so a row with a null id goes too, and so do all equal rows.
    """
    leaks = find_leaks(docs, items, min_share)
    gone = materialise(
        leaks.select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")).distinct(),
        "gone",
    )
    key = F.xxhash64(F.coalesce(F.col("d.text").cast("string"), F.lit("")))
    same_row = F.col("d.doc_id").cast("long").eqNullSafe(F.col("g.gone_id")) & (key == F.col("g.gone_key"))
    return docs.alias("d").join(gone.alias("g"), same_row, "left_anti")
