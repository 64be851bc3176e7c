"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .batches import cuts, texts
from .components import components
from .keys import parted

SHINGLE = 3
RADIUS = 3
BITS = 64
SEED = 42
#: Fingerprints of a bucket that are compared at once; larger buckets are split by further masks.
BUCKET = 8192
#: A bucket with so few bits free has 64 fingerprints at most, and is never split.
FREE_BITS = 6

_SET = (np.arange(256)[:, None] >> np.arange(8)) & 1


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``shingle`` words; a text of fewer words is one run."""
    words = text.encode().lower().split()  # bytes.lower changes A-Z alone
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return np.array([digest(joined[s:e], SEED) for s, e in spans], np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64 majority bits of the hashes of all runs of ``shingle`` words; 0 without words."""
    found = shingles(text, shingle)
    if len(found) < 2:
        return int(found[0]) if len(found) else 0
    octets = found.view(np.uint8).reshape(-1, 8)  # little-endian
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _SET for k in range(8)])
    bits = (2 * ones > len(found)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` for each row; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cuts(batches):
            found = np.array([fingerprint(t, shingle) for t in texts(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"]
            )

    ids = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return ids.mapInArrow(run, "doc_id long, fp long")


def covering_masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the given bit positions that cover all differences of up to ``radius`` bits.

    Each position gets a non-zero vector of ``radius + 1`` bits. A mask belongs to each non-zero
    vector v and holds the positions whose vector has an odd product with v. The vectors of at most
    ``radius`` positions leave a v that is even with them all, and the mask of that v holds none of
    these positions: two values that differ there alone agree under it.
    """
    vectors = (1 << (radius + 1)) - 1
    given = {b: 1 + k % vectors for k, b in enumerate(bits)}
    return [
        sum(1 << b for b, m in given.items() if (m & v).bit_count() % 2)
        for v in range(1, vectors + 1)
    ]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _tables(rows: DataFrame, masks: list[int]) -> DataFrame:
    """``rows(fp)`` once for each mask, with the mask and the bits under it."""
    each = F.explode(F.array(*[F.lit(_signed(m)).cast("long") for m in masks]))
    return rows.select("fp", each.alias("mask")).select(
        "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"
    )


def _split(rows: DataFrame, radius: int) -> DataFrame:
    """``rows(mask, fp)`` of too large buckets, each once for each mask over the bits left free."""
    masks = [r["mask"] for r in rows.select("mask").distinct().collect()]  # at most 15 to a level
    finer = {}
    for mask in masks:
        held = mask & ((1 << 64) - 1)
        free = [b for b in range(BITS) if not held >> b & 1]
        finer[mask] = [_signed(held | m) for m in covering_masks(free, radius)]
    pairs = [(m, f) for m, all_ in finer.items() for f in all_]
    table = rows.sparkSession.createDataFrame(pairs, "mask long, finer long")
    joined = rows.join(F.broadcast(table), "mask")  # a few thousand rows at most
    return joined.select(
        F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("key"), "fp"
    ).distinct()


def bucket_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join the fingerprints of a bucket as all pairs within the radius would.

    Every group is a star around its first fingerprint.
    """
    group = np.arange(len(values))
    for i in range(1, len(values)):
        near = np.bitwise_count(values[:i] ^ values[i]) <= radius
        if near.any():
            found = np.unique(group[:i][near])
            group[i] = found[0]
            for other in found[1:]:
                group[:i][group[:i] == other] = found[0]
    linked = np.flatnonzero(group != np.arange(len(values)))
    return [(values[i], values[group[i]]) for i in linked]


def _links_of_buckets(buckets: DataFrame, radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for values in batch.column("fps"):
                array = values.values.to_numpy().view(np.uint64)
                found += bucket_links(np.sort(array), radius)
            both = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"]
            )

    return buckets.select("fps").mapInArrow(run, "a long, b long")


def covering_links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints of ``fps(fp)`` that join all near ones.

    Two fingerprints with at most ``radius`` different bits share a bucket of some mask. A bucket of
    two is compared in place, one of up to ``bucket`` in one task that gives a star for each group,
    never all pairs. Larger buckets are dealt out again by masks over their free bits, which keeps
    the guarantee; after three levels so few bits are free that no bucket can be larger.
    """
    rows = _tables(fps, covering_masks(list(range(BITS)), radius))
    parts = []
    while True:
        sizes = materialise(
            rows.groupBy("mask", "key")
            .agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
            .where("n > 1"),
            "buckets",
        )
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
        parts.append(sizes.where("n = 2").where(near).select("a", "b"))
        large_bucket = (F.col("n") > bucket) & (BITS - F.bit_count("mask") > FREE_BITS)
        middle = sizes.where((F.col("n") > 2) & ~large_bucket).select("mask", "key")
        gathered = (
            rows.join(middle, ["mask", "key"])
            .groupBy("mask", "key")
            .agg(F.collect_list("fp").alias("fps"))
        )
        parts.append(_links_of_buckets(gathered, radius))
        large = sizes.where(large_bucket).select("mask", "key")
        if large.isEmpty():
            break
        hot = materialise(rows.join(large, ["mask", "key"]).select("mask", "fp"), "hot")
        rows = _split(hot, radius)
    links = parts[0]
    for part in parts[1:]:
        links = links.union(part)
    return links.distinct()


def near_groups(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET
) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row of ``docs(doc_id, text)``.

    Documents whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is
    the smallest id that links lead to. Empty and null texts have fingerprint zero and link like
    any other. Rows with a null id take part and get the smallest other id of their group, or null.
    Repeated rows stay. Equal fingerprints are one node, so exact copies make no links.
    """
    prints = materialise(fingerprints(docs, shingle), "prints")
    return grouped(prints, lambda fps: covering_links(fps, radius, bucket)).drop("root")


def grouped(prints: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``prints(doc_id, fp, ...)`` with ``component_id``, and a fingerprint of the group as ``root``.

    ``links`` gives links ``(a, b)`` between the distinct fingerprints ``(fp)``.
    """
    nodes = materialise(
        prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes"
    )
    roots = materialise(components(links(nodes.select("fp"))), "roots")
    groups = (
        nodes.join(roots, nodes.fp == roots.node, "left")
        .where("n > 1 OR root IS NOT NULL")
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    )
    low = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    shared = groups.join(low, "root").select("fp", "root", "component_id")
    # ``shared`` has a fingerprint once, so the rows of a frequent one can be split.
    return prints.join(shared, "fp", "left").withColumns(
        {
            "component_id": F.coalesce("component_id", "doc_id"),
            "root": F.coalesce("root", "fp"),
        }
    )


def text_key(text: str = "text"):
    """Hash of a row's text."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def keep_one(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET
) -> DataFrame:
    """The document with the smallest id of each group, with all its columns.

    Several rows with that id: the one with the smallest text hash stays, and of equal rows one.
    A row with a null id can't be named in a group's decision; it stays. Only the ids and text
    hashes of what goes are joined with the documents.
    """
    key = text_key()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cuts(batches):
            found = np.array([fingerprint(t, shingle) for t in texts(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(found.view(np.int64))],
                names=["doc_id", "key", "fp"],
            )

    ids = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), key.alias("key"))
    prints = materialise(ids.mapInArrow(run, "doc_id long, key long, fp long"), "prints")
    return first_rows(docs, grouped(prints, lambda fps: covering_links(fps, radius, bucket)))


def first_rows(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, by ``groups(doc_id, key, root, component_id, fp)``."""
    groups = materialise(groups.where("doc_id IS NOT NULL").drop("fp"), "grouped")
    several = (
        groups.where("doc_id = component_id")
        .groupBy("root", "doc_id")
        .agg(F.min("key").alias("low"), F.max("key").alias("high"))
        .where("low != high")
    )
    gone = (
        groups.where("doc_id != component_id")
        .select("doc_id", "key")
        .union(
            groups.join(several, ["root", "doc_id"])
            .where("key != low")
            .select("doc_id", "key")
        )
        .distinct()
        .select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"))
    )
    gone = materialise(gone, "gone")
    id_, key = F.col("d.doc_id").cast("long"), text_key("d.text")
    same_row = (id_ == F.col("g.gone_id")) & (key == F.col("g.gone_key"))
    # Only texts of rows that may go are shuffled.
    apart, near = parted(docs, F.xxhash64(id_, key), gone.select(F.xxhash64("gone_id", "gone_key").alias("hash")))
    left = apart.union(near.alias("d").join(gone.alias("g"), same_row, "left_anti")).alias("d")
    twice = groups.groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1")
    if twice.isEmpty():
        return left
    twice = twice.select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")).alias("g")
    row = F.struct(*[F.col(f"d.`{c}`") for c in docs.columns])
    firsts = (
        left.join(twice, same_row, "left_semi")
        .groupBy(F.col("d.doc_id"), key)
        .agg(F.first(row).alias("row"))
        .select("row.*")
    )
    return left.join(twice, same_row, "left_anti").union(firsts)
