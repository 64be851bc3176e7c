"""Line dedup: winnowed line fingerprints find repeated runs of lines; later ones are deleted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import materialise
from .batches import cuts, mix, texts
from .keys import parted

#: Words of a run of whole lines from which a repetition counts.
MIN_WORDS = 50

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def windows(sizes: np.ndarray, min_words: int) -> np.ndarray:
    """(start, end) of the least windows of lines with ``min_words`` words.

    From every line forwards and from every line backwards. A run of lines with ``min_words`` words
    or more is the union of those within it: forwards from its first lines, backwards from its last
    ones. So a run is repeated exactly where its windows are, and matches that are extended both
    ways from a fingerprint end where windows stop matching.
    """
    total = np.concatenate(([0], np.cumsum(sizes)))
    n = len(sizes)
    ends = np.searchsorted(total, total[:-1] + min_words)
    starts = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    forward = np.stack([np.arange(n), ends], axis=1)[ends <= n]
    backward = np.stack([starts, np.arange(1, n + 1)], axis=1)[starts >= 0]
    return np.unique(np.concatenate((forward, backward)), axis=0)


def anchors(hashes: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """The line with the least mixed hash of each window, the last one of equals."""
    order = mix(hashes)
    return np.array(
        [e - 1 - int(order[s:e][::-1].argmin()) for s, e in spans.tolist()], np.int64
    )


def window_hashes(hashes: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """A hash of the lines of each window, from running sums of a polynomial in ``_BASE``."""
    up, down = (np.full(len(hashes) + 1, base) for base in (_BASE, _INVERSE))
    up[0] = down[0] = 1
    np.multiply.accumulate(up, out=up)
    np.multiply.accumulate(down, out=down)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes) * up[:-1])))
    start, end = spans[:, 0], spans[:, 1]
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _text_key(text: str = "text"):
    text = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return text, F.xxhash64(text)


def _lines(docs: DataFrame, min_words: int) -> DataFrame:
    """``(doc_id, key, hashes, sizes, prints)`` of rows that may hold a run: lines with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cuts(batches):
            rows, found = [], []
            for row, text in enumerate(texts(batch)):
                lines = [ln for ln in text.split("\n") if ln.strip()]
                sizes = np.array([len(ln.split()) for ln in lines], np.int32)
                if sizes.sum() < min_words:
                    continue
                hashes = np.array(
                    [xxhash.xxh64_intdigest(ln.strip().encode()) for ln in lines], np.uint64
                )
                prints = hashes[np.unique(anchors(hashes, windows(sizes, min_words)))]
                rows.append(row)
                found.append((hashes.view(np.int64), sizes, prints.view(np.int64)))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(at),
                    batch.column("key").take(at),
                    *(
                        pa.array([f[k] for f in found], pa.list_(kind))
                        for k, kind in enumerate((pa.int64(), pa.int32(), pa.int64()))
                    ),
                ],
                names=["doc_id", "key", "hashes", "sizes", "prints"],
            )

    text, key = _text_key()
    ids = docs.select(F.col("doc_id").cast("long"), text.alias("text"), key.alias("key"))
    return ids.mapInArrow(
        run,
        "doc_id long, key long, hashes array<long>, sizes array<int>, prints array<long>",
    )


def _matching(lines: DataFrame, min_words: int) -> DataFrame:
    """``(doc_id, key, window, start, end)`` of the windows around fingerprints seen twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            hashes, sizes, shared = (
                batch.column(c).to_pylist() for c in ("hashes", "sizes", "shared")
            )
            for row in range(batch.num_rows):
                own = np.array(hashes[row], np.int64).view(np.uint64)
                spans = windows(np.array(sizes[row]), min_words)
                both = np.array(shared[row], np.int64).view(np.uint64)
                spans = spans[np.isin(own[anchors(own, spans)], both)]
                found = window_hashes(own, spans).view(np.int64)
                out.append(np.column_stack((np.full(len(spans), row), found, spans)))
            all_ = np.concatenate(out) if out else np.empty((0, 4), np.int64)
            at = pa.array(all_[:, 0])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(at),
                    batch.column("key").take(at),
                    *(pa.array(all_[:, k].copy()) for k in (1, 2, 3)),
                ],
                names=["doc_id", "key", "window", "start", "end"],
            )

    return lines.mapInArrow(run, "doc_id long, key long, window long, start long, end long")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, key, runs)``: the lines of each document to delete, as (start, end) of runs.

    Lines with a word are numbered from 0. A run of whole lines with ``min_words`` words or more is
    deleted where it occurred earlier: in a smaller id (null last; of one id, the smaller text hash,
    ``key``), or further up. Every window of ``min_words`` words has its least line hash as a
    fingerprint, so a repeated run holds a fingerprint that occurs twice; most do not, and only
    windows around those that do are shuffled. A window's occurrences are joined with its first one
    alone, never with each other. Matches are extended by windows on both sides that match too.
    """
    lines = materialise(_lines(docs, min_words), "lines")
    prints = lines.select("doc_id", "key", F.explode("prints").alias("line"))
    # Sums are written before they are joined, so that the rows of a frequent line can be split.
    twice = materialise(
        prints.groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select("line"), "twice"
    )
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key"))
    shared = (
        prints.join(twice, "line")
        .groupBy("doc_id", "key")
        .agg(F.collect_set("line").alias("shared"))  # lines of one document at most
    )
    around = lines.alias("a").join(shared.alias("b"), same).select("a.*", "shared")
    spans = materialise(_matching(around, min_words), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key", "start")
    firsts = materialise(
        spans.groupBy("window")
        .agg(F.min(place).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("window", "first"),
        "firsts",
    )
    later = spans.join(firsts, "window").where(place != F.col("first"))
    return later.groupBy("doc_id", "key").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("runs")
    )


#: The runs of a row on their way; a column of that name is not passed on.
SPANS = "__runs"
OUT = "n_lines long, n_removed long, n_words_removed long"


def remove_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without later repeated runs, with counts.

    All columns stay, ``text`` loses the deleted lines; ``n_lines``, ``n_removed`` (lines with a
    word, and those deleted) and ``n_words_removed`` follow, in the place of columns of the same
    names. Lines without a word stay. Rows equal in id and text are one document: they lose the
    same lines, and none because of each other. Null and empty texts stay as they are.
    """
    runs = materialise(
        repeated_runs(docs, min_words).select(
            F.col("doc_id").alias("run_id"),
            F.col("key").alias("run_key"),
            F.col("runs").alias("run_spans"),
        ),
        "runs",
    )
    _, key = _text_key("d.text")
    id_ = F.col("d.doc_id").cast("long")
    same = id_.eqNullSafe(F.col("g.run_id")) & (key == F.col("g.run_key"))
    extra = [c.split()[0] for c in OUT.split(", ")]
    taken = [*extra, SPANS]
    columns = [c for c in docs.columns if c.lower() not in taken]
    # Texts without a run are not shuffled.
    apart, near = parted(docs, F.xxhash64(id_, key), runs.select(F.xxhash64("run_id", "run_key").alias("hash")))
    whole = near.alias("d").join(runs.alias("g"), same, "left")
    own = [F.col(f"d.`{c}`") for c in columns]
    joined = whole.select(*own, F.col("g.run_spans").alias(SPANS)).union(
        apart.alias("d").select(*own, F.lit(None).cast(runs.schema["run_spans"].dataType))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cuts(batches):
            left, counts = [], []
            spans = batch.column(SPANS).to_pylist()
            for text, found in zip(batch.column("text").to_pylist(), spans, strict=True):
                lines = (text or "").split("\n")
                real = [k for k, ln in enumerate(lines) if ln.strip()]
                gone = {real[k] for s in found or () for k in range(s["start"], s["end"])}
                words = sum(len(lines[k].split()) for k in gone)
                kept = "\n".join(ln for k, ln in enumerate(lines) if k not in gone)
                left.append(kept if gone else text)
                counts.append((len(real), len(gone), words))
            place = batch.schema.get_field_index("text")
            whole = batch.set_column(place, "text", pa.array(left, pa.string()))
            whole = whole.drop_columns([SPANS])
            yield pa.RecordBatch.from_arrays(
                [*whole.columns, *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3))],
                names=[*whole.schema.names, *extra],
            )

    fields = [f for f in joined.schema.fields if f.name != SPANS]
    return joined.mapInArrow(
        run, StructType([*fields, *(StructField(n, LongType()) for n in extra)])
    )
