"""How filters of documents interact, from a sparse document-term matrix in CSR shards."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import permutations
from math import factorial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .batches import cuts, texts

FILTERS = "ABCDE"
MIN_WORDS = 200
#: Least distinct words and most capitals, in per cent.
MIN_DISTINCT = 50
MAX_CAPITALS = 3
SYMBOLS = re.compile(r"[#$%&*|]")
CAPITALS = re.compile(r"[A-Z]")
#: Documents of a shard, and bytes of their texts, whichever comes first.
SHARD_DOCS = 1024
SHARD_BYTES = 8 << 20
#: Documents for each part of the dictionary, whose words are numbered in one task; and parts at most.
PART_DOCS = 1024
MOST_PARTS = 4096

SHARDS = "shard long, doc_ids array<long>, langs array<string>, digests binary, flags binary, indptr binary, indices binary, counts binary, slots binary, words array<binary>"
ROWS = "doc_id long, part string, digest binary, mask int, n_words long, n_distinct long"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
AUDIT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def _packed(values, kind: str = "<i4") -> bytes:
    """Numbers byte by byte, all lowest bytes first: the upper ones are alike, so they compress."""
    size = np.dtype(kind).itemsize
    return np.array(values, kind).view(np.uint8).reshape(-1, size).T.tobytes()


def _unpacked(raw: bytes, kind: str = "<i4") -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T).view(kind).ravel()


def _shards(docs: DataFrame, parts: int) -> DataFrame:
    """``SHARDS``: a CSR block of documents by the words of the shard, which are listed once.

    Document k has the entries from ``indptr[k]`` to ``indptr[k + 1]``: numbers of words and how
    often the word occurs. ``words`` has the words of each part of the dictionary, with a blank
    between two, and ``slots`` their numbers in that order. ``flags`` has the bits of filters that
    need no words. Numbers have 32 bits and are ``_packed``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 33
        ids, langs, digests, flags, indptr, indices, counts, words = [], [], [], [], [0], [], [], {}
        n_bytes = 0

        def close() -> pa.RecordBatch:
            dealt = [[] for _ in range(parts)]
            for word in words:
                dealt[crc32(word) % parts].append(word)
            slots = [words[w] for some in dealt for w in some]
            numbers = [_packed(x) for x in (flags, indptr, indices, counts, slots)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard]),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([langs], pa.list_(pa.string())),
                    *(pa.array([x], pa.binary()) for x in (b"".join(digests), *numbers)),
                    pa.array([[b" ".join(some) for some in dealt]], pa.list_(pa.binary())),
                ],
                names=[c.split()[0] for c in SHARDS.split(", ")],
            )

        for batch in cuts(batches):
            for doc, lang, text in zip(
                batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), texts(batch), strict=True
            ):
                raw = text.encode()
                found = Counter(raw.split())  # ASCII white space alone parts bytes
                indices += [words.setdefault(w, len(words)) for w in found]
                counts += found.values()
                indptr.append(len(indices))
                capitals = 100 * len(CAPITALS.findall(text)) > MAX_CAPITALS * len(text)
                flags.append(4 * capitals + 8 * bool(SYMBOLS.search(text)))
                ids.append(doc)
                langs.append(lang)
                digests.append(hashlib.sha256(raw).digest())
                n_bytes += len(raw)
                if len(ids) >= SHARD_DOCS or n_bytes >= SHARD_BYTES:
                    yield close()
                    ids, langs, digests, flags, indptr, indices, counts, words = [], [], [], [], [0], [], [], {}
                    n_bytes, shard = 0, shard + 1
        if ids:
            yield close()

    return docs.mapInArrow(run, SHARDS)


def _coded(shards: DataFrame, parts: int) -> DataFrame:
    """``(shard, codes)``: the dictionary's codes of the shard's words, part after part.

    The dictionary is dealt by a hash of the word. A task numbers the words of a part in the order
    in which shards ask for them; a shard asks once for each of its words, all of a part together,
    however many documents hold them. Codes of part k are k, k + ``parts``, k + 2 ``parts`` and so on.
    """
    asked = shards.select("shard", F.posexplode("words").alias("part", "words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current = {}, None
        for batch in batches:
            out = []
            for part, words in zip(batch.column("part").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if part != current:
                    held, current = {}, part
                found = np.array([held.setdefault(w, len(held)) for w in words.split()], "<i8")
                out.append(_packed(found * parts + part, "<i8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("part"), pa.array(out, pa.binary())],
                names=["shard", "part", "codes"],
            )

    dealt = asked.repartition("part").sortWithinPartitions("part")
    codes = dealt.mapInArrow(run, "shard long, part int, codes binary")
    pairs = codes.groupBy("shard").agg(
        F.array_sort(F.collect_list(F.struct("part", "codes"))).alias("pairs")  # words of one shard
    )
    return pairs.select("shard", F.col("pairs.codes").alias("codes"))


MATRIX = "shard long, doc_ids array<long>, langs array<string>, digests binary, flags binary, indptr binary, columns binary, counts binary"


def _shards_with_codes(docs: DataFrame) -> DataFrame:
    rows = docs.count()
    parts = min(max(1 << max(rows // PART_DOCS, 1).bit_length(), 16), MOST_PARTS)
    shards = materialise(_shards(docs, parts), "shards")
    codes = materialise(_coded(shards, parts), "codes")
    return shards.drop("words").join(codes, "shard")


def _columns(row: dict) -> np.ndarray:
    """The dictionary's code of each entry of a shard."""
    found = np.concatenate([_unpacked(c, "<i8") for c in row["codes"]])
    slots, indices = (_unpacked(row[c]) for c in ("slots", "indices"))
    own = np.empty(len(found), np.int64)
    own[slots] = found
    return own[indices]


def matrix(docs: DataFrame) -> DataFrame:
    """``MATRIX``: the document-term matrix of ``docs(doc_id, text, part)`` as CSR shards.

    ``columns`` are codes of a dictionary over all documents, little-endian in 64 bits, the other
    numbers in 32.
    """
    names = [c.split()[0] for c in MATRIX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [_columns(row).tobytes() for row in batch.select(["codes", "slots", "indices"]).to_pylist()]
            kept = {"columns": pa.array(columns, pa.binary())}
            for c in ("flags", "indptr", "counts"):
                kept[c] = pa.array([_unpacked(x).tobytes() for x in batch.column(c).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [kept[n] if n in kept else batch.column(n) for n in names], names=names
            )

    return _shards_with_codes(docs).mapInArrow(run, MATRIX)


def _judged(shards: DataFrame) -> DataFrame:
    """``ROWS``: row sums and numbers of nonzero columns decide the filters over words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                columns = _columns({c: batch.column(c)[k].as_py() for c in ("codes", "slots", "indices")})
                indptr, counts, flags = (
                    _unpacked(batch.column(c)[k].as_py()) for c in ("indptr", "counts", "flags")
                )
                sums = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
                n_words = sums[indptr[1:]] - sums[indptr[:-1]]
                # An entry whose column the row has already is no further one.
                n = len(flags)
                row = np.repeat(np.arange(n), np.diff(indptr))
                order = np.lexsort((columns, row))
                again = (np.diff(columns[order]) == 0) & (np.diff(row[order]) == 0)
                distinct = np.diff(indptr) - np.bincount(row[order][1:][again], minlength=n)
                mask = flags + (n_words < MIN_WORDS) + 2 * (100 * distinct < MIN_DISTINCT * n_words)
                digests = batch.column("digests")[k].as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_ids")[k].values,
                        batch.column("langs")[k].values,
                        pa.array([digests[d : d + 32] for d in range(0, 32 * n, 32)], pa.binary()),
                        pa.array(mask.astype(np.int32)),
                        pa.array(n_words.astype(np.int64)),
                        pa.array(distinct.astype(np.int64)),
                    ],
                    names=[c.split()[0] for c in ROWS.split(", ")],
                )

    return shards.mapInArrow(run, ROWS)


def document_flags(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, mask, n_words, n_distinct)`` for each row of ``docs(doc_id, text, lang)``.

    Bit k of ``mask`` says that the document fails filter k of ``FILTERS``. A null text or language
    is an empty one.

    1. Tasks write CSR shards of their documents over the words of the shard.
    2. All shards' words make one dictionary, and its codes replace the shards' own numbers.
    3. Row sums give the words, distinct columns the distinct words of a document.
    4. Copies fail by the smallest id of their text, found by SHA-256 of the bytes. A row with a null
       id is no copy of another, and no other row of it; rows of the smallest id itself don't fail.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"),
        F.col("text").cast("string"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
    )
    judged = materialise(_judged(_shards_with_codes(rows)), "judged")
    # Only texts that two rows have can decide; sums are written before they are joined.
    least = materialise(
        judged.groupBy("digest")
        .agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "least"),
        "least",
    )
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    mask = F.col("mask") + F.when(copy, 16).otherwise(0)
    joined = judged.join(least, "digest", "left")
    return joined.select("doc_id", "part", mask.alias("mask"), "n_words", "n_distinct")


def interactions(docs: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> Iterator[tuple]:
    """Rows ``(filter_order, step, *COUNTS)`` of a part; arguments count its documents by mask."""
    masks = np.arange(1 << len(FILTERS))
    bits = np.array([m.bit_count() for m in masks])
    n_orders = factorial(len(FILTERS))
    # A document is removed by each filter it fails in the same number of orders.
    fair = np.where(bits > 0, n_orders // np.maximum(bits, 1), 0)
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            fails, seen = (masks >> k & 1) == 1, (masks & before) != 0
            removed = fails & ~seen
            before |= 1 << k
            yield (
                "".join(FILTERS[j] for j in order),
                step,
                *(
                    int(x)
                    for x in (
                        docs[(masks & before) == 0].sum(),
                        docs[removed].sum(),
                        docs[fails & seen].sum(),
                        docs[1 << k],
                        good[removed].sum(),
                        toxic[removed].sum(),
                        (docs * fair)[fails].sum(),
                    )
                ),
            )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``AUDIT``: what each filter does in each order of the filters, for each part of ``docs``.

    ``docs(doc_id, text, lang)``, ``labels(doc_id, quality, toxic)``. Parts are the languages that
    occur, a null one as an empty string; every order and step of a part has a row, zeros included.
    A document is good or toxic if any label of its id says so; labels with a null id count for
    none. Rows are counted each, repeated ones too. An empty table has no parts.

    Documents are counted by part, mask and label: at most 128 counts a part, from which a task
    works out the part's rows.
    """
    flags = document_flags(docs)
    labelled = materialise(
        labels.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(
            F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
            F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("bad"),
        )
        .where("good OR bad"),
        "labelled",
    )
    counts = materialise(
        flags.join(labelled, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("good")).alias("good"),
            F.count_if(F.col("bad")).alias("bad"),
        ),
        "counts",
    )

    def run(table: pa.Table) -> pa.Table:
        size = 1 << len(FILTERS)
        held = [
            np.bincount(table["mask"].to_numpy(), weights=table[c].to_numpy(), minlength=size).astype(np.int64)
            for c in ("n", "good", "bad")
        ]
        part = table["part"][0].as_py()
        rows = [(part, *r) for r in interactions(*held)]
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(COUNTS)]
        return pa.table(
            [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
            names=[c.split()[0] for c in AUDIT.split(", ")],
        )

    return counts.groupBy("part").applyInArrow(run, AUDIT)
