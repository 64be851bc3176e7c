"""Token ids in binary files of directly addressable codes.

An id is cut into chunks of eight bits, low ones first. Level k of a file holds the k-th chunk of
every id that has one, in order, and a bitmap that tells whether the id goes on in level k + 1. A
directory has the number of set bits before each block of the bitmap, so the place of an id's next
chunk is a look-up and a count within one block. Any token, or the tokens of any document, are read
by a few small reads, without decoding others.

Layout, all little-endian: ``MAGIC``, u32 levels, u64 tokens, u64 documents, then for each level
u64 chunks and u64 place; then the levels (chunks, bitmap, directory of u64), then the documents:
i64 ids, u8 null marks, u64 starts and the number of tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, scratch_path
from .batches import cuts, texts
from .token_text import CUT_BYTES, Encoder

MAGIC = b"DACTOK1\n"
#: Bits of a bitmap for each entry of its directory.
BLOCK = 512
#: A file is closed when it has so many tokens.
FILE_TOKENS = 2_000_000
END_ID = 0
#: Texts of more characters are encoded in chunks, which bounds memory.
CHUNK = 262_144
MANIFEST = "part int, seq int, file string, n_docs long, n_tokens long, n_bytes long"


def encode_file(ids: np.ndarray, doc_ids: list, starts: np.ndarray) -> bytes:
    """The bytes of a file with these tokens; document k has the ids from ``starts[k]`` on."""
    levels, values = [], ids.astype(np.uint64)
    while not levels or len(values):
        more = values > 255
        bitmap = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK)) if len(more) else more
        ranks = np.concatenate(([0], np.cumsum(blocks))).astype("<u8")
        levels.append(((values & np.uint64(255)).astype(np.uint8), bitmap, ranks))
        values = values[more] >> np.uint64(8)
    place = len(MAGIC) + 20 + 16 * len(levels)
    head, body = [], []
    for chunks, bitmap, ranks in levels:
        head += [len(chunks), place]
        body += [chunks.tobytes(), bitmap.tobytes(), ranks.tobytes()]
        place += sum(map(len, body[-3:]))
    documents = (
        np.array([d or 0 for d in doc_ids], "<i8").tobytes()
        + np.array([d is None for d in doc_ids], np.uint8).tobytes()
        + starts.astype("<u8").tobytes()
    )
    return b"".join(
        [
            MAGIC,
            np.array([len(levels)], "<u4").tobytes(),
            np.array([len(ids), len(doc_ids), *head], "<u8").tobytes(),
            *body,
            documents,
        ]
    )


class TokenFile:
    """Reads a file of tokens by place; ``read(place, size)`` gives some of its bytes."""

    def __init__(self, read):
        self.read = read
        head = read(0, len(MAGIC) + 20)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a file of token codes")
        levels = int(np.frombuffer(head, "<u4", 1, len(MAGIC))[0])
        self.n_tokens, self.n_docs = map(int, np.frombuffer(head, "<u8", 2, len(MAGIC) + 4))
        self.levels = np.frombuffer(read(len(head), 16 * levels), "<u8").reshape(-1, 2).tolist()
        size, place = self.levels[-1]
        self._documents = place + size + (size + 7) // 8 + 8 * self._entries(size)

    @staticmethod
    def open(path: str) -> TokenFile:
        files, inner = fs.FileSystem.from_uri(path)
        file = files.open_input_file(inner)
        return TokenFile(lambda place, size: file.read_at(size, place))

    @staticmethod
    def _entries(size: int) -> int:
        return 1 + (size + BLOCK - 1) // BLOCK

    def _bits(self, level: int, start: int, end: int) -> np.ndarray:
        size, place = self.levels[level]
        first = start // 8
        raw = self.read(place + size + first, (end + 7) // 8 - first)
        bits = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")
        return bits[start - 8 * first :][: end - start].astype(bool)

    def _rank(self, level: int, at: int) -> int:
        """Set bits before a place of a level's bitmap."""
        size, place = self.levels[level]
        directory = place + size + (size + 7) // 8
        block = at // BLOCK
        before = int(np.frombuffer(self.read(directory + 8 * block, 8), "<u8")[0])
        return before + int(self._bits(level, block * BLOCK, at).sum())

    def tokens(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` to ``end``: a stretch of each level."""
        if not 0 <= start <= end <= self.n_tokens:
            raise IndexError((start, end))
        found = np.zeros(end - start, np.uint32)
        which = np.arange(end - start)
        for level, (_, place) in enumerate(self.levels):
            if start == end:
                break
            chunks = np.frombuffer(self.read(place + start, end - start), np.uint8)
            found[which] |= chunks.astype(np.uint32) << np.uint32(8 * level)
            more = self._bits(level, start, end)
            start = self._rank(level, start)
            end = start + int(more.sum())
            which = which[more]
        return found

    def token(self, at: int) -> int:
        return int(self.tokens(at, at + 1)[0])

    def documents(self) -> tuple[list, np.ndarray]:
        """Ids of the documents (None for a null), and where they start; the end comes last."""
        n = self.n_docs
        raw = self.read(self._documents, 17 * n + 8)
        ids = np.frombuffer(raw, "<i8", n).tolist()
        null = np.frombuffer(raw, np.uint8, n, 8 * n)
        starts = np.frombuffer(raw, "<u8", n + 1, 9 * n).astype(np.int64)
        return [None if z else d for d, z in zip(ids, null, strict=True)], starts


def write_tokens(
    docs: DataFrame,
    vocabulary: str,
    boundary: str = "leading",
    folder: str | None = None,
    end_id: int = END_ID,
    file_tokens: int = FILE_TOKENS,
) -> DataFrame:
    """Write the tokens of ``docs(doc_id, text)`` in ascending id order; returns the files' table.

    Rows: part, seq, file, n_docs, n_tokens, n_bytes; part and seq give the order. ``folder`` is one
    that all executors reach through ``pyarrow.fs``; the default is below the cluster's shared
    folder. Null ids come first, rows of one id are ordered by a hash of their text, a null text is
    empty, each document ends with ``end_id``. The files' table is written by Spark: a task that
    runs again writes files of new names, and the table names those of the attempt that counts.
    """
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        encoder = Encoder.shared(vocabulary, boundary, CHUNK)
        files, inner = fs.FileSystem.from_uri(folder)
        files.create_dir(inner, recursive=True)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        end = np.array([end_id], "<u4").tobytes()
        held, doc_ids, size, seq = [], [], 0, 0

        def close() -> pa.RecordBatch:
            starts = np.cumsum([0, *(len(h) // 4 for h in held)])
            raw = encode_file(np.frombuffer(b"".join(held), "<u4"), doc_ids, starts)
            name = f"part-{part:06d}-{seq:04d}-{attempt}.dac"
            with files.open_output_stream(f"{inner}/{name}") as out:
                out.write(raw)
            row = [part, seq, f"{folder}/{name}", len(held), int(starts[-1]), len(raw)]
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds, strict=True)],
                names=[c.split()[0] for c in MANIFEST.split(", ")],
            )

        for batch in cuts(batches, limit=CUT_BYTES):
            for doc, ids in zip(
                batch.column("doc_id").to_pylist(), encoder.encode(texts(batch)), strict=True
            ):
                held.append(ids + end)
                doc_ids.append(doc)
                size += len(ids) // 4 + 1
                if size >= file_tokens:
                    yield close()
                    held, doc_ids, size, seq = [], [], 0, seq + 1
        if held:
            yield close()
        encoder.rest()

    return materialise(ordered.mapInArrow(run, MANIFEST), "files")


def read_tokens(files: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document in the files of ``write_tokens``.

    ``start`` counts the ids of all documents before, by a running sum over one row a file.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    based = files.select(
        "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, inner = fs.FileSystem.from_uri(name)
                with system.open_input_file(inner) as file:
                    raw = file.read()  # every document is read, so the file is read at once
                tokens = TokenFile(lambda place, size, raw=raw: raw[place : place + size])
                doc_ids, starts = tokens.documents()
                ids = memoryview(tokens.tokens(0, tokens.n_tokens).astype("<u4")).cast("B")
                places = (4 * starts).tolist()
                crc = [
                    zlib.crc32(ids[s:e]) for s, e in zip(places[:-1], places[1:], strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(base + starts[:-1]),
                        pa.array(np.diff(starts)),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spread = based.repartition(max(1, files.count()), "file")  # a task for a file
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
