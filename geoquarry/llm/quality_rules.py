"""Line-first cleaning: rules drop lines, then documents that lost too much of their text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import WHITESPACE, cuts, texts

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
#: A document is rejected when its lines that fail hold more than this share of its words.
MAX_LOST = 0.3

#: Phrases of page furniture. A line of at most ``FURNITURE_WORDS`` words with one fails.
FURNITURE = re.compile(
    r"\b(all rights reserved|cookie policy|accept cookies|privacy policy|terms of (use|service)|"
    r"enable javascript|click here|read more|sign (in|up)|log in|subscribe|share on|follow us|"
    r"powered by|skip to (main )?content|back to top|lorem ipsum)\b",
    re.IGNORECASE,
)
FURNITURE_WORDS = 15
TERMINAL = tuple(".!?…:;\"'”’»)]。！？")
SHORT_LINE = 4

COLUMNS = (
    "doc_id long, text string, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, base_failed boolean, n_lines long, n_lines_failed long,"
    " n_words_failed long, kept boolean"
)


def line_fails(line: str, words: list[bytes]) -> bool:
    """Whether a line with these words fails a rule."""
    n_words = len(words)
    marks = sum(line.count(c) for c in SYMBOLS)
    if marks >= 2 and marks * 5 >= n_words:  # navigation bars, symbol clutter
        return True
    if line.count("!!") * 3 >= n_words or line.count("{") + line.count("}") > 2:
        return True
    if n_words <= SHORT_LINE and not line.rstrip().endswith(TERMINAL):  # menu entries, headings
        return True
    if n_words >= 5 and sum(map(bytes.isupper, words)) * 2 > n_words:  # shouting
        return True
    if n_words >= 8 and sum(map(eq, words, words[1:])) * 2 > n_words:  # stuttering
        return True
    return n_words <= FURNITURE_WORDS and FURNITURE.search(line) is not None


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows that the list holds twice or more; ``window`` is a power of two."""
    if len(words) <= window:
        return 0
    index: dict[bytes, int] = {}
    rank = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    step = 1
    while step < window:
        pairs = rank[:-step] * (len(rank) + 1) + rank[step:]
        _, rank, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(counts) == len(rank):
            return 0
        step *= 2
    at = np.flatnonzero(counts[rank] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def judge(text: str, max_lost: float = MAX_LOST) -> tuple:
    """The values of ``COLUMNS`` after ``doc_id`` for one text."""
    raw = text.encode()
    words = raw.split()
    n_words = len(words)
    seen: set[str] = set()
    kept_lines, lines, failed, words_failed = [], 0, 0, 0
    for line in text.split("\n"):
        in_line = line.encode().split()
        if in_line:
            lines += 1
            seen.add(line)
            if line_fails(line, in_line):
                failed += 1
                words_failed += len(in_line)
                continue
        kept_lines.append(line)
    repeats = repeated_words(words)
    base_failed = n_words < MIN_WORDS or 100 * repeats > 30 * n_words
    kept = not base_failed and words_failed <= max_lost * n_words
    return (
        "\n".join(kept_lines) if failed else text,
        n_words,
        len(text) - sum(text.count(c) for c in WHITESPACE),
        sum(text.count(c) for c in SYMBOLS),
        lines - len(seen),
        repeats,
        base_failed,
        lines,
        failed,
        words_failed,
        kept,
    )


def clean_lines(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """Judge every document of ``docs(doc_id, text)`` by its lines; one row per row.

    A line fails with many symbols or separators for its words, with capitals, double exclamation
    marks or the same word throughout, as a short line without an end mark, or with a phrase of page furniture.
    ``text`` is what is left. ``base_failed``: fewer than 20 words, or over 30 % of the words in
    8-word windows that occur twice. ``kept``: not ``base_failed``, and the failed lines hold at
    most ``max_lost`` of the words. Empty and null texts have no words and fail. Rows are judged
    alone, so repeated rows, ties and null ids change nothing. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cuts(batches):
            found = [judge(t, max_lost) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, zip(*found, strict=True))],
                names=["doc_id", *(c.split()[0] for c in COLUMNS.split(", ")[1:])],
            )

    ids = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return ids.mapInArrow(run, COLUMNS)


def keep_clean(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """The kept documents with all their columns, without the lines that failed.

    ``n_chars``, where ``docs`` has it, is the length of what is left.
    """
    counted = "n_chars" in docs.columns
    to = docs.schema["n_chars"].dataType if counted else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cuts(batches):
            found = [judge(t, max_lost) for t in texts(batch)]
            rows = [i for i, f in enumerate(found) if f[-1]]
            kept = batch.take(pa.array(rows, pa.int64()))
            left = pa.array([found[i][0] for i in rows], pa.string())
            yield kept.set_column(kept.schema.get_field_index("text"), "text", left)

    kept = docs.mapInArrow(run, docs.schema)
    return kept.withColumn("n_chars", F.length("text").cast(to)) if counted else kept
