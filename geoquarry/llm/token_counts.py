"""Token counts of documents, with overlapping chunks for huge ones."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import cuts, texts
from .token_text import CHUNK, CUT_BYTES, OVERLAP, Encoder

LIMIT = 2048


def count_tokens(
    docs: DataFrame,
    vocabulary: str,
    boundary: str = "dropped",
    limit: int = LIMIT,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit, n_chars)`` for each row of ``docs(doc_id, text)``.

    ``vocabulary``: path of a tokenizer file, or a name the executors resolve. Texts of more than
    ``chunk`` characters are encoded in overlapping chunks and spliced (``token_text``). Null and
    empty texts have no tokens. Rows are counted alone, so repeated rows, ties and null ids change
    nothing. No shuffle; a task holds a few MB of texts and the ids of the pieces it has met.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(vocabulary, boundary, chunk, overlap)
        for batch in cuts(batches, limit=CUT_BYTES):
            whole = texts(batch)
            n_tokens = pa.array([len(ids) // 4 for ids in encoder.encode(whole)], pa.int64())
            n_bytes = pc.fill_null(pc.binary_length(batch.column("text")), 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    n_bytes.cast(pa.int64()),
                    n_tokens,
                    pc.greater(n_tokens, limit),
                    pa.array(map(len, whole), pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "n_chars"],
            )
        encoder.rest()

    ids = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return ids.mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chars long"
    )
