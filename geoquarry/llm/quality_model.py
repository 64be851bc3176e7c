"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, five at a time: their n-grams repeat so often that counts shrink where
they are read, and the model stays far smaller than the text. Counts, discounts, context totals and
probabilities are joins of count tables by n-gram and context, dealt out by hash. Scoring needs the
n-grams and contexts that end in the character before the one that is scored, so the model is cut
into shards by that character, and each document meets each shard where it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .batches import cuts, mix, texts

ORDER = 5
#: Entries of the model that a task holds at once; a larger model is taken in shards.
SHARD_ROWS = 3_000_000
#: Trusted ids that are broadcast; more are joined by a shuffle of the documents.
BROADCAST_IDS = 2_000_000
#: Quantiles of the trusted documents' perplexity, by language, between which documents are kept,
#: and the factor by which a document may lie outside.
QUANTILES = (0.002, 0.998)
SLACK = 1.15
#: One trusted document in so many is not in the model, but tells its limits.
HELD_OUT = 5
#: Text bytes whose n-grams are sorted at once.
CUT_BYTES = 1 << 20
#: Distinct n-grams a task holds before it passes counts on.
HELD = 1_000_000
#: Stands before the first character of a document; no character of a text.
PAD = 0x10FFFF

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _points(batch: pa.RecordBatch, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with pads before each, the places to predict, and their rows."""
    pad = chr(PAD) * (order - 1)
    whole = texts(batch)
    points = np.frombuffer("".join(pad + t for t in whole).encode("utf-32-le"), "<u4")
    sizes = np.array([len(t) for t in whole], np.int64)
    row = np.repeat(np.arange(len(whole)), sizes)
    return points, np.arange(len(row)) + (row + 1) * (order - 1), row


def _hash(points: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` code points that end before each place."""
    found = np.full(len(ends), n, np.uint64)
    for k in range(n, 0, -1):
        found = found * _STEP + mix(points[ends - k].astype(np.uint64))
    return mix(found)


def _distinct(hashes: np.ndarray, grams: np.ndarray, counts: np.ndarray):
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return hashes[first], grams[first], np.bincount(inverse, counts).astype(np.int64)


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``(gram, n)``: all runs of ``order`` characters of ``docs(text)``, with pads before each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out(part) -> pa.RecordBatch:
            raw = np.ascontiguousarray(part[1]).view(f"<U{order}").ravel()
            return pa.RecordBatch.from_arrays(
                [pa.array(raw.tolist(), pa.string()), pa.array(part[2])], names=["gram", "n"]
            )

        for batch in cuts(batches, limit=CUT_BYTES):
            points, at, _ = _points(batch, order)
            hashes, first, counts = np.unique(
                _hash(points, at + 1, order), return_index=True, return_counts=True
            )
            held.append((hashes, points[at[first, None] + np.arange(1 - order, 1)], counts))
            size += len(hashes)
            if size > HELD:
                part = _distinct(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [part], len(part[0])
                if size > HELD // 2:
                    yield out(part)
                    held, size = [], 0
        if held:
            yield out(_distinct(*map(np.concatenate, zip(*held, strict=True))))

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "gram string, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(table: DataFrame) -> list[float]:
    """The three discounts from the numbers of n-grams that occur once to four times.

    Where too few occur to tell, the discounts are 0.5, 1 and 1.5.
    """
    n1, n2, n3, n4 = table.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first()
    if not min(n1, n2, n3):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(d, 0.1), k + 0.9) for k, d in enumerate(found)]


def _discount(n: Column, by: list[float]) -> Column:
    return F.when(n == 1, by[0]).when(n == 2, by[1]).otherwise(by[2])


def train(counts: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """Probabilities ``(gram, p)`` of all orders and ``(context, left)`` from ``counts(gram, n)``.

    ``p`` is interpolated with the lower orders; ``left`` is the share of a context that goes to
    them, for characters it was never seen with. Lower orders count the different characters before
    an n-gram. Unknown characters share what the single ones leave.
    """
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = materialise(
            levels[k + 1]
            .groupBy(F.substring("gram", 2, k).alias("gram"))
            .agg(F.count("*").alias("n")),
            "grams",
        )
    n_chars = levels[1].count() + 1
    lower, grams, contexts = None, None, None
    for k in range(1, order + 1):
        by = _discounts(levels[k])
        split = levels[k].select(
            "gram", "n", F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("rest")
        )
        totals = split.groupBy("context").agg(
            F.sum("n").alias("total"), F.sum(_discount(F.col("n"), by)).alias("cut")
        )
        left = totals.select("context", "total", (F.col("cut") / F.col("total")).alias("left"))
        joined = split.join(left, "context")
        if k == 1:
            joined = joined.withColumn("p_rest", F.lit(1.0 / n_chars))
        else:
            joined = joined.join(lower.select(F.col("gram").alias("rest"), F.col("p").alias("p_rest")), "rest")
        p = (F.col("n") - _discount(F.col("n"), by)) / F.col("total") + F.col("left") * F.col("p_rest")
        lower = materialise(joined.select("gram", p.alias("p")), "probabilities")
        grams = lower if grams is None else grams.union(lower)
        here = materialise(left.select("context", "left"), "contexts")
        contexts = here if contexts is None else contexts.union(here)
    unknown = grams.sparkSession.createDataFrame([("", 1.0 / n_chars)], "gram string, p double")
    return grams.union(unknown), contexts


def _shard_of(char: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(char), F.lit(shards))


def _table(rows: DataFrame, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sorted hashes and logarithms by length, of rows (string, share)."""
    found = rows.toArrow()  # SHARD_ROWS at most, but for the single characters
    names, shares = found.column(0).to_pylist(), np.log(found.column(1).to_numpy())
    sizes = np.array([len(s) for s in names], np.int64)
    tables = []
    for n in range(order + 1):
        mine = np.flatnonzero(sizes == n)
        points = np.frombuffer("".join(names[k] for k in mine).encode("utf-32-le"), "<u4")
        hashes = _hash(points, (np.arange(len(mine)) + 1) * n, n) if n else np.zeros(len(mine), np.uint64)
        by = np.argsort(hashes)
        tables.append((hashes[by], shares[mine][by].astype(np.float32)))
    return tables


def _look_up(table: tuple[np.ndarray, np.ndarray], hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of hashes in a table, and which are there."""
    keys, values = table
    if not len(keys):
        return np.zeros(len(hashes), np.float32), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return values[at], keys[at] == hashes


def log_probabilities(model: tuple, points: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Logarithm of the probability of the character at each place after those before it."""
    grams, contexts = model
    total = np.zeros(len(at), np.float64)
    open_ = np.arange(len(at))
    for n in range(order, 0, -1):
        value, there = _look_up(grams[n], _hash(points, at[open_] + 1, n))
        total[open_[there]] += value[there]
        open_ = open_[~there]
        if not len(open_):
            return total
        value, there = _look_up(contexts[n - 1], _hash(points, at[open_], n - 1) if n > 1 else np.zeros(len(open_), np.uint64))
        total[open_[there]] += value[there]
    total[open_] += grams[0][1][0]
    return total


def _score(docs: DataFrame, held, order: int, shard: int, shards: int, chars) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in cuts(batches, limit=CUT_BYTES):
            points, at, row = _points(batch, order)
            if shards > 1:
                own = np.isin(points[at - 1], chars)
                if shard == 0:  # characters the model has never seen before another
                    own |= ~np.isin(points[at - 1], held.value[2])
                at, row = at[own], row[own]
            # Each distinct run of characters is looked up once.
            _, first, inverse = np.unique(
                _hash(points, at + 1, order), return_index=True, return_inverse=True
            )
            logs = log_probabilities(model[:2], points, at[first], order)[inverse]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "lang", "key")),
                    pa.array(np.bincount(row, minlength=batch.num_rows).astype(np.int64)),
                    pa.array(np.bincount(row, logs, minlength=batch.num_rows).astype(float)),
                ],
                names=["doc_id", "lang", "key", "n_chars", "log_p"],
            )

    return docs.mapInArrow(
        run, "doc_id long, lang string, key long, n_chars long, log_p double"
    )


def score(docs: DataFrame, model: tuple[DataFrame, DataFrame], order: int = ORDER) -> DataFrame:
    """``(doc_id, lang, n_chars, perplexity)`` for each row of ``docs(doc_id, text, lang)``.

    One pass for each shard of the model, and one shard up to ``SHARD_ROWS`` entries. The perplexity
    is per character, null for a text without any.
    """
    spark = docs.sparkSession
    grams, contexts = model
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"), text.alias("text"), F.col("lang").cast("string"), F.xxhash64(text).alias("key")
    )
    shards = max(1, -(-(grams.count() + contexts.count()) // SHARD_ROWS))
    before = F.substring("gram", -2, 1)
    last = F.substring("context", -1, 1)
    seen = [r[0] for r in contexts.where("length(context) = 1").select("context").collect()]
    known = np.array([ord(c) for c in seen], np.uint32)  # the alphabet
    found = None
    for shard in range(shards):
        mine = grams.where((F.length("gram") < 2) | (_shard_of(before, shards) == shard))
        around = contexts.where((F.length("context") < 1) | (_shard_of(last, shards) == shard))
        own = around.where("length(context) = 1").select("context")
        chars = np.array([ord(r[0]) for r in own.collect()], np.uint32)
        held = spark.sparkContext.broadcast((_table(mine, order), _table(around, order), known))
        some = _score(rows, held, order, shard, shards, chars)
        found = some if found is None else found.union(some)
    if shards > 1:  # equal rows are summed together, and parted again
        found = found.groupBy("doc_id", "lang", "key").agg(
            F.sum("n_chars").alias("n_chars"), F.sum("log_p").alias("log_p"), (F.count("*") / shards).alias("rows")
        )
        found = found.select(
            "doc_id", "lang", (F.col("n_chars") / F.col("rows")).cast("long").alias("n_chars"),
            (F.col("log_p") / F.col("rows")).alias("log_p"),
            F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))),
        )
    perplexity = F.exp(-F.col("log_p") / F.when(F.col("n_chars") > 0, F.col("n_chars")))
    return found.select("doc_id", "lang", "n_chars", perplexity.alias("perplexity"))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    order: int = ORDER,
    quantiles: tuple[float, float] = QUANTILES,
    slack: float = SLACK,
) -> DataFrame:
    """``(doc_id, lang, n_chars, perplexity, low, high, kept)`` for each row of ``docs``.

    ``docs(doc_id, text, lang)``, ``labels(doc_id, quality, toxic)``. Trusted are documents with a
    label of quality 1 and without one of toxic 1; the model has their text. A document is kept
    when its perplexity lies between two quantiles of its language, widened by ``slack``; low and
    high are the limits. One trusted document in ``HELD_OUT``, by a hash of its id, is kept out of
    the model and gives the upper quantile, which so is that of text the model hasn't seen. A language without trusted documents (null is one too) takes
    the limits over all. Without any trusted text limits are null and all with a character are kept.
    Texts that are empty or null have a null perplexity and are not kept. Repeated rows stay; a
    null id is never trusted.
    """
    trusted = (
        labels.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("trusted_id"))
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
        .where("quality = 1 AND toxic = 0")
        .select("trusted_id", (F.pmod(F.xxhash64("trusted_id"), F.lit(HELD_OUT)) == 0).alias("held_out"))
    )
    trusted = materialise(trusted, "trusted")
    side = trusted.where("NOT held_out").select("trusted_id")
    if side.count() <= BROADCAST_IDS:
        side = F.broadcast(side)  # 8 bytes an id
    same = docs.doc_id.cast("long") == F.col("trusted_id")
    counts = materialise(count_grams(docs.join(side, same, "left_semi"), order), "counts")
    scores = materialise(score(docs, train(counts, order), order), "scores")
    low_at, high_at = quantiles
    good = scores.join(trusted, scores.doc_id == trusted.trusted_id).where("perplexity IS NOT NULL")
    # What the model has seen is less perplexing, so the upper limit is that of the unseen.
    unseen = F.when(F.col("held_out"), F.col("perplexity"))
    bounds = [
        F.percentile_approx("perplexity", low_at, 10_000) / slack,
        F.percentile_approx(unseen, high_at, 10_000) * slack,
    ]
    by_lang = good.groupBy(F.col("lang").alias("of")).agg(
        bounds[0].alias("low"), bounds[1].alias("high")
    )
    over_all = good.agg(bounds[0].alias("any_low"), bounds[1].alias("any_high"))
    joined = scores.join(by_lang, scores.lang.eqNullSafe(by_lang.of), "left").crossJoin(
        F.broadcast(over_all)  # one row
    )
    low, high = F.coalesce("low", "any_low"), F.coalesce("high", "any_high")
    inside = F.col("perplexity").isNotNull() & F.coalesce(
        F.col("perplexity").between(low, high), F.lit(True)
    )
    return joined.select(
        "doc_id", scores.lang, "n_chars", "perplexity", low.alias("low"), high.alias("high"), inside.alias("kept")
    )
