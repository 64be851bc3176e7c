"""Ranked lexical search: accumulators of short lists, then document at a time over long ones."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .batches import cuts, word_hashes

TOP = 20
#: Documents of a shard of the index, and bytes of their texts, whichever comes first.
SHARD_DOCS = 2048
SHARD_BYTES = 16 << 20
#: Terms of the items that are searched for at once; more are taken in blocks, each with a pass.
BLOCK_TERMS = 1_000_000
#: A list with fewer than one in so many of a shard's documents is short: it is summed beforehand.
SHORT = 8
#: Documents of a shard that are scored at once.
STRETCH = 512
#: Lists of best documents that are merged in one task before the last merge.
MERGED = 64

# Fixed values of the score.
UNIT = 1_000_000_000
LENGTH_SHARE = 25

INDEX = "doc_ids array<long>, sizes array<int>, terms array<int>, starts array<int>, docs array<int>, counts array<int>"
BEST = "item int, doc_id long, score long"


def _item_terms(items: DataFrame) -> DataFrame:
    """``(item_id, key, terms)`` of each different row: the hashes of an item's terms, with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cuts(batches):
            hashes, _, _, rows = word_hashes(batch.column("text"), fold=False)
            flat = pa.array(hashes.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("item_id"),
                    batch.column("key"),
                    pa.LargeListArray.from_arrays(pa.array(rows, pa.int64()), flat).cast(pa.list_(pa.int64())),
                ],
                names=["item_id", "key", "terms"],
            )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = items.select(F.col("item_id").cast("long"), text.alias("text")).distinct()
    keyed = rows.select("item_id", F.xxhash64("text").alias("key"), "text")
    return keyed.mapInArrow(run, "item_id long, key long, terms array<long>")


def _index(docs: DataFrame, held) -> DataFrame:
    """Shards of an inverted index of the held terms, one row each, over all rows of ``docs``.

    ``doc_ids`` and ``sizes`` (number of all terms) of the shard's documents, in the order of ids;
    the numbers of the ``terms`` that occur, where the list of each begins, and the lists one after
    the other: places of documents, ascending, and how often the term occurs there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = held.value
        some: list[tuple] = []
        n_docs = n_bytes = 0

        def close() -> pa.RecordBatch:
            ids = pa.concat_arrays([s[0] for s in some])
            sizes = np.concatenate([s[1] for s in some])
            base = np.cumsum([0, *(len(s[0]) for s in some)])
            order = np.asarray(pa.compute.array_sort_indices(ids))  # nulls last
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            terms = np.concatenate([s[2] for s in some])
            at = place[np.concatenate([s[3] + b for s, b in zip(some, base, strict=False)])]
            counts = np.concatenate([s[4] for s in some])
            sort = np.lexsort((at, terms))
            terms, at, counts = terms[sort], at[sort], counts[sort]
            first = np.flatnonzero(np.diff(terms, prepend=-1))
            lists = (sizes[order], terms[first], [*first, len(terms)], at, counts)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([ids.take(pa.array(order))], pa.list_(pa.int64())),
                    *(pa.array([np.array(x, np.int32)], pa.list_(pa.int32())) for x in lists),
                ],
                names=[c.split()[0] for c in INDEX.split(", ")],
            )

        for batch in cuts(batches):
            hashes, _, _, rows = word_hashes(batch.column("text"), fold=False)
            at = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
            hit = np.flatnonzero(vocabulary[at] == hashes) if len(vocabulary) else np.empty(0, int)
            row = np.searchsorted(rows, hit, side="right") - 1
            # Number a row's terms by one value, so that repeats are counted by one sort.
            pair, counts = np.unique(at[hit] * np.int64(batch.num_rows) + row, return_counts=True)
            term, doc = np.divmod(pair, batch.num_rows)
            some.append((batch.column("doc_id"), np.diff(rows), term, doc, counts))
            n_docs, n_bytes = n_docs + batch.num_rows, n_bytes + batch.column("text").nbytes
            if n_docs >= SHARD_DOCS or n_bytes >= SHARD_BYTES:
                yield close()
                some.clear()
                n_docs = n_bytes = 0
        if some:
            yield close()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    return rows.mapInArrow(run, INDEX)


def term_weight(n_docs: int, held_by: int) -> int:
    """Weight of a term that ``held_by`` of ``n_docs`` documents hold."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held_by + 1)))


class Shard:
    """The lists of a shard with what each entry adds to a score."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        sizes = row["sizes"].astype(np.int64)
        share = (LENGTH_SHARE * sizes * n_docs) // max(n_terms, 1)
        fixed = 12 * (100 - LENGTH_SHARE + share)
        self.doc_ids, self.n = row["doc_ids"], len(sizes)
        self.docs = row["docs"].astype(np.int64)
        counts = row["counts"].astype(np.int64)
        self.starts = row["starts"].astype(np.int64)
        long = np.diff(self.starts)
        worth = np.repeat(weights[row["terms"]], long)
        self.adds = worth * ((UNIT * counts) // (1000 * counts + fixed[self.docs]))
        self.most = np.maximum.reduceat(self.adds, self.starts[:-1]) if len(long) else self.adds
        self.list_of = {int(t): k for k, t in enumerate(row["terms"])}

    def lists(self, terms: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Documents, what each gets, and the most one gets, for each (term, repeats) that occurs."""
        found = []
        for term, times in terms:
            k = self.list_of.get(term)
            if k is not None:
                s, e = self.starts[k], self.starts[k + 1]
                found.append((self.docs[s:e], times * self.adds[s:e], times * int(self.most[k])))
        return found


def search(shard: Shard, terms: list[tuple[int, int]], best: Best) -> None:
    """Offer a shard's documents with the terms to ``best``, skipping those that can't get in.

    Term at a time, the short lists are summed into accumulators. Those that are not zero, in the
    order of documents, are one more list, whose bound is the largest sum. Document at a time, all
    lists are then walked side by side, a stretch of documents after the other: as long as the
    lists with the least bounds can't lift a document to the least score that gets in, documents
    that they hold alone are skipped, and they are only looked up for documents the others hold.
    """
    lists = shard.lists(terms)
    short = [x for x in lists if SHORT * len(x[0]) < shard.n]
    long = [x for x in lists if SHORT * len(x[0]) >= shard.n]
    if short:
        sums = np.zeros(shard.n, np.int64)
        for docs, adds, _ in short:
            sums[docs] += adds
        held = np.flatnonzero(sums)
        if len(held):
            long.append((held, sums[held], int(sums.max())))
    if not long:
        return
    long.sort(key=lambda x: x[2])
    reach = np.cumsum([x[2] for x in long])  # what the first lists give a document at most
    if reach[-1] < best.least:
        return
    cuts_ = [np.searchsorted(x[0], np.arange(0, shard.n + STRETCH, STRETCH)) for x in long]
    for k in range(len(cuts_[0]) - 1):
        least = best.least
        # A document in the lists below ``needed`` alone scores less than ``least``.
        needed = int(np.searchsorted(reach, least, side="left"))
        if needed == len(long):
            return
        first = k * STRETCH
        scores = np.zeros(STRETCH, np.int64)
        for (docs, adds, _), cut in zip(long[needed:], cuts_[needed:], strict=True):
            scores[docs[cut[k] : cut[k + 1]] - first] += adds[cut[k] : cut[k + 1]]
        docs = np.flatnonzero(scores)
        scores = scores[docs]
        for j in range(needed - 1, -1, -1):
            open_ = scores + reach[j] >= least
            docs, scores = docs[open_], scores[open_]
            if not len(docs):
                break
            own, adds = long[j][0][cuts_[j][k] : cuts_[j][k + 1]], long[j][1][cuts_[j][k] : cuts_[j][k + 1]]
            if len(own):
                at = np.minimum(np.searchsorted(own, docs + first), len(own) - 1)
                scores = scores + np.where(own[at] == docs + first, adds[at], 0)
        good = scores >= least
        if good.any():
            best.offer(shard.doc_ids[docs[good] + first], scores[good])


class Best:
    """The best ``top`` documents so far: highest score, then smallest id, nulls (NaN) last."""

    def __init__(self, top: int):
        self.top = top
        self.ids, self.scores = np.empty(0, object), np.empty(0, np.int64)
        self.least = 1

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate((self.ids, ids)), np.concatenate((self.scores, scores))
        null = np.array([i is None for i in ids], bool)
        known = np.array([0 if i is None else i for i in ids], np.int64)
        order = np.lexsort((known, null, -scores))[: self.top]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.top:
            self.least = int(self.scores[-1])  # an equal score may still have a smaller id


def _best(index: DataFrame, held, n_items: int, top: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries, n_docs, n_terms = held.value
        bests = [Best(top) for _ in range(n_items)]
        for batch in batches:
            for k in range(batch.num_rows):
                row = {
                    name: batch.column(name)[k].values.to_numpy(zero_copy_only=False)
                    for name in batch.schema.names
                    if name != "doc_ids"
                }
                row["doc_ids"] = np.array(batch.column("doc_ids")[k].as_py() + [None], object)[:-1]
                shard = Shard(row, weights, n_docs, n_terms)
                for terms, best in zip(queries, bests, strict=True):
                    search(shard, terms, best)
        sizes = [len(b.ids) for b in bests]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(n_items, dtype=np.int32), sizes)),
                pa.array([i for b in bests for i in b.ids], pa.int64()),
                pa.array(np.concatenate([b.scores for b in bests]), pa.int64()),
            ],
            names=["item", "doc_id", "score"],
        )

    return index.mapInArrow(run, BEST)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The best rows of each item, merged in two steps so that no task gets a row of every task."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.spark_partition_id(), F.lit(MERGED)).alias("part")
    some = materialise(found.select("*", part), "found")
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order)))
    some = some.where(F.col("r") <= top).drop("r", "part")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    return some.withColumn("rank", rank).where(F.col("rank") <= top)


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of each item with a score above 0.

    ``docs(doc_id, text)``, ``items(item_id, text)``. Terms are runs of letters, digits and
    characters beyond ASCII; only A-Z are lowered, and terms are compared by 64-bit hashes. A score
    sums, over the item's terms with repeats, the term's weight times a share that grows with its
    occurrences and falls with the document's length, in whole numbers. Equal scores are ranked by
    ascending id, a null id last.

    The documents are read once for each block of ``BLOCK_TERMS`` item terms, the blocks being dealt
    by hash: shards of an inverted index of these terms are written, the numbers of documents are
    summed over shards, and the shards are searched one by one (``search``). A task returns ``top``
    rows an item at most. Only these are shuffled, so a term that is in every document costs no
    more than its list.

    Every row of ``docs`` is a document, so repeated rows are ranked side by side and counted each.
    Equal rows of ``items`` are one item; rows of one id with different texts are ranked apart.
    Null and empty texts have no terms: such documents are never found and not counted, such items
    find nothing. Empty tables give no rows.
    """
    spark = docs.sparkSession
    wanted = materialise(_item_terms(items), "items")
    total = wanted.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks, out = -(-total // BLOCK_TERMS), None
    for k in range(blocks):
        mine = wanted.where((F.pmod("key", F.lit(blocks)) == k) & (F.size("terms") > 0))
        rows = mine.orderBy("item_id", "key").collect()  # about BLOCK_TERMS terms
        if not rows:
            continue
        flat = np.concatenate([np.array(r["terms"], np.int64) for r in rows]).view(np.uint64)
        vocabulary = np.unique(flat)
        index = materialise(_index(docs, spark.sparkContext.broadcast(vocabulary)), "index")
        n_docs, n_terms = index.agg(
            F.sum(F.expr("size(filter(sizes, x -> x > 0))")),
            F.sum(F.expr("aggregate(sizes, 0L, (a, x) -> a + x)")),
        ).first()
        lists = index.select(
            F.explode(F.arrays_zip("terms", F.expr("zip_with(slice(starts, 2, size(terms)), slice(starts, 1, size(terms)), (b, a) -> b - a)").alias("n"))).alias("l")
        )
        counts = lists.groupBy("l.terms").agg(F.sum("l.n").alias("n")).toArrow()
        weights = np.zeros(len(vocabulary), np.int64)
        for term, n in zip(*(c.to_pylist() for c in counts.columns), strict=True):
            weights[term] = term_weight(n_docs, n)
        queries = []
        for r in rows:
            terms = np.searchsorted(vocabulary, np.array(r["terms"], np.int64).view(np.uint64))
            queries.append(sorted(Counter(terms.tolist()).items()))
        held = spark.sparkContext.broadcast((weights, queries, n_docs or 0, n_terms or 0))
        names = spark.createDataFrame(
            [(n, r["item_id"]) for n, r in enumerate(rows)], "item int, item_id long"
        )
        best = _ranked(_best(index, held, len(rows), top), top)
        some = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = some if out is None else out.union(some)
    if out is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
