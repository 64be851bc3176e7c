"""Exact duplicates: owners of equal texts in Patricia tries over partitions by length and hash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .batches import cuts
from .keys import filter_words

#: Bytes of the texts a trie holds before its largest subtree is spilled.
TRIE_BYTES = 64 << 20
#: Parts of each partition by length and hash in the first round, so that no text meets all its copies.
SALTS = 64


class Node:
    """A node of the trie: the bytes on the way to it, its children by first byte, what ends here."""

    __slots__ = ("label", "children", "owner")

    def __init__(self, label: bytes, owner: list | None = None):
        self.label, self.owner, self.children = label, owner, {}


class Trie:
    """A compressed radix trie of byte strings; a terminal keeps the best document and the count.

    An owner is ``[null mark, id, row, count, node]``. The best is the largest (or smallest) id, a
    null is worse than any; of equal ids the row with the smallest number.
    """

    def __init__(self, largest: bool):
        self.root, self.size = Node(b""), 0
        self.sign = -1 if largest else 1

    def insert(self, text: bytes, owner: list) -> list:
        """Put a text in; returns the owner of its terminal, merged with ``owner``."""
        node, at = self.root, 0
        while True:
            if at == len(text):
                if node.owner is None:
                    node.owner = owner
                    self.size += 64
                elif node.owner is not owner:
                    self._merge(node.owner, owner)
                return node.owner
            child = node.children.get(text[at])
            if child is None:
                node.children[text[at]] = Node(text[at:], owner)
                self.size += len(text) - at + 128
                return owner
            label = child.label
            if not text.startswith(label, at):
                same = self._shared(label, text, at)
                middle = Node(label[:same])
                child.label = label[same:]
                middle.children[child.label[0]] = child
                node.children[text[at]] = middle
                self.size += 128
                node, at = middle, at + same
            else:
                node, at = child, at + len(label)

    @staticmethod
    def _shared(label: bytes, text: bytes, at: int) -> int:
        """Length of the common beginning, by halving."""
        low, high = 0, min(len(label), len(text) - at)
        while low < high:
            middle = (low + high + 1) // 2
            if text.startswith(label[:middle], at):
                low = middle
            else:
                high = middle - 1
        return low

    def _merge(self, held: list, new: list) -> None:
        if (new[0], self.sign * new[1], new[2]) < (held[0], self.sign * held[1], held[2]):
            held[:3] = new[:3]
        held[3] += new[3]

    @staticmethod
    def walk(node: Node, before: bytes = b"") -> Iterator[tuple[bytes, list]]:
        """All texts below a node with their owners."""
        stack = [(node, before)]
        while stack:
            node, before = stack.pop()
            text = before + node.label
            if node.owner is not None:
                yield text, node.owner
            stack += [(c, text) for c in node.children.values()]

    def spill(self) -> tuple[bytes, Iterator[tuple[bytes, list]]]:
        """Take the largest subtree out, below the first node that branches: its prefix and texts."""
        node, before = self.root, b""
        while len(node.children) == 1 and node.owner is None:
            (node,) = node.children.values()
            before += node.label
        if node.children:
            weights = {b: self._weight(c) for b, c in node.children.items()}
            first = max(weights, key=weights.get)
            taken = node.children.pop(first)
            prefix = before + bytes([first])
        else:  # one text alone
            taken, prefix, before = self.root, before, b""
            self.root = Node(b"")
        self.size = self._weight(self.root)
        return prefix, self.walk(taken, before)

    @staticmethod
    def _weight(node: Node) -> int:
        size, stack = 0, [node]
        while stack:
            node = stack.pop()
            size += len(node.label) + 128
            stack += node.children.values()
        return size


#: A row of a document has its number, id, digest and the node of the trie it went to (null: no
#: other row can have its text). A row of a node has a text: what the trie knew of it in the end.
ROWS = "row long, node long, doc_id long, digest binary, n_bytes long, hash long, best long, best_row long, n long, text binary"


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    """The normalised texts: bytes.lower changes A-Z alone."""
    return [(t or b"").lower() for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _keys(docs: DataFrame) -> DataFrame:
    """``(n_bytes, hash)`` of each row's normalised text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cuts(batches):
            texts = _texts(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(map(len, texts), pa.int64()),
                    pa.array([_signed(xxhash.xxh64_intdigest(t)) for t in texts], pa.int64()),
                ],
                names=["n_bytes", "hash"],
            )

    return docs.mapInArrow(run, "n_bytes long, hash long")


def _made(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Batches of some rows each, so that their texts are held a few at a time."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    rows = iter(rows)
    while some := list(islice(rows, 256)):
        columns = zip(*some, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)],
            names=[n for n, _ in fields],
        )


def _first_tries(docs: DataFrame, held, largest: bool, limit: int) -> DataFrame:
    """``ROWS``: each task puts its texts that may be shared into a trie, before any shuffle."""

    def of_node(text: bytes, owner: list, n_bytes: int, hash_: int) -> tuple:
        null, best, best_row, n, node = owner
        return (None, node, None, None, n_bytes, hash_, None if null else best, best_row, n, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        bits, trie, keys = held.value, Trie(largest), {}
        for batch in cuts(batches):
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), _texts(batch), strict=True):
                digest, hash_ = hashlib.sha256(text).digest(), xxhash.xxh64_intdigest(text)
                place = hash_ & (64 * len(bits) - 1)
                node = None
                if int(bits[place >> 6]) >> (place & 63) & 1:
                    node = trie.insert(text, [doc is None, doc or 0, row, 1, row])[4]
                    keys[node] = len(text), _signed(hash_)
                out.append((row, node, doc, digest, *[None] * 6))
                row += 1
                while trie.size > limit:
                    yield from _made((of_node(t, o, *keys.pop(o[4])) for t, o in trie.spill()[1]), ROWS)
            yield from _made(out, ROWS)
        yield from _made((of_node(t, o, *keys[o[4]]) for t, o in trie.walk(trie.root)), ROWS)

    return docs.mapInArrow(run, ROWS)


MERGED = "node long, owner long, best long, best_row long, n long, n_bytes long, hash long, round int, text binary"


def _merge(nodes: DataFrame, largest: bool, limit: int, round_: int) -> DataFrame:
    """``MERGED`` rows for nodes with a text, in tries over the partitions they were dealt to.

    Each node's row names the owner it met. The owner's own row has the text and what is known of
    it; ``round`` is null there, or the next round if its subtree was spilled. Once that is so, all
    texts with the subtree's prefix go on to that round.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, keys, gone = Trie(largest), {}, ()

        def own(text: bytes, owner: list, later: int | None) -> tuple:
            null, best, best_row, n, node = owner
            return (node, node, None if null else best, best_row, n, *keys.pop(node), later, text)

        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("node", "best", "best_row", "n", "n_bytes", "hash", "text"))
            for node, best, best_row, n, n_bytes, hash_, text in zip(*columns, strict=True):
                mine = [best is None, best or 0, best_row, n, node]
                if gone and text.startswith(gone):
                    keys[node] = n_bytes, hash_
                    out.append(own(text, mine, round_ + 1))
                    continue
                owner = trie.insert(text, mine)
                if owner is mine:
                    keys[node] = n_bytes, hash_
                else:
                    out.append((node, owner[4], *[None] * 7))
                while trie.size > limit and len(keys) > 1:
                    prefix, found = trie.spill()
                    gone = (*gone, prefix)
                    yield from _made((own(t, o, round_ + 1) for t, o in found), MERGED)
            yield from _made(out, MERGED)
        yield from _made((own(t, o, None) for t, o in trie.walk(trie.root)), MERGED)

    return nodes.select("node", "best", "best_row", "n", "n_bytes", "hash", "text").mapInArrow(run, MERGED)


def _settled(nodes: DataFrame, largest: bool, limit: int, deal: list, name: str) -> tuple[DataFrame, DataFrame]:
    """``(node, owner)`` of all nodes, and the owners' rows, after rounds until nothing is spilled.

    A spilled subtree's texts are dealt anew by another hash of length and hash, so they meet other
    texts, and their own copies again.
    """
    spark = nodes.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links, done, round_ = [], [], 0
    while True:
        dealt = nodes.repartition(width << round_, *deal, F.lit(round_))
        merged = materialise(_merge(dealt, largest, limit, round_), name)
        links.append(merged.where("text IS NULL").select("node", "owner"))
        done.append(merged.where("text IS NOT NULL AND round IS NULL"))
        nodes = merged.where("round IS NOT NULL")
        if nodes.isEmpty():
            break
        round_ += 1
    owners = done[0]
    for part in done[1:]:
        owners = owners.union(part)
    # A node met an owner in one round, and that owner another one in a later round.
    final = owners.select("node", "owner")
    for part in reversed(links):
        met = part.alias("p").join(final.alias("f"), F.col("p.owner") == F.col("f.node"))
        final = materialise(final.union(met.select("p.node", "f.owner")), "owners")
    return final, owners


def exact_groups(
    docs: DataFrame, largest: bool = True, limit: int = TRIE_BYTES, salts: int = SALTS
) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for each row of ``docs(doc_id, text)``.

    Texts are equal when they are the same bytes after A-Z are lowered; a null text is empty. The
    row with the ``largest`` (or else the smallest) id of a group stays, a null id only where there
    is no other; of rows equal in id and text one stays. ``text_sha256`` is that of the lowered text.

    1. Rows are counted by length and hash of the text. A filter of bounded size tells those apart
       whose key no other row has; their texts go nowhere.
    2. Each task puts the texts of the others into a Patricia trie, whose terminals hold the best id
       and a count, so a text leaves a task once, however many copies it has there.
    3. Texts are dealt by length and hash, at first in ``salts`` parts, then once more without: so
       tasks of the last round get ``salts`` copies of a text at most. Whole byte strings decide, the
       hash alone never does.

    A trie above ``limit`` bytes spills its largest subtree. In (2) the subtree's texts leave the
    task at once; in (3) they are written to the shared folder with what is known of them and tried
    again in another round. A text longer than ``limit`` is held alone. Lost executors cost tasks;
    numbers of rows are drawn once and written.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    shared = materialise(_keys(rows).groupBy("n_bytes", "hash").count().where("count > 1"), "keys")
    words, bits = filter_words(shared)
    table = words.toArrow()  # a million words at most
    held = np.zeros(bits // 64, np.uint64)
    held[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    first = materialise(
        _first_tries(rows, docs.sparkSession.sparkContext.broadcast(held), largest, limit), "tries"
    )
    nodes = first.where("text IS NOT NULL")
    part = F.pmod(F.xxhash64("node"), F.lit(salts))
    met, owners = _settled(nodes, largest, limit, ["n_bytes", "hash", part], "salted")
    again, groups = _settled(owners, largest, limit, ["n_bytes", "hash"], "merged")
    owned = met.alias("a").join(again.alias("b"), F.col("a.owner") == F.col("b.node"))
    groups = groups.select("owner", F.col("best").alias("keep_id"), "best_row", F.col("n").alias("group_size"))
    found = materialise(owned.select("a.node", "b.owner").join(groups, "owner").drop("owner"), "groups")
    of_rows = first.where("text IS NULL").select("row", "node", "doc_id", "digest")
    digest = F.lower(F.hex("digest")).alias("text_sha256")
    several = of_rows.join(found, "node").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("best_row")).alias("kept"), digest
    )
    single = of_rows.where("node IS NULL").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), digest,
    )
    return single.union(several)
