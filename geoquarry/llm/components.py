"""Connected components of a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def _star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours linked to the smallest node next to it (or itself)."""
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    # Minima are written before they are joined, so that a node's many neighbours can be split.
    least = materialise(least.select("a", F.least("a", "least").alias("least")), "least")
    return (
        both.join(least, "a")
        .where("b > a")
        .select(F.col("b").alias("a"), F.col("least").alias("b"))
        .where("a != b")
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours linked to the smallest of them; links have a > b."""
    least = materialise(links.groupBy("a").agg(F.min("b").alias("least")), "least")
    moved = links.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    own = least.select("a", F.col("least").alias("b"))
    return moved.union(own).where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; ``root`` is the smallest one reachable.

    Links may repeat, run both ways or join a node to itself; a null on either side is no link.
    Groups are never gathered: a round takes minima and joins them back, then is written to the
    shared folder, until a round changes nothing.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL")
    self_linked = links.where("a = b").select(F.col("a").alias("node"))
    state = materialise(
        links.where("a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    size = _size(state)
    while True:
        after = materialise(_small_star(materialise(_star(state), "star")), "links")
        now = _size(after)
        if now == size:
            break
        state, size = after, now
    roots = after.groupBy("a").agg(F.min("b").alias("root"))
    nodes = roots.select(F.col("a").alias("node"), "root")
    centres = roots.select(F.col("root").alias("node"), "root").distinct()
    alone = self_linked.select("node", F.col("node").alias("root"))
    return nodes.union(centres).union(alone).groupBy("node").agg(F.min("root").alias("root"))


def _size(links: DataFrame) -> tuple:
    """Number of links and two sums over them; equal sizes mean that a round changed nothing."""
    return tuple(
        links.agg(
            F.count("*"),
            F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")),
            F.bit_xor(F.xxhash64("a", "b")),
        ).first()
    )
