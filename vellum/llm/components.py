"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import discard, spread_join, stored


def _least(pairs: DataFrame) -> DataFrame:
    """u, m, n: the least of each u and its partners v, and the number of these."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))


def _met(pairs: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """a, b: each partner v of u linked to m, u's least; least: _least(pairs), stored."""
    return spread_join(pairs, least, "u", "n", total).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Every partner above u is linked to the least of u and its partners."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = stored(_least(both), "least")
    out = stored(_met(both.where("v > u"), least, 2 * total), "links")
    discard(least)
    return out


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """u and its partners below are linked to the least of these."""
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = stored(_least(down), "least")
    moved = _met(down, least, total).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = stored(moved.where("a <> b").distinct(), "links")
    discard(least)
    return out


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label: every node of links(a, b: long) and the least node of its component.

    Alternates the two star operations until nothing changes; the links and the least partners of each are written to the
    shared folder, as spread_join reads its inputs several times and the plan of a round would hold the star before over
    and over. A hot centre is aggregated before the shuffle and met by broadcast (a bounded number of centres). A round
    has no more links than the one before, or a third of the nodes more. An empty table gives an empty one.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links, "links")
    mark = lambda df: df.agg(F.count("*"), F.expr("try_sum(cast(xxhash64(a, b) AS decimal(38, 0)))")).first()
    last = mark(links)
    for _ in range(rounds):
        if not last[0]:
            break
        large = _large_star(links, last[0])
        links = _small_star(large, last[0])
        discard(large)
        now = mark(links)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components: links still change after {rounds} rounds")
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
