"""Connected components of a link table, by alternating stars on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeaudit.functions.plan import written


def components(links: DataFrame, a: str = "a", b: str = "b", even: bool = False) -> DataFrame:
    """(node, root): every node that has a link, with the smallest node it can reach.

    Large star hangs the larger neighbours of a node on its smallest neighbour, small star
    the smaller ones; both keep components as they are.  Rounds go on until nothing
    changes, about the logarithm of the longest path.  Minima are partial aggregates, so
    a node with a very large number of links is not collected anywhere.  Each round is
    written to the shared folder, which also cuts its lineage.  With ``even``, minima are
    written too: both sides of a join are then plain exchanges, whose largest partitions
    adaptive execution splits, where a node with a large part of all links stands.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = written(_downward(edges), "links")
    before, now = None, _digest(edges)
    while now != before:
        edges = written(_small_star(_large_star(edges, even), even), "links")
        before, now = now, _digest(edges)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.unionByName(tops)


def _digest(edges: DataFrame) -> tuple:
    """Number of links and two sums over them, equal when a round has changed nothing."""
    mixed = F.xxhash64("u", "v")
    low, high = mixed.bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(mixed, 32)
    return tuple(edges.agg(F.count("*"), F.sum(low), F.sum(high)).first())


def _downward(edges: DataFrame) -> DataFrame:
    """Each link once, from its larger node u to its smaller node v."""
    high, low = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    return edges.select(high, low).distinct()


def _minima(least: DataFrame, even: bool) -> DataFrame:
    return written(least, "link-minima") if even else least


def _large_star(edges: DataFrame, even: bool = False) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _minima(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), even)
    hung = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.distinct()


def _small_star(edges: DataFrame, even: bool = False) -> DataFrame:
    least = _minima(edges.groupBy("u").agg(F.min("v").alias("m")), even)
    hung = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
