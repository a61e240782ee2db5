"""Connected components: edges are contracted while that halves them, then come alternating stars (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohort.operators.staging import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of its neighbourhood."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    lowest = both.groupBy("src").agg(F.min("dst").alias("_low")).select("src", F.least("src", "_low").alias("root"))
    return both.filter("dst > src").join(lowest, "src").select(F.col("dst").alias("src"), F.col("root").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; edges point downwards."""
    lowest = edges.groupBy("src").agg(F.min("dst").alias("root"))
    moved = edges.join(lowest, "src").select(F.col("dst").alias("src"), F.col("root").alias("dst"))
    own = lowest.select("src", F.col("root").alias("dst"))
    return moved.unionByName(own).filter("src <> dst").distinct()


def _lowest(edges: DataFrame) -> DataFrame:
    """``(node, low)``: the smallest of each node and its neighbours."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.groupBy("src").agg(F.min("dst").alias("_low")).select(F.col("src").alias("node"), F.least("src", "_low").alias("low"))


def _downwards(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).filter("src <> dst").distinct()


def _contracted(edges: DataFrame, low: DataFrame) -> DataFrame:
    """The edges between what their ends are named after."""
    for end in ("src", "dst"):
        edges = edges.join(low.withColumnsRenamed({"node": end, "low": "_low"}), end).drop(end).withColumnRenamed("_low", end)
    return _downwards(edges)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, component)``; the component is its smallest node, and lone nodes keep their own.

    First every node is named after the smallest node next to it, and the edges between the names are taken for the graph. That
    keeps what is connected, since the edge from a node to its name stays or has both ends alike. Graphs of short paths lose most
    of their edges in a round or two; once two rounds do not halve them, as with long chains, stars do the rest, in rounds that
    have no limit. Names lead back to all nodes.

    Each round is a few hash aggregations and joins. Minimums are combined before the shuffle,
    and the join that follows meets one row per node, which adaptive execution splits when a hub
    owns much of the edge list. Each is written out, so lost executors re-read files and not the whole history.
    """
    current, levels = stage(_downwards(edges)), []
    sizes = [current.count()]
    while sizes[-1] and (len(sizes) < 3 or 2 * sizes[-1] <= sizes[-3]):
        levels.append(stage(_lowest(current)))
        current = stage(_contracted(current, levels[-1]))
        sizes.append(current.count())
    while not _settled(current):
        current = stage(_small_star(_large_star(current)))
    roots = current.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    for low in reversed(levels):
        inner = roots.withColumnRenamed("node", "low")
        roots = low.join(inner, "low", "left").select("node", F.coalesce("component", "low").alias("component"))
    return nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _settled(edges: DataFrame) -> bool:
    """Whether the edges, which point downwards, are stars already: every node has one end, and no end has one itself."""
    if not edges.join(edges.select(F.col("dst").alias("src")), "src", "left_semi").isEmpty():
        return False
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
