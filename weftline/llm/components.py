"""Connected components of a graph whose edges are rows.

Alternates two rewritings of the edges (large star, small star), each of which hangs neighbours on the
least node of a neighbourhood, until every component is one star on its least node. It takes a number of
rounds that grows with the logarithm of the graph's size; each is written to the shared folder, so a lost
executor costs at most a round. Least neighbours are taken before the shuffle (partial minima). They are
joined back to the edges by broadcast while the edges are counted to be few, else from a written table, so
that both sides are plain shuffles, whose hot nodes Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import drop, save

#: Edges up to which the least neighbours (a row for each node) are broadcast.
FEW = 300_000


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v), of any type with an order. Gives (node, root) for each node that has an edge to another; root is its component's least node."""
    old, now = None, save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark != old:
        after, beside = _round(now, mark[0] <= FEW)
        for used in (now, *beside):
            drop(used)
        now, old, mark = after, mark, _mark(after)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Their number, and a sum that is equal for equal sets of edges, and (but for chance) only for those. One row."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _round(edges: DataFrame, few: bool) -> tuple[DataFrame, list[DataFrame]]:
    """The edges after both rewritings, and what was written on the way."""
    beside: list[DataFrame] = []

    def side(least: DataFrame) -> DataFrame:
        if few:
            return F.broadcast(least)
        beside.append(save(least, "least"))
        return beside[-1]

    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(side(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    if not few:
        large = save(large, "large")
        beside.append(large)
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    hung = large.join(side(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return save(hung.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges"), beside
