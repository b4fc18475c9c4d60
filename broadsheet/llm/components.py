"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the smaller and own) neighbours of each node on its smallest one."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("of"), F.least("a", "low").alias("low"))
    joined = both.join(lowest, both["a"] == lowest["of"])
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = joined.select("a", F.col("low").alias("b")).unionByName(joined.select(F.col("b").alias("a"), F.col("low").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for links ``a, b``: the smallest node that each linked node reaches.

    Nodes without a link have no row; NULL ends and loops are no links. Each round is two
    joins over the links, cut by a checkpoint; rounds grow with the logarithm of a
    component's size. The state has at most as many rows as there are links. A node with
    very many neighbours meets as a partial minimum, and its join is split when skewed.
    """
    edges = links.select("a", "b").filter("a <> b").distinct()
    edges = cut_lineage(edges)
    before = None
    while True:
        edges = cut_lineage(_star(_star(edges, True), False))
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            break
        before = now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)
