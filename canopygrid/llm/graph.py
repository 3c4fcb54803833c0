"""Connected components of links by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopygrid.llm import common as c


def _hung(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Hang neighbours below the smallest node that each node knows."""
    low = pairs.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("low"))
    joined = pairs.join(low, "node")
    if larger_only:
        return joined.filter("other > node").select(F.col("other").alias("node"), F.col("low").alias("other"))
    return joined.select(F.col("other").alias("node"), F.col("low").alias("other")).union(low.select("node", F.col("low").alias("other")))


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``src, dst`` links; the root is the component's smallest node.

    A round lets every node hang its larger neighbours, then its smaller ones,
    below the smallest it knows; the links become stars in about as many rounds
    as the logarithm of the nodes.  Only minima are gathered for a node, so one
    with many links needs no large group.
    """
    edges = links.select(F.greatest("src", "dst").alias("node"), F.least("src", "dst").alias("other")).filter("node <> other").dropDuplicates()
    edges = c.stored(edges)
    state = None
    while True:
        both = edges.union(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
        large = _hung(both, True).filter("node <> other").dropDuplicates()
        small = _hung(large, False).filter("node <> other").dropDuplicates()
        edges = c.stored(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("node", "other").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    roots = edges.select("other").distinct().select(F.col("other").alias("node"), F.col("other").alias("root"))
    return edges.select("node", F.col("other").alias("root")).union(roots)
