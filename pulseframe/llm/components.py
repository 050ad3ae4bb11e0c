"""Connected components of a graph given as links, by alternating star contractions.

Every round replaces links by links to smaller nodes and ends when nothing changes:
a large star joins each node's larger neighbours to its smallest neighbour, a small
star its smaller ones.  Work per round is a minimum per node (partial before the
shuffle) and a join on the node, which adaptive execution splits when one node has
very many links.  Rounds are written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One contraction; ``links`` has a, b and no self links."""
    if large:
        both = links.union(links.select("b", "a")).toDF("a", "b")
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "k")
    joined = both.join(least, both["a"] == least["k"])
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """Rows ``node, component`` for every node of ``links`` (a, b); component is its smallest node.

    Self links and repeated links do not matter; nodes without a link are not returned.
    """
    links = written(links.where("a <> b").select("a", "b").distinct(), "links")
    seen = None
    while True:
        links = written(_star(_star(links, large=True), large=False), "links")
        # Order-free fingerprint of the links: the fixpoint has been reached when it stays.
        row = links.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum((F.xxhash64("b", "a") % 1000003))
        ).first()
        if tuple(row) == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                links.select("b", "b").distinct()
            )
        seen = tuple(row)
