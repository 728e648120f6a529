"""Connected components of an edge table, as alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trawlframe.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long): component is
    the smallest node reachable.

    Self loops and repeated or null-ended edges are harmless; an empty table gives an empty
    table. Each round links every node's larger neighbours to its smallest
    neighbour (large star), then its smaller ones (small star), until only stars
    around the smallest nodes are left: O(log n) to O(log² n) rounds. The driver
    sees one number per round. Minima are combined before the shuffle, so a node
    with very many neighbours is no hot task; the joins back to the edges are
    plain equi-joins that Spark may split.
    """
    links = stored(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
                   .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        # Large star: in both directions, every larger neighbour of a node goes to the smallest of its neighbours and itself.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: the node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").selectExpr("IF(b = m, a, b) AS a", "m AS b").distinct()
        links = stored(small, "edges")
        # Done when a round changes nothing: count and hash sum of the edges stay.
        seen = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == before or not seen[0]:
            break
        before = seen
    return links.selectExpr("a AS node", "b AS component").unionByName(
        links.selectExpr("b AS node", "b AS component").distinct())
