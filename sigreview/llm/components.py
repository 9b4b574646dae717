"""Connected components of a graph given as edges, by repeated hooking on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pin


def components(edges: DataFrame) -> DataFrame:
    """Columns node and component, the smallest node that it reaches.

    ``edges`` has long columns a and b; self-loops are allowed, null ends are dropped,
    an empty table gives an empty result.  Each round turns every edge towards the smallest
    neighbour of its ends (large star, then small star) until all edges of a component
    end in its smallest node.  Only edges are held, never a component's nodes together;
    aggregates are combined before they shuffle; each round is written, which cuts the lineage.
    """
    given = pin(edges.where("a IS NOT NULL AND b IS NOT NULL").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct())
    now, loops = given.where("a != b"), given.where("a = b").select("a")
    while True:
        both = now.union(now.selectExpr("b", "a"))
        # Large star: every larger neighbour of a node is linked to the node's smallest one.
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").selectExpr("b AS a", "m AS b")
        large = large.where("a != b").distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(smallest, "a").where("b != m").selectExpr("b AS a", "m AS b")
                 .union(smallest.selectExpr("a", "m AS b"))).where("a != b").distinct()
        after = pin(small)
        # Stable when the edges are the same: every node hangs on its component's smallest.
        if after.count() == now.count() and after.join(now, ["a", "b"], "left_anti").isEmpty():
            break
        now = after
    stars = now.selectExpr("a AS node", "b AS component")
    roots = now.selectExpr("b AS node", "b AS component")
    return stars.union(roots).union(loops.join(now, "a", "left_anti").selectExpr("a", "a")).distinct()
