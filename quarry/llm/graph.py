"""Connected components of an edge table, with every step distributed and lineage cut by written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import drop_table, stage_table


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b); the root is the smallest node of its component.

    Large-star and small-star steps alternate: each links a node's neighbours to the smallest one known, which
    keeps the number of edges and needs about as many rounds as the logarithm of the longest path.  Stops when
    a round changes nothing.
    """
    edges = stage_table(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        following = stage_table(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        same = following.count() == edges.count() and following.join(edges, ["a", "b"], "left_anti").isEmpty()
        drop_table(edges)
        edges = following
        if same:
            break
    linked = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return linked.unionByName(linked.select(F.col("root").alias("node"), "root").distinct())
