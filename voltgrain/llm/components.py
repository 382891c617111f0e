"""Connected components by contraction: only joins and groupings on the ends of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltgrain.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for every end of a link (columns a and b).

    In each round every node takes its smallest neighbour, if smaller, as its parent, nodes move on to
    their parents' parents, and links between parents remain. Rounds go on until no link is left; their
    number grows with the logarithm of the longest path. Rounds are written to the shared folder."""
    both = links.select("a", "b").filter("a <> b")
    links = written(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found = None
    while not links.isEmpty():
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("to")))
        parent = ends.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("parent"))
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("up"))
        parent = written(parent.join(up, "parent").select("node", F.col("up").alias("parent")), "parents")
        if found is None:
            found = parent.select("node", F.col("parent").alias("root"))
        else:
            on = parent.select(F.col("node").alias("root"), "parent")
            found = written(found.join(on, "root", "left").select("node", F.coalesce("parent", "root").alias("root")), "roots")
        a, b = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa")), parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = links.join(a, "a").join(b, "b").filter("pa <> pb")
        links = written(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
