"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b); ids should be in no particular order.

    Each round points a node at its smallest neighbour, follows pointers once more, and relabels
    the edges; with ids in random order a constant share of the nodes goes each round.  Only a flag
    reaches the driver.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select("b", "a"))
        up = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("node"), F.least("a", "p").alias("p"))
        up = written(up)
        above = up.select(F.col("node").alias("p"), F.col("p").alias("comp"))
        step = written(up.join(above, "p").select("node", "comp"))
        if found is None:
            found = step
        else:
            found = written(found.join(step.select(F.col("node").alias("comp"), F.col("comp").alias("_up")), "comp", "left").select("node", F.coalesce("_up", "comp").alias("comp")))
        to_a = step.select(F.col("node").alias("a"), F.col("comp").alias("_a"))
        to_b = step.select(F.col("node").alias("b"), F.col("comp").alias("_b"))
        moved = edges.join(to_a, "a").join(to_b, "b").where("_a <> _b")
        edges = written(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
