"""Connected components of an edge table, by contraction; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import fewer


def components(edges: DataFrame, rows: int) -> DataFrame:
    """``edges`` (a, b) of one orderable type, at most ``rows`` -> (node, root): the least node each node reaches.

    Every round hooks each node to its least neighbour (a map-side combined minimum, so a
    node with very many edges is no hot spot) and contracts; rounds are logarithmic in the
    longest path.  Each round is checkpointed, which cuts the lineage, in as many partitions as its edges and nodes are
    worth.  Nodes without edges do not appear.
    """
    edges = fewer(edges.where("a <> b").distinct(), rows).checkpoint()
    most = 2 * (left_over := edges.count())  # nodes
    result = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        label = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        label = fewer(label, 2 * left_over).checkpoint()
        if result is None:
            result = label
        else:
            result = result.join(label.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            result = fewer(result, most).checkpoint()
        left = label.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = label.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = edges.join(left, "a").join(right, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        edges = fewer(edges, left_over).checkpoint()
        if not (left_over := edges.count()):
            return result
