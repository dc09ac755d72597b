"""Connected components of a graph of any size, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.session import cut


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, label: each row of ``nodes`` with the label of its component. ``edges``: a, b, in either direction or both.

    In each round every node points to its least neighbour, if that is less than itself; pointers are doubled until all point at a root,
    and edges are contracted to roots. A root takes at least one node with it, so the nodes that still have edges halve each round and the
    longest pointer chain halves each doubling: both loops end in logarithmic time, whatever the shape, and neither has a limit. Loops and
    repeated edges do no harm; an end that is not among ``nodes`` joins components but is in no row. Runs jobs.
    """
    e = cut(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = nodes.select("node", F.col("node").alias("label"))
    while e.limit(1).count():
        to = cut(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")))
        while True:
            up = to.select(F.col("node").alias("root"), F.col("root").alias("above"))
            to = cut(to.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") < F.col("root")).alias("moved")))
            moved = to.where("moved").limit(1).count()
            to = to.drop("moved")
            if not moved:
                break
        label = cut(label.join(to.select(F.col("node").alias("label"), "root"), "label", "left").select("node", F.coalesce("root", "label").alias("label")))
        ends = lambda c: to.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: E731, B023
        e = cut(e.join(ends("a"), "a").join(ends("b"), "b").where("a_root <> b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct())
    return label
