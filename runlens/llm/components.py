"""Connected components of a link table by hooking and contraction, all in DataFrames.

Each round every node hooks to its smallest neighbour, paths are halved, and links between contracted nodes go on to
the next round; the number of nodes with links falls by a constant factor each time. Every round is written to the
shared folder, so a lost executor costs a retry of the round. Nothing but counts reaches the driver.

Defined results: links in both directions, repeated links and links of a node to itself are harmless; links with a null
end take no part; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.session import discard, materialise


def components(spark, links: DataFrame) -> DataFrame:
    """links: (a, b). Returns (node, root) for every node of a link; root is one node of the component, the same for all."""
    both = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = materialise(spark, both)
    labels = materialise(spark, edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")))
    while not edges.isEmpty():
        ends = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = materialise(spark, ends.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("v")).select("u", F.least("u", "v").alias("p")))
        jump = near.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        hook = materialise(spark, near.join(jump, "p").select("u", F.col("pp").alias("p")))
        at = lambda name: hook.select(F.col("u").alias(name), F.col("p").alias(f"{name}_to"))
        old = (near, hook, labels, edges)
        labels = materialise(spark, labels.join(at("root"), "root", "left").select("node", F.coalesce("root_to", "root").alias("root")))
        left = edges.join(at("a"), "a").join(at("b"), "b").where("a_to <> b_to")
        edges = materialise(spark, left.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct())
        discard(*old)
    discard(edges)
    return labels
