"""Connected components by contraction: every node joins its smallest neighbour, edges follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes of edges (a, b); root is one node of each component.

    Each round keeps one edge per pair of contracted nodes, so a star or a dense group is
    gone after one round, and long chains shrink by a constant factor. Every round is
    written to the shared folder; no group is ever gathered.
    """
    left = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mapping = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy("a").agg(F.min("b").alias("_b")).select(F.col("a").alias("node"), F.least("a", "_b").alias("root")), "step")
        if mapping is None:
            mapping = step
        else:
            onward = step.select(F.col("node").alias("_at"), F.col("root").alias("_to"))
            mapping = stored(mapping.join(onward, F.col("root") == F.col("_at"), "left").select("node", F.coalesce("_to", "root").alias("root")), "mapping")
        a, b = (step.select(F.col("node").alias(x), F.col("root").alias(f"_{x}")) for x in "ab")
        moved = left.join(a, "a").join(b, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        left = stored(moved.where("a <> b").distinct(), "edges")
    return mapping if mapping is not None else left.select(F.col("a").alias("node"), F.col("b").alias("root"))
