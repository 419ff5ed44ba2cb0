"""Connected components of an edge table by repeated contraction, all in joins and aggregations.

Each round maps every node to the least node, under a hash of that round, among itself and its neighbours, and moves the
edges along; nodes of one component stay in one, and a component shrinks by a constant factor, so there are about
log(nodes) rounds. Each round is a stored table: nothing is collected, and a lost executor repeats its own tasks only.
A node with many neighbours, and the root of a giant component, are met by map-side combined aggregations and by joins that
spread a key of many rows (`attach`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import attach, stored

MOST_ROUNDS = 200


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (a bigint, b bigint); nodes of one component have one root, a node of it.

    Self-loops and repeated edges are allowed; an empty table gives an empty result.
    """
    edges = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    roots = stored(ends.select("node", F.col("node").alias("root")), "roots")
    for k in range(MOST_ROUNDS):
        if edges.isEmpty():
            return roots

        def rank(node: str, k: int = k):
            return F.struct((F.col(node) if k == 0 else F.xxhash64(F.lit(k), node)).alias("rank"), F.col(node).alias("node"))

        both = edges.select("a", rank("b").alias("to")).union(edges.select(F.col("b").alias("a"), rank("a").alias("to")))
        to = both.groupBy(F.col("a").alias("node")).agg(F.min("to").alias("to"), F.count("*").alias("n"))
        to = stored(to.select("node", F.least(rank("node"), F.col("to"))["node"].alias("to"), "n"), "to")
        size = roots.groupBy("root").agg(F.count("*").alias("size"))
        step = to.join(size, F.col("node") == F.col("root")).select("root", "to", "size")
        roots = stored(attach(roots, step, "root", "size").select("node", F.coalesce("to", "root").alias("root")), "roots")
        moved = attach(edges, to.select(F.col("node").alias("a"), F.col("to").alias("x"), "n"), "a", "n")
        moved = attach(moved, to.select(F.col("node").alias("b"), F.col("to").alias("y"), "n"), "b", "n").where("x <> y")
        edges = stored(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    raise RuntimeError("the components did not settle")
