"""Graph traversals as loops of joins, each round cut off by a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import persist


def reach(links: DataFrame, start: DataFrame, hops: int = -1) -> DataFrame:
    """(start, node, hop): nodes that directed links (parent, child) reach in up to ``hops`` steps, each with its first hop; -1: all.

    Cycles are legal; a start is in its own result only when a link leads back to it.
    """
    edge = links.select("parent", "child").distinct()
    ring = start.select("start").distinct().select("start", F.col("start").alias("node"))
    seen, hop = None, 0
    while hop != hops:
        hop += 1
        nxt = ring.join(edge, ring.node == edge.parent).select("start", F.col("child").alias("node")).distinct()
        if seen is not None:
            nxt = nxt.join(seen, ["start", "node"], "left_anti")
        nxt = nxt.withColumn("hop", F.lit(hop))
        if hops < 0 or hops > 3:
            nxt = persist(nxt)
            if nxt.isEmpty():
                break
        seen = nxt if seen is None else seen.unionByName(nxt)
        ring = nxt.select("start", "node")
    return seen if seen is not None else start.select("start", F.col("start").alias("node"), F.lit(0).alias("hop")).limit(0)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for nodes with a smaller one in their component; edges (u, v) of bigint in any order.

    Rounds of large and small stars: every node hangs its larger neighbours on its smallest one, then its smaller ones, until all
    edges lead to roots.  The rounds grow with the logarithm of a component's size, for long chains too.
    """
    e = persist(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = persist(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = persist(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        roots = e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
        if roots and e.groupBy("u").count().where("count > 1").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
