"""Bisection trees as two tables: nodes with tight boxes, and the leaf of every point."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import XYZ, rcb


def build(points: DataFrame, depth: int, plane: str = "median", coords: tuple[str, ...] = XYZ) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves): node, level, n and the box (xmin, xmax ...) of each node that has points; (id, node) of every point.

    Nodes are numbered as in a heap: 1 is the root, 2k and 2k + 1 are the children of k, and all leaves lie at ``depth``.
    ``median`` cuts a node at the lower median of its longest side; ``middle`` cuts the whole box into equal halves
    along the axes in turn.  The table of nodes is one aggregation over the points with their ancestors.
    """
    if plane == "median":
        at = points.select("id", *coords).join(rcb(points, depth, coords, exact=True), "id")
    elif plane == "middle":
        box = points.agg(*[f(c).alias(f"{n}{c}") for c in coords for f, n in ((F.min, "lo"), (F.max, "hi"))])
        part = F.lit(0)
        lo, hi = ({c: F.col(f"{n}{c}") for c in coords} for n in ("lo", "hi"))
        at = points.select("id", *coords).crossJoin(F.broadcast(box))  # one row
        for k in range(depth):
            c = coords[k % len(coords)]
            mid = (lo[c] + hi[c]) / 2
            at = at.withColumn(f"h{k}", F.col(c) > mid).withColumn(f"m{k}", mid)
            lo[c], hi[c] = F.when(F.col(f"h{k}"), F.col(f"m{k}")).otherwise(lo[c]), F.when(F.col(f"h{k}"), hi[c]).otherwise(F.col(f"m{k}"))
            part = part * 2 + F.col(f"h{k}").cast("int")
        at = at.select("id", *coords, part.alias("part"))
    else:
        raise ValueError(f"no such plane: {plane}")
    leaves = at.withColumn("node", (F.col("part") + (1 << depth)).cast("bigint"))
    up = leaves.select(*coords, F.explode(F.array(*[F.shiftright("node", k) for k in range(depth + 1)])).alias("node"))
    nodes = up.groupBy("node").agg(F.count("*").alias("n"), *[f(c).alias(f"{c}{n}") for c in coords for f, n in ((F.min, "min"), (F.max, "max"))])
    level = F.floor(F.log2(F.col("node").cast("double"))).cast("int")
    return nodes.select("node", level.alias("level"), "n", *[f"{c}{m}" for c in coords for m in ("min", "max")]), leaves.select("id", "node")


def descend(nodes: DataFrame, queries: DataFrame, meets: Column, depth: int) -> DataFrame:
    """(queries' columns, leaf's columns): the leaves that ``meets`` lets a query reach, level by level from the root.

    ``meets`` is over a query's and a node's columns.  What a query doesn't meet is not gone into, and each level is a
    join of the nodes still open with their children by number.
    """
    names = queries.columns
    open_ = queries.withColumn("node", F.lit(1).cast("bigint"))
    for level in range(depth + 1):
        hit = open_.join(nodes.where(F.col("level") == level), "node").where(meets)
        if level == depth:
            return hit
        open_ = hit.select(*names, F.explode(F.array(F.col("node") * 2, F.col("node") * 2 + 1)).alias("node"))
    return open_


def ray_leaves(nodes: DataFrame, rays: DataFrame, depth: int) -> DataFrame:
    """(ray, node, enter, leave): the leaf boxes that rays (ray, ox..oz, dx..dz) pass, with the interval of the parameter in each, from 0 on."""
    near, far = [], []
    inside = F.lit(True)
    for c in XYZ:
        o, d = F.col(f"o{c}"), F.col(f"d{c}")
        a, b = (F.col(f"{c}min") - o) / d, (F.col(f"{c}max") - o) / d
        near.append(F.when(d != 0, F.least(a, b)).otherwise(F.lit(0.0)))
        far.append(F.when(d != 0, F.greatest(a, b)).otherwise(F.lit(float("inf"))))
        inside = inside & ((d != 0) | o.between(F.col(f"{c}min"), F.col(f"{c}max")))
    enter, leave = F.greatest(F.lit(0.0), *near), F.least(*far)
    return descend(nodes, rays, inside & (enter <= leave), depth).select("ray", "node", enter.alias("enter"), leave.alias("leave"))


def box_leaves(nodes: DataFrame, boxes: DataFrame, depth: int, coords: tuple[str, ...] = XYZ) -> DataFrame:
    """(box, node): the leaves whose boxes meet a box (id, xlo, xhi ...)."""
    meets = reduce(lambda s, c: s & (F.col(f"{c}lo") <= F.col(f"{c}max")) & (F.col(f"{c}hi") >= F.col(f"{c}min")), coords, F.lit(True))
    asked = boxes.select(F.col("id").alias("box"), *[f"{c}{m}" for c in coords for m in ("lo", "hi")])
    return descend(nodes, asked, meets, depth).select("box", "node")
