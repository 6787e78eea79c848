"""Spatial joins by a grid: cells turn distance and containment into equi-joins."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def _cell(c: str | Column, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / size)


def squared(a: str = "", b: str = "b", coords: tuple[str, ...] = XYZ) -> Column:
    return reduce(lambda s, c: s + (F.col(f"{a}{c}") - F.col(f"{b}{c}")) * (F.col(f"{a}{c}") - F.col(f"{b}{c}")), coords[1:], (F.col(f"{a}{coords[0]}") - F.col(f"{b}{coords[0]}")) * (F.col(f"{a}{coords[0]}") - F.col(f"{b}{coords[0]}")))


def within_distance(left: DataFrame, right: DataFrame, d: float, coords: tuple[str, ...] = XYZ, strict: bool = False) -> DataFrame:
    """(a, b, dist): pairs of ids whose points are at most ``d`` (less than ``d`` if strict) apart.

    Cells have side ``d``; the left point is listed in its cell and those around it, so each pair meets once.
    """
    near = [F.sequence(_cell(c, d) - 1, _cell(c, d) + 1) for c in coords]
    a = left.select(F.col("id").alias("a"), *coords)
    for k, s in enumerate(near):
        a = a.withColumn(f"c{k}", F.explode(s))
    b = right.select(F.col("id").alias("b"), *[F.col(c).alias(f"b{c}") for c in coords], *[_cell(c, d).alias(f"c{k}") for k, c in enumerate(coords)])
    sq = squared("", "b", coords)
    hit = a.join(b, [f"c{k}" for k in range(len(coords))]).withColumn("sq", sq)
    return hit.where(F.col("sq") < d * d if strict else F.col("sq") <= d * d).select("a", "b", F.sqrt("sq").alias("dist"))


def nearest(left: DataFrame, right: DataFrame, k: int = 1, coords: tuple[str, ...] = XYZ) -> DataFrame:
    """(a, b, dist, rank): the k nearest points of ``right`` for each of ``left``, ties to the smaller id.

    Searches within a radius that doubles for those still short of k, from a typical spacing on, until none is.  Points with
    a coordinate that is null or no finite number have no distance and are left out on both sides.
    """
    from ..checkpoints import persist

    finite = reduce(lambda s, c: s & (F.abs(c) < math.inf), coords, F.lit(True))  # NaN counts as larger
    left, right = left.where(finite), right.where(finite)
    box = right.agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in coords]).first()
    if not box["n"]:
        return left.select(F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"), F.lit(None).cast("double").alias("dist"), F.lit(None).cast("int").alias("rank")).limit(0)
    k = min(k, box["n"])
    reach = [F.max(F.greatest(*[F.abs(c) for c in coords])) if len(coords) > 1 else F.max(F.abs(coords[0]))]
    largest = max(d.agg(*reach).first()[0] or 0.0 for d in (left, right))
    spans = [box[c] for c in coords if box[c] > 0]
    radius = 1.5 * (math.prod(spans) * k / box["n"]) ** (1 / len(spans)) if spans else largest
    radius = max(radius, largest * 2.0**-40) or 1.0  # cell numbers stay whole
    rest, out = left.select("id", *coords), None
    w = Window.partitionBy("a").orderBy("dist", "b")
    while True:
        got = within_distance(rest, right, radius, coords).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        full = persist(got.withColumn("m", F.count("*").over(Window.partitionBy("a"))).where(F.col("m") == k).drop("m"))
        out = full if out is None else out.unionByName(full)
        rest = persist(rest.join(full.select(F.col("a").alias("id")).distinct(), "id", "left_anti"))
        if rest.isEmpty():
            break
        radius *= 2
    return out


def points_in_boxes(points: DataFrame, boxes: DataFrame, eps: float = 0.0, coords: tuple[str, ...] = XYZ, cell: float | None = None) -> DataFrame:
    """(point, box): points within a box (``id``, ``xmin``, ``xmax`` ...) widened by eps; boxes are listed in all cells they touch.

    ``cell``: side of the grid; by default the mean side of the boxes.
    """
    if cell is None:
        mean = boxes.agg(*[F.avg(F.col(f"{c}max") - F.col(f"{c}min")).alias(c) for c in coords]).first()
        cell = max([m for m in mean if m] or [1.0]) + 2 * eps
    b = boxes.select(F.col("id").alias("box"), *[f"{c}{m}" for c in coords for m in ("min", "max")])
    for k, c in enumerate(coords):
        b = b.withColumn(f"c{k}", F.explode(F.sequence(_cell(F.col(f"{c}min") - eps, cell), _cell(F.col(f"{c}max") + eps, cell))))
    p = points.select(F.col("id").alias("point"), *coords, *[_cell(c, cell).alias(f"c{k}") for k, c in enumerate(coords)])
    inside = reduce(lambda s, c: s & F.col(c).between(F.col(f"{c}min") - eps, F.col(f"{c}max") + eps), coords[1:], F.col(coords[0]).between(F.col(f"{coords[0]}min") - eps, F.col(f"{coords[0]}max") + eps))
    return p.join(b, [f"c{k}" for k in range(len(coords))]).where(inside).select("point", "box", *coords)


def morton(cells: list[Column], bits: int = 20) -> Column:
    """Z-order key: interleaved bits of non-negative cell numbers."""
    out = F.lit(0).cast("bigint")
    n = len(cells)
    for k in range(bits):
        for j, c in enumerate(cells):
            bit = F.shiftright(c.cast("bigint"), k).bitwiseAND(F.lit(1).cast("bigint"))
            out = out.bitwiseOR(F.shiftleft(bit, k * n + j))
    return out


def rcb(points: DataFrame, depth: int, coords: tuple[str, ...] = XYZ, accuracy: int = 10_000, exact: bool = False) -> DataFrame:
    """(id, part): recursive coordinate bisection into 2**depth parts, at the median along the longest side.

    Medians of all parts of a level come from one aggregation; ``exact`` takes the lower median itself.
    """
    from ..checkpoints import persist

    out = points.select("id", *coords).withColumn("part", F.lit(0))
    for _ in range(depth):
        med = [(F.percentile(F.col(c), 0.5) if exact else F.percentile_approx(c, 0.5, accuracy)).alias(f"m{c}") for c in coords]
        cut = out.groupBy("part").agg(*med, *[(F.max(c) - F.min(c)).alias(f"w{c}") for c in coords])
        widest = F.greatest(*[F.col(f"w{c}") for c in coords]) if len(coords) > 1 else F.col(f"w{coords[0]}")
        high = F.lit(False)
        for c in reversed(coords):
            high = F.when(F.col(f"w{c}") == widest, F.col(c) > F.col(f"m{c}")).otherwise(high)
        out = out.join(F.broadcast(cut), "part").select("id", *coords, (F.col("part") * 2 + high.cast("int")).alias("part"))
        if depth > 4:
            out = persist(out)
    return out.select("id", "part")


def curve_partition(points: DataFrame, parts: int, bits: int = 16, coords: tuple[str, ...] = XYZ) -> DataFrame:
    """(id, part): slices of near-equal size along the Z-order curve."""
    from .ordered import slices

    box = points.agg(*[f(c).alias(f"{n}{c}") for c in coords for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
    cells = [F.least(F.lit((1 << bits) - 1), F.floor((F.col(c) - box[f"lo{c}"]) / (max((box[f"hi{c}"] or 0) - (box[f"lo{c}"] or 0), 1e-300)) * (1 << bits))) for c in coords]
    return slices(points.select("id", morton(cells, bits).alias("key")), ["key", "id"], parts).select("id", "part")


def tree_stats(points: DataFrame, cell: float, coords: tuple[str, ...] = XYZ) -> DataFrame:
    """Leaves of the grid index: count, least, mean, rms and greatest population."""
    leaf = points.groupBy(*[_cell(c, cell).alias(f"c{k}") for k, c in enumerate(coords)]).count()
    n = F.col("count").cast("double")
    return leaf.agg(F.count("*").alias("leaves"), F.min("count").alias("least"), F.avg(n).alias("mean"), F.sqrt(F.avg(n * n)).alias("rms"), F.max("count").alias("greatest"))
