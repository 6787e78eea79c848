"""Structured boxes: connectivity by arithmetic on i, j, k, never stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.topology import CODE
from .mesh import Mesh

Box = tuple[int, int, int, int, int, int]


def _counts(box: Box, periodic: tuple[bool, bool, bool]) -> tuple[list[int], list[int]]:
    """Vertices and cells along each axis; a periodic axis has as many vertices as cells."""
    cells = [box[3 + a] - box[a] for a in range(3)]
    return [max(1, n + (not p)) if n else 1 for n, p in zip(cells, periodic, strict=True)], cells


def params(index: Column, n: list[int], box: Box) -> tuple[Column, Column, Column]:
    """(i, j, k) of a running number."""
    i, j, k = index % n[0], F.floor(index / n[0]) % n[1], F.floor(index / (n[0] * n[1]))
    return i + box[0], j + box[1], k + box[2]


def number(i: Column, j: Column, k: Column, n: list[int], box: Box) -> Column:
    return (i - box[0]) + n[0] * ((j - box[1]) + n[1] * (k - box[2]))


def brick(spark: SparkSession, box: Box, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), periodic: tuple[bool, bool, bool] = (False, False, False), first: int = 1) -> Mesh:
    """Vertices and hexes (quads, edges for flat boxes) of a box of cells, as expressions over a range."""
    nv, nc = _counts(box, periodic)
    v = spark.range(nv[0] * nv[1] * nv[2])
    ijk = params(F.col("id"), nv, box)
    vertex = v.select((F.col("id") + first).alias("id"), *[(c * s).cast("double").alias(a) for c, s, a in zip(ijk, spacing, "xyz", strict=True)])
    dim = sum(n > 0 for n in nc)
    e = spark.range(max(1, nc[0]) * max(1, nc[1]) * max(1, nc[2]))
    i, j, k = params(F.col("id"), [max(1, n) for n in nc], box)

    def at(di: int, dj: int, dk: int) -> Column:
        p = [c + d for c, d in zip((i, j, k), (di, dj, dk), strict=True)]
        p = [(c - box[a]) % nv[a] + box[a] if periodic[a] else c for a, c in enumerate(p)]
        return (number(*p, nv, box) + first).cast("bigint")

    ring = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0)]
    corners = {1: ring[:2], 2: ring, 3: ring + [(a, b, 1) for a, b, _ in ring]}[dim]
    kind = {1: "edge", 2: "quad", 3: "hex"}[dim]
    element = e.select(F.lit(CODE[kind]).cast("tinyint").alias("etype"), (F.col("id") + first).alias("id"), F.array(*[at(*c) for c in corners]).alias("conn"))
    return Mesh.build(vertex, element)


def box_skin(spark: SparkSession, box: Box) -> DataFrame:
    """(i, j, k, axis, end): the boundary faces of a box, by arithmetic: only they are made."""
    n = [box[3 + a] - box[a] for a in range(3)]
    out = None
    for axis in range(3):
        u, w = [a for a in range(3) if a != axis]
        plane = spark.range(n[u] * n[w])
        pos = [None, None, None]
        pos[u], pos[w] = F.col("id") % n[u] + box[u], F.floor(F.col("id") / n[u]) + box[w]
        for end, at in ((0, box[axis]), (1, box[3 + axis] - 1)):
            pos[axis] = F.lit(at)
            part = plane.select(*[p.cast("bigint").alias(c) for p, c in zip(pos, "ijk", strict=True)], F.lit("ijk"[axis]).alias("axis"), F.lit(end).alias("end"))
            out = part if out is None else out.unionByName(part)
    return out


def compose(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    """Product of integer 4x4 transforms."""
    return [[sum(a[i][k] * b[k][j] for k in range(4)) for j in range(4)] for i in range(4)]


def three_points(p: list[tuple[int, int, int]], q: list[tuple[int, int, int]]) -> list[list[int]]:
    """The integer transform (axis turns and a shift) that takes three points to three others.

    The points span two axes; the third axis follows by the right hand.
    """
    def frame(x: list[tuple[int, int, int]]) -> list[list[int]]:
        def unit(a, b):  # noqa: ANN001, ANN202
            d = [m - n for m, n in zip(b, a, strict=True)]
            size = max(map(abs, d))
            if sum(m != 0 for m in d) != 1:
                raise ValueError("points must lie along axes")
            return [m // size for m in d]

        u, w = unit(x[0], x[1]), unit(x[0], x[2])
        n = [u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0]]
        return [u, w, n]

    a, b = frame(p), frame(q)
    r = [[sum(b[k][i] * a[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
    shift = [q[0][i] - sum(r[i][j] * p[0][j] for j in range(3)) for i in range(3)]
    return [[*r[i], shift[i]] for i in range(3)] + [[0, 0, 0, 1]]
