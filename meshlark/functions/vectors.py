"""Three-vectors as tuples of columns (or floats), 3x3 maths, and geometric predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple


def at(col: str) -> Vec:
    """A struct<x,y,z> column as a vector."""
    return tuple(F.col(f"{col}.{c}") for c in "xyz")


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def mul(s, a: Vec) -> Vec:  # noqa: ANN001
    return tuple(p * s for p in a)


def dot(a: Vec, b: Vec):  # noqa: ANN201
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def sq(a: Vec):  # noqa: ANN201
    return dot(a, a)


def norm(a: Vec) -> Column:
    return F.sqrt(sq(a))


def det(a: Vec, b: Vec, c: Vec):  # noqa: ANN201
    return dot(a, cross(b, c))


def total(vs: list[Vec]) -> Vec:
    return reduce(add, vs)


def struct(a: Vec) -> Column:
    return F.struct(*[p.alias(c) for p, c in zip(a, "xyz", strict=True)])


def degrees_between(a: Vec, b: Vec) -> Column:
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b))))))


def inverse(m: list[Vec]) -> list[Vec]:
    """Inverse of the matrix with these rows."""
    d = det(*m)
    cols = [cross(m[1], m[2]), cross(m[2], m[0]), cross(m[0], m[1])]
    return [tuple(cols[j][i] / d for j in range(3)) for i in range(3)]


def barycentric_tet(p: Vec, corners: list[Vec]) -> list[Column]:
    """Weights of a tet's four corners at a point; they add to one."""
    a, b, c, d = corners
    six = det(sub(b, a), sub(c, a), sub(d, a))
    w = [det(sub(p, a), sub(c, a), sub(d, a)) / six, det(sub(b, a), sub(p, a), sub(d, a)) / six, det(sub(b, a), sub(c, a), sub(p, a)) / six]
    return [1 - w[0] - w[1] - w[2], *w]


def barycentric_tri(p: Vec, corners: list[Vec]) -> list[Column]:
    """Weights of a triangle's corners at the point's projection onto its plane."""
    a, b, c = corners
    n = cross(sub(b, a), sub(c, a))
    nn = sq(n)
    v, w = dot(cross(sub(p, a), sub(c, a)), n) / nn, dot(cross(sub(b, a), sub(p, a)), n) / nn
    return [1 - v - w, v, w]


def ray_triangle(origin: Vec, direction: Vec, corners: list[Vec], tol: float = 0.0) -> Column:
    """Distance along the ray at which it meets the triangle, null if it doesn't.

    By signed volumes of the ray with the edges: the three must have one sign, so the
    edge that two triangles share is never missed.
    """
    def side(p: Vec, q: Vec) -> Column:
        return det(direction, sub(p, origin), sub(q, origin))

    a, b, c = corners
    s = [side(a, b), side(b, c), side(c, a)]
    hit = ((s[0] >= -tol) & (s[1] >= -tol) & (s[2] >= -tol)) | ((s[0] <= tol) & (s[1] <= tol) & (s[2] <= tol))
    n = cross(sub(b, a), sub(c, a))
    along = dot(n, direction)
    t = dot(n, sub(a, origin)) / F.nullif(along, F.lit(0.0))
    return F.when(hit & (along != 0) & (t >= 0), t)


def closest_on_triangle(p: Vec, corners: list[Vec]) -> Column:
    """struct<x,y,z>: the triangle's point nearest to p: its projection if inside, else the nearest on the edges.

    What is used several times is bound by a one-element transform, which keeps the expression small.
    """
    field = lambda s, n: tuple(s[f"{n}{c}"] for c in "xyz")
    named = lambda v, n: [q.alias(f"{n}{c}") for q, c in zip(v, "xyz", strict=True)]

    def on_edge(e: Column) -> Column:
        u, d, q = field(e, "u"), sub(field(e, "v"), field(e, "u")), field(e, "p")
        part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(sub(q, u), d) / sq(d)))
        at_ = F.transform(F.array(part), lambda k: F.struct(*named(add(u, mul(k, d)), "w")))[0]
        return F.transform(F.array(at_), lambda w: F.struct(sq(sub(field(w, "w"), q)).alias("d"), *[w[f"w{c}"].alias(c) for c in "xyz"]))[0]

    def best(s: Column) -> Column:
        a, b, c, q = (field(s, n) for n in "abcp")
        edges = F.array(*[F.struct(*named(u, "u"), *named(v, "v"), *named(q, "p")) for u, v in ((a, b), (b, c), (c, a))])
        weights = F.transform(F.array(F.array(*barycentric_tri(q, [a, b, c]))), lambda w: F.struct(w.alias("w"), F.array_min(w).alias("least")))[0]
        edge = F.array_min(F.transform(edges, on_edge))
        flat = lambda w: F.struct(*[(w[0] * x + w[1] * y + w[2] * z).alias(n) for x, y, z, n in zip(a, b, c, "xyz", strict=True)])
        return F.transform(F.array(weights), lambda w: F.when(w["least"] >= 0, flat(w["w"])).otherwise(F.transform(F.array(edge), lambda e: F.struct(e["x"].alias("x"), e["y"].alias("y"), e["z"].alias("z")))[0]))[0]

    whole = F.struct(*named(corners[0], "a"), *named(corners[1], "b"), *named(corners[2], "c"), *named(p, "p"))
    return F.transform(F.array(whole), best)[0]


def box_overlaps_triangle(center: Vec, half: Vec, corners: list[Vec], tol: float = 0.0) -> Column:
    """Separating axes: the box's three, the triangle's normal, and the nine crosses of edges."""
    v = [sub(q, center) for q in corners]
    edges = [sub(v[1], v[0]), sub(v[2], v[1]), sub(v[0], v[2])]
    unit = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)]
    lits = [tuple(F.lit(x) for x in u) for u in unit]
    axes = [*lits, cross(edges[0], edges[1]), *[cross(u, e) for u in lits for e in edges]]
    out = F.lit(True)
    for axis in axes:
        on = [dot(axis, q) for q in v]
        r = F.abs(axis[0]) * half[0] + F.abs(axis[1]) * half[1] + F.abs(axis[2]) * half[2] + tol
        out = out & (F.least(*on) <= r) & (F.greatest(*on) >= -r)
    return out


def solid_angle(p: Vec, corners: list[Vec]) -> Column:
    """Signed solid angle of a triangle seen from p."""
    a, b, c = (sub(q, p) for q in corners)
    la, lb, lc = norm(a), norm(b), norm(c)
    return 2 * F.atan2(det(a, b, c), la * lb * lc + dot(a, b) * lc + dot(b, c) * la + dot(c, a) * lb)
