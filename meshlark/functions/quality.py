"""Element quality metrics as column expressions over corner coordinates p0, p1, ... (struct<x,y,z>).

Each metric is written once over the table of an element's corners.  Degenerate
elements give what the named bound says: HUGE for ratios without an upper bound, 0 for measures of goodness.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors as v
from .topology import CODE, EDGES, FACES

HUGE = 1e30
TINY = 1e-30


def _ratio(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) < TINY, F.lit(HUGE)).otherwise(F.least(a / b, F.lit(HUGE)))


def _good(a: Column, b: Column) -> Column:
    return F.when(b < TINY, F.lit(0.0)).otherwise(a / b)


def _points(name: str) -> list[v.Vec]:
    n = {"tri": 3, "quad": 4, "tet": 4, "pyramid": 5, "prism": 6, "knife": 7, "hex": 8, "edge": 2}[name]
    return [v.at(f"p{k}") for k in range(n)]


def _edges(name: str) -> list[v.Vec]:
    p = _points(name)
    return [v.sub(p[b], p[a]) for a, b in EDGES[name]]


def _sizes(measure: Column, average: Column) -> Column:
    r = measure / average
    return F.when(r <= 0, 0.0).otherwise(F.pow(F.least(r, 1 / r), F.lit(2.0)))


def tri(average: Column) -> dict[str, Column]:
    p, e = _points("tri"), _edges("tri")
    length = [v.norm(x) for x in e]
    twice = v.norm(v.cross(e[0], v.mul(-1.0, e[2])))
    area = twice / 2
    squares = v.sq(e[0]) + v.sq(e[1]) + v.sq(e[2])
    perimeter = length[0] + length[1] + length[2]
    frobenius = _ratio(squares, 2 * math.sqrt(3) * twice)
    angles = [v.degrees_between(v.sub(p[(k + 1) % 3], p[k]), v.sub(p[(k + 2) % 3], p[k])) for k in range(3)]
    shape = F.when(frobenius >= HUGE, 0.0).otherwise(1 / frobenius)
    size = _sizes(area, average)
    return {
        "edge_ratio": _ratio(F.greatest(*length), F.least(*length)),
        "aspect_ratio": _ratio(F.greatest(*length) * perimeter, 2 * math.sqrt(3) * twice),
        "radius_ratio": _ratio(length[0] * length[1] * length[2] * perimeter, 4 * twice * twice),
        "aspect_frobenius": frobenius,
        "area": area,
        "minimum_angle": F.least(*angles),
        "maximum_angle": F.greatest(*angles),
        "condition": frobenius,
        "scaled_jacobian": _good(twice * (2 / math.sqrt(3)), F.greatest(length[0] * length[1], length[1] * length[2], length[2] * length[0])),
        "shape": shape,
        "relative_size_squared": size,
        "shape_and_size": shape * size,
        "distortion": F.lit(1.0) * (area / area),
    }


def quad(average: Column) -> dict[str, Column]:
    p, e = _points("quad"), _edges("quad")
    length, squares = [v.norm(x) for x in e], [v.sq(x) for x in e]
    x1, x2 = v.sub(v.add(p[1], p[2]), v.add(p[0], p[3])), v.sub(v.add(p[2], p[3]), v.add(p[0], p[1]))
    x12 = v.sub(v.add(p[0], p[2]), v.add(p[1], p[3]))
    n = v.cross(x1, x2)
    unit = v.mul(1 / v.norm(n), n)
    corner = [v.cross(v.mul(-1.0, e[k - 1]), e[k]) for k in range(4)]  # towards the previous, towards the next corner
    corner = [v.mul(-1.0, c) for c in corner]
    alpha = [v.dot(unit, c) for c in corner]
    area = (alpha[0] + alpha[1] + alpha[2] + alpha[3]) / 4
    d = [v.norm(v.sub(p[2], p[0])), v.norm(v.sub(p[3], p[1]))]
    hmax2 = F.greatest(*squares, d[0] * d[0], d[1] * d[1])
    doubled = [v.norm(c) for c in corner]
    angles = [v.degrees_between(v.mul(-1.0, e[k - 1]), e[k]) for k in range(4)]
    unit_n = [v.mul(1 / v.norm(c), c) for c in corner]
    around = [squares[k] + squares[k - 1] for k in range(4)]
    scaled = F.least(*[_good(alpha[k], length[k] * length[k - 1]) for k in range(4)])
    shape = F.greatest(F.lit(0.0), F.least(*[_good(2 * alpha[k], around[k]) for k in range(4)]))
    size = _sizes(area, average)
    oddy = F.greatest(*[F.when(F.abs(alpha[k]) < TINY, HUGE).otherwise((F.pow(squares[k] - squares[k - 1], F.lit(2.0)) + 4 * F.pow(v.dot(e[k], e[k - 1]), F.lit(2.0))) / (2 * doubled[k] * doubled[k])) for k in range(4)])
    bent = F.least(*[F.pow(v.dot(unit_n[k], unit_n[k + 2]), F.lit(3.0)) for k in range(2)])
    perimeter = length[0] + length[1] + length[2] + length[3]
    fro = [_ratio(around[k], 2 * doubled[k]) for k in range(4)]
    a1, a2 = v.norm(x1), v.norm(x2)
    shear = F.greatest(F.lit(0.0), scaled)
    return {
        "edge_ratio": _ratio(F.greatest(*length), F.least(*length)),
        "max_edge_ratio": _ratio(F.greatest(a1, a2), F.least(a1, a2)),
        "aspect_ratio": _ratio(F.greatest(*length) * perimeter, 4 * area),
        "radius_ratio": _ratio(F.sqrt((squares[0] + squares[1] + squares[2] + squares[3]) * hmax2), 2 * math.sqrt(2) * F.least(*doubled)),
        "med_aspect_frobenius": (fro[0] + fro[1] + fro[2] + fro[3]) / 4,
        "max_aspect_frobenius": F.greatest(*fro),
        "skew": F.abs(v.dot(x1, x2) / (a1 * a2)),
        "taper": _ratio(v.norm(x12), F.least(a1, a2)),
        "warpage": 1 - bent,
        "area": area,
        "stretch": _good(math.sqrt(2) * F.least(*length), F.greatest(*d)),
        "minimum_angle": F.least(*angles),
        "maximum_angle": F.greatest(*angles),
        "oddy": oddy,
        "condition": F.greatest(*[_ratio(around[k], 2 * alpha[k]) for k in range(4)]),
        "jacobian": F.least(*alpha),
        "scaled_jacobian": scaled,
        "shear": shear,
        "shape": shape,
        "relative_size_squared": size,
        "shape_and_size": shape * size,
        "shear_and_size": shear * size,
        "distortion": _good(4 * F.least(*alpha), 4 * area) / 1.0,
    }


def tet(average: Column) -> dict[str, Column]:
    p, e = _points("tet"), _edges("tet")
    length = [v.norm(x) for x in e]
    u, w, z = v.sub(p[1], p[0]), v.sub(p[2], p[0]), v.sub(p[3], p[0])
    six = v.det(u, w, z)
    volume = six / 6
    normal = [v.cross(v.sub(p[b], p[a]), v.sub(p[c], p[a])) for a, b, c in FACES["tet"]]
    areas = [v.norm(n) / 2 for n in normal]
    surface = areas[0] + areas[1] + areas[2] + areas[3]
    inradius = F.abs(six) / (2 * surface)
    num = v.total([v.mul(v.sq(z), v.cross(u, w)), v.mul(v.sq(w), v.cross(z, u)), v.mul(v.sq(u), v.cross(w, z))])
    circum = v.norm(num) / (2 * F.abs(six))
    radius = F.when(F.abs(six) < TINY, HUGE).otherwise(circum / (3 * inradius))
    rms = F.sqrt((v.sq(e[0]) + v.sq(e[1]) + v.sq(e[2]) + v.sq(e[3]) + v.sq(e[4]) + v.sq(e[5])) / 6)
    pairs = [(a, b) for a in range(4) for b in range(a)]
    dihedral = [F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -v.dot(normal[a], normal[b]) / (4 * areas[a] * areas[b]))))) for a, b in pairs]
    face_edges = [[length[k] for k, s in enumerate(EDGES["tet"]) if set(s) <= set(f)] for f in FACES["tet"]]
    heights = [F.abs(six) / (2 * areas[k]) / F.greatest(*face_edges[k]) for k in range(4)]
    at_corner = [[length[k] for k, s in enumerate(EDGES["tet"]) if c in s] for c in range(4)]
    lam = F.greatest(*[a[0] * a[1] * a[2] for a in at_corner], F.abs(six))
    frobenius_square = 1.5 * (v.sq(u) + v.sq(w) + v.sq(z)) - (v.dot(u, w) + v.dot(w, z) + v.dot(z, u))
    shape = F.when(six <= 0, 0.0).otherwise(3 * F.pow(six * math.sqrt(2), F.lit(2 / 3)) / frobenius_square)
    # the weighted Jacobian's columns: those of the regular tet become unit vectors
    c1, c2 = u, v.mul(1 / math.sqrt(3), v.sub(v.mul(2.0, w), u))
    c3 = v.mul(1 / math.sqrt(6), v.sub(v.sub(v.mul(3.0, z), w), u))
    fro1 = F.sqrt(v.sq(c1) + v.sq(c2) + v.sq(c3))
    fro2 = F.sqrt(v.sq(v.cross(c1, c2)) + v.sq(v.cross(c2, c3)) + v.sq(v.cross(c3, c1)))
    size = _sizes(volume, average)
    return {
        "edge_ratio": _ratio(F.greatest(*length), F.least(*length)),
        "radius_ratio": radius,
        "aspect_beta": F.when(six <= 0, HUGE).otherwise(radius),
        "aspect_ratio": _ratio(F.greatest(*length), 2 * math.sqrt(6) * inradius),
        "aspect_gamma": F.when(F.abs(volume) < TINY, HUGE).otherwise(F.pow(rms, F.lit(3.0)) / (8.479670 * F.abs(volume))),
        "aspect_frobenius": F.when(shape <= 0, HUGE).otherwise(1 / shape),
        "minimum_angle": F.least(*dihedral),
        "collapse_ratio": F.least(*heights),
        "volume": volume,
        "condition": F.when(six <= 0, HUGE).otherwise(fro1 * fro2 / (3 * v.det(c1, c2, c3))),
        "jacobian": six,
        "scaled_jacobian": _good(math.sqrt(2) * six, lam),
        "shape": shape,
        "relative_size_squared": size,
        "shape_and_size": shape * size,
        "distortion": F.lit(1.0) * (six / six),
    }


#: Neighbours of each hex corner along the three axes, right-handed.
HEX_AXES = [(1, 3, 4), (2, 0, 5), (3, 1, 6), (0, 2, 7), (7, 5, 0), (4, 6, 1), (5, 7, 2), (6, 4, 3)]


def hex_(average: Column) -> dict[str, Column]:
    p, e = _points("hex"), _edges("hex")
    length = [v.norm(x) for x in e]
    total = lambda ks: v.total([p[k] for k in ks])
    x = [v.sub(total((1, 2, 6, 5)), total((0, 3, 7, 4))), v.sub(total((3, 2, 6, 7)), total((0, 1, 5, 4))), v.sub(total((4, 5, 6, 7)), total((0, 1, 2, 3)))]
    mixed = {(0, 1): v.sub(total((0, 2, 4, 6)), total((1, 3, 5, 7))), (0, 2): v.sub(total((0, 3, 5, 6)), total((1, 2, 4, 7))), (1, 2): v.sub(total((0, 1, 6, 7)), total((2, 3, 4, 5)))}
    a = [v.norm(q) for q in x]
    pairs = [(0, 1), (0, 2), (1, 2)]
    local = [[v.sub(p[n], p[k]) for n in axes] for k, axes in enumerate(HEX_AXES)]
    dets = [v.det(*c) for c in local]
    center = v.det(*x) / 64
    squares = [[v.sq(q) for q in c] for c in local]
    prod = [F.sqrt(s[0] * s[1] * s[2]) for s in squares]
    scaled = [*[_good(d, m) for d, m in zip(dets, prod, strict=True)], _good(v.det(*x), a[0] * a[1] * a[2])]
    crosses = [v.sq(v.cross(c[0], c[1])) + v.sq(v.cross(c[1], c[2])) + v.sq(v.cross(c[2], c[0])) for c in local]
    condition = [F.when(d < TINY, HUGE).otherwise(F.sqrt((s[0] + s[1] + s[2]) * m) / (3 * d)) for d, s, m in zip(dets, squares, crosses, strict=True)]
    shape = F.least(*[F.when(d <= TINY, 0.0).otherwise(3 * F.pow(d, F.lit(2 / 3)) / (s[0] + s[1] + s[2])) for d, s in zip(dets, squares, strict=True)])
    shear = F.greatest(F.lit(0.0), F.least(*scaled))
    diagonals = [v.norm(v.sub(p[b], p[c])) for b, c in ((6, 0), (7, 1), (4, 2), (5, 3))]
    size = _sizes((dets[0] + dets[1] + dets[2] + dets[3] + dets[4] + dets[5] + dets[6] + dets[7]) / 8, average)
    gram = [[v.dot(c[i], c[j]) for i in range(3) for j in range(3)] for c in local]
    oddy = []
    for d, g, s in zip(dets, gram, squares, strict=True):
        trace = s[0] + s[1] + s[2]
        full = g[0] * g[0]
        for q in g[1:]:
            full = full + q * q
        oddy.append(F.when(d <= TINY, HUGE).otherwise((full - trace * trace / 3) / F.pow(d, F.lit(4 / 3))))
    return {
        "edge_ratio": _ratio(F.greatest(*length), F.least(*length)),
        "max_edge_ratio": F.greatest(*[F.greatest(_ratio(a[i], a[j]), _ratio(a[j], a[i])) for i, j in pairs]),
        "skew": F.greatest(*[F.abs(v.dot(x[i], x[j]) / (a[i] * a[j])) for i, j in pairs]),
        "taper": F.greatest(*[_ratio(v.norm(mixed[k]), F.least(a[k[0]], a[k[1]])) for k in pairs]),
        "volume": center,
        "stretch": _good(math.sqrt(3) * F.least(*length), F.greatest(*diagonals)),
        "diagonal": _good(F.least(*diagonals), F.greatest(*diagonals)),
        "oddy": F.greatest(*oddy),
        "med_aspect_frobenius": (condition[0] + condition[1] + condition[2] + condition[3] + condition[4] + condition[5] + condition[6] + condition[7]) / 8,
        "max_aspect_frobenius": F.greatest(*condition),
        "condition": F.greatest(*condition),
        "jacobian": F.least(*dets, center),
        "scaled_jacobian": F.least(*scaled),
        "shear": shear,
        "shape": shape,
        "relative_size_squared": size,
        "shape_and_size": shape * size,
        "shear_and_size": shear * size,
        "distortion": _good(F.least(*dets, center), center),
    }


def _tet_volume(ps: list[v.Vec]) -> Column:
    return v.det(v.sub(ps[1], ps[0]), v.sub(ps[2], ps[0]), v.sub(ps[3], ps[0])) / 6


def cut_volume(name: str) -> Column:
    """Volume of a pyramid, prism or knife as a sum of tets."""
    p = _points(name)
    tets = {
        "pyramid": [(0, 1, 2, 4), (0, 2, 3, 4)],
        "prism": [(0, 1, 2, 3), (1, 4, 5, 3), (1, 5, 2, 3)],
        "knife": [(0, 1, 3, 4), (1, 5, 3, 4), (1, 2, 3, 5), (1, 6, 2, 5)],
    }[name]
    out = None
    for t in tets:
        one = _tet_volume([p[k] for k in t])
        out = one if out is None else out + one
    return out


METRICS = {
    "edge": lambda average: {"length": v.norm(_edges("edge")[0])},
    "tri": tri,
    "quad": quad,
    "tet": tet,
    "hex": hex_,
    "pyramid": lambda average: {"volume": cut_volume("pyramid")},
    "prism": lambda average: {"volume": cut_volume("prism")},
    "knife": lambda average: {"volume": cut_volume("knife")},
}


def with_corners(element: DataFrame, vertex: DataFrame, name: str) -> DataFrame:
    """(etype, id, p0, p1, ...): the elements of a type with their corners; one join for all corners."""
    n = len(_points(name))
    some = element.where(F.col("etype") == CODE[name]).select("etype", "id", F.posexplode(F.slice("conn", 1, n)).alias("pos", "vid"))
    xyz = vertex.select(F.col("id").alias("vid"), F.struct("x", "y", "z").alias("p"))
    return some.join(xyz, "vid").groupBy("etype", "id").agg(*[F.max(F.when(F.col("pos") == k, F.col("p"))).alias(f"p{k}") for k in range(n)])


def measure(element: DataFrame, vertex: DataFrame, name: str, metrics: list[str] | None = None, average: float | None = None) -> DataFrame:
    """(etype, id, metric ...): the metrics asked for, or all legal ones of the type.

    ``average``: the size that relative metrics compare with; none: 1.
    """
    every = METRICS[name](F.lit(1.0 if average is None else average))
    chosen = list(every) if metrics is None else metrics
    if bad := set(chosen) - set(every):
        raise ValueError(f"{name} has no metric {sorted(bad)}")
    return with_corners(element, vertex, name).select("etype", "id", *[every[m].alias(m) for m in chosen])
