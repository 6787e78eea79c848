"""Queries on solids bounded by triangles: rays, containment, closest surface, angles, topology."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as v

#: A ray direction along no axis, so that faces on the grid aren't grazed; fixed, so results repeat.
DIRECTION = (0.5366563145999494, 0.6030226891555273, 0.5893231640640641)


def facets(element: DataFrame, vertex: DataFrame, owner: DataFrame) -> DataFrame:
    """(surface, id, x0 ... z2): triangles with coordinates, by surface (id, surface)."""
    from ..functions.quality import with_corners

    t = with_corners(element, vertex, "tri").join(owner, "id")
    return t.select("surface", "id", *[F.col(f"p{k}.{c}").alias(f"{c}{k}") for k in range(3) for c in "xyz"])


def _corner(k: int) -> v.Vec:
    return tuple(F.col(f"{c}{k}") for c in "xyz")


#: Listed triangles up to which they are broadcast; more meet points or rays by a merge join.  Sizes are counted: Spark's own guess misses what lists of cells unfold to.
FEW = 200_000


def _listed(tris: DataFrame, cell: float, grow: float) -> tuple[DataFrame, bool, list[tuple[float, float]]]:
    """Triangles by the cells (cx, cy, cz) of their boxes grown by ``grow`` cells; whether these are few; the box of all, by axis."""
    ends = {c: [f(*[F.col(f"{c}{k}") for k in range(3)]) for f in (F.least, F.greatest)] for c in "xyz"}
    span = {c: (F.floor(lo / cell - grow), F.floor(hi / cell + grow)) for c, (lo, hi) in ends.items()}
    n = F.lit(1.0)
    for lo, hi in span.values():
        n = n * (hi - lo + 1)
    got = tris.agg(F.sum(n).alias("n"), *[f(e).alias(f"{c}{m}") for c, es in ends.items() for f, e, m in zip((F.min, F.max), es, ("lo", "hi"), strict=True)]).first()
    out = tris.select("surface", "id", *[f"{c}{k}" for k in range(3) for c in "xyz"])
    for c, (lo, hi) in span.items():
        out = out.withColumn(f"c{c}", F.explode(F.sequence(lo, hi)))
    return out, (got["n"] or 0) <= FEW, [(got[f"{c}lo"] or 0.0, got[f"{c}hi"] or 0.0) for c in "xyz"]


def _meet(left: DataFrame, listed: DataFrame, few: bool) -> DataFrame:
    return left.join(F.broadcast(listed), ["cx", "cy", "cz"]) if few else left.hint("merge").join(listed, ["cx", "cy", "cz"])


def _once(df: DataFrame, **named) -> DataFrame:  # noqa: ANN003
    """``df`` with these columns, each worked out once a row: filters on them would else repeat the whole expression, which then grows past what the JVM compiles."""
    return df.select("*", F.inline(F.array(F.struct(*[e.alias(n) for n, e in named.items()]))))


def ray_hits(rays: DataFrame, tris: DataFrame, cell: float, limit: float) -> DataFrame:
    """(ray, surface, id, t): all triangles that rays (ray, ox..oz, dx..dz; unit directions) meet within ``limit``.

    The ray is listed in the cells of points half a cell apart along it, where it runs through the box of all triangles.  A hit
    lies within a quarter cell of such a point, and triangles are listed in the cells of their boxes grown by that, so only near
    ones are tested.
    """
    t, few, box = _listed(tris, cell, 0.26)
    step, enter, leave, there = cell / 2, [F.lit(0.0)], [F.lit(float(limit))], F.lit(True)
    for c, (lo, hi) in zip("xyz", box, strict=True):
        o, d, lo, hi = F.col(f"o{c}"), F.nullif(F.col(f"d{c}"), F.lit(0.0)), lo - cell / 64, hi + cell / 64
        enter.append(F.least((lo - o) / d, (hi - o) / d))  # null, which counts for nothing, along the other axes
        leave.append(F.greatest((lo - o) / d, (hi - o) / d))
        there = there & (d.isNotNull() | o.between(lo, hi))
    within = rays.withColumns({"enter": F.greatest(*enter), "leave": F.least(*leave)}).where(there & (F.col("enter") <= F.col("leave")))
    walk = within.withColumn("first", F.floor(F.col("enter") / step)).withColumn("s", F.explode(F.sequence(F.col("first"), F.ceil(F.col("leave") / step))))
    on = lambda s, c: F.floor((F.col(f"o{c}") + F.col(f"d{c}") * s * step) / cell)
    same = F.col("s") > F.col("first")  # as the point before: it is in the same cell
    for c in "xyz":
        same = same & (on(F.col("s"), c) == on(F.col("s") - 1, c))
    walk = walk.where(~same).select("ray", *[f"{n}{c}" for n in "od" for c in "xyz"], *[on(F.col("s"), c).alias(f"c{c}") for c in "xyz"])
    met = _meet(walk, t, few)
    # v.ray_triangle by steps, each of few enough operations for the JVM to compile
    o, way = tuple(F.col(f"o{c}") for c in "xyz"), tuple(F.col(f"d{c}") for c in "xyz")
    named = lambda n, e: {f"{n}{c}": x for c, x in zip("xyz", e, strict=True)}
    vec = lambda n: tuple(F.col(f"{n}{c}") for c in "xyz")
    met = _once(met, **named("a", v.sub(_corner(0), o)), **named("b", v.sub(_corner(1), o)), **named("c_", v.sub(_corner(2), o)))
    met = _once(met, **{f"side{k}": v.det(way, vec(m), vec(n)) for k, (m, n) in enumerate((("a", "b"), ("b", "c_"), ("c_", "a")))})
    sides = [F.col(f"side{k}") for k in range(3)]
    met = met.where((F.least(*sides) >= 0) | (F.greatest(*sides) <= 0))
    met = _once(met, **named("n", v.cross(v.sub(_corner(1), _corner(0)), v.sub(_corner(2), _corner(0)))))
    met = _once(met, along=v.dot(vec("n"), way), off=v.dot(vec("n"), vec("a"))).where("along <> 0")
    met = _once(met, t=F.col("off") / F.col("along")).select("ray", "surface", "id", "t")
    return met.where((F.col("t") >= 0) & (F.col("t") <= limit)).distinct()


def fire(rays: DataFrame, tris: DataFrame, cell: float, limit: float, k: int = 1) -> DataFrame:
    """The first k hits of each ray; hits on an edge that two facets of a surface share count once."""
    once = ray_hits(rays, tris, cell, limit).groupBy("ray", "surface", F.round("t", 12).alias("t")).agg(F.min("id").alias("id"))
    w = Window.partitionBy("ray").orderBy("t", "surface", "id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def winding(points: DataFrame, tris: DataFrame) -> DataFrame:
    """(point, volume, inside): solid angles of each solid's facets (volume, sense) add up to 4 pi inside, 0 outside.

    Every facet counts for every point; points are few, facets are many, so facets are summed map-side per point.  ``points``
    is broadcast when it has at most 10,000 rows, the stated bound, and joined in blocks of that size otherwise.
    """
    block = 10_000
    from .ordered import dense_ids

    numbered = dense_ids(points.select("id", "x", "y", "z"), ["id"], "k", 0).withColumn("b", F.floor(F.col("k") / block).cast("int"))
    last = numbered.agg(F.max("b")).first()[0]
    out = None
    for b in range(-1 if last is None else last, -1, -1):
        some = F.broadcast(numbered.where(F.col("b") == b).select(F.col("id").alias("point"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("z").alias("qz")))
        angle = v.solid_angle((F.col("qx"), F.col("qy"), F.col("qz")), [_corner(k) for k in range(3)]) * F.col("sense")
        part = tris.join(some, F.lit(True)).groupBy("point", "volume").agg(F.sum(angle).alias("angle"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return points.select(F.col("id").alias("point"), F.lit(0).cast("bigint").alias("volume"), F.lit(False).alias("inside")).limit(0)
    return out.select("point", "volume", (F.abs("angle") > 2 * math.pi).alias("inside"))


def inside_by_ray(points: DataFrame, tris: DataFrame, cell: float, limit: float) -> DataFrame:
    """(point, volume, inside): an odd number of surface crossings along a fixed direction."""
    rays = points.select(F.col("id").alias("ray"), *[F.col(c).alias(f"o{c}") for c in "xyz"], *[F.lit(d).alias(f"d{c}") for c, d in zip("xyz", DIRECTION, strict=True)])
    t = tris.withColumn("surface", F.col("volume"))
    hits = ray_hits(rays, t, cell, limit).groupBy("ray", "surface", F.round("t", 12)).count().groupBy("ray", "surface").agg(F.count("*").alias("n"))
    every = rays.select("ray").crossJoin(F.broadcast(tris.select(F.col("volume").alias("surface")).distinct()))
    return every.join(hits, ["ray", "surface"], "left").select(F.col("ray").alias("point"), F.col("surface").alias("volume"), (F.coalesce("n", F.lit(0)) % 2 == 1).alias("inside"))


def closest(points: DataFrame, tris: DataFrame, reach: float) -> DataFrame:
    """(point, surface, id, x, y, z, dist): the nearest facet point within ``reach``; cells have that side.

    A facet is listed in all cells that its box grown by ``reach`` touches, a point in its own, so a pair meets once; the nearest
    point is sought for pairs whose box is near enough.
    """
    p = points.select(F.col("id").alias("point"), *[F.col(c).alias(f"q{c}") for c in "xyz"], *[F.floor(F.col(c) / reach).alias(f"c{c}") for c in "xyz"])
    t, few, _ = _listed(tris, reach, 1.001)
    q = (F.col("qx"), F.col("qy"), F.col("qz"))
    apart = v.sq(tuple(F.greatest(F.least(*[F.col(f"{c}{k}") for k in range(3)]) - x, x - F.greatest(*[F.col(f"{c}{k}") for k in range(3)]), F.lit(0.0)) for c, x in zip("xyz", q, strict=True)))
    near = _once(_meet(p, t, few).where(apart <= (1.001 * reach) ** 2), w=v.closest_on_triangle(q, [_corner(k) for k in range(3)]))
    near = _once(near, dist=v.norm(v.sub(v.at("w"), q))).where(F.col("dist") <= reach)
    best = near.groupBy("point").agg(F.min_by(F.struct("surface", "id", "w", "dist"), F.struct("dist", "surface", "id")).alias("b"))
    return best.select("point", "b.surface", "b.id", "b.w.x", "b.w.y", "b.w.z", "b.dist")


def next_volume(surface_sides: DataFrame, hits: DataFrame) -> DataFrame:
    """(ray, surface, next): the volume on the other side of a hit surface; sides are (surface, forward, reverse), hits have ``volume``."""
    j = hits.join(surface_sides, "surface")
    return j.select("ray", "surface", F.when(F.col("forward") == F.col("volume"), F.col("reverse")).when(F.col("reverse") == F.col("volume"), F.col("forward")).alias("next"))


def geometry_sets(member: DataFrame, dim_tag: DataFrame) -> DataFrame:
    """(sid, dim): sets by their geometric dimension."""
    return member.select("sid").distinct().join(dim_tag.select(F.col("id").alias("sid"), F.col("value").alias("dim")), "sid")


def restore_topology(member: DataFrame, dims: DataFrame, adjacent: DataFrame) -> DataFrame:
    """(parent, child): links between sets of neighbouring dimension, from all of their members.

    ``adjacent``: (id, up_id), mesh entities and those of one dimension more that they bound.
    """
    m = member.select("sid", "id").join(dims, "sid")
    up = m.select(F.col("sid").alias("parent"), F.col("id").alias("up_id"), F.col("dim").alias("up_dim"))
    return m.join(adjacent, "id").join(up, "up_id").where(F.col("up_dim") == F.col("dim") + 1).select("parent", F.col("sid").alias("child")).distinct()


def unsealed(tris: DataFrame) -> DataFrame:
    """(volume, a, b): directed facet edges of a volume without the reverse one; none if it is closed."""
    e = tris.select("volume", F.explode(F.array(*[F.struct(F.col(f"v{a}").alias("a"), F.col(f"v{b}").alias("b")) for a, b in ((0, 1), (1, 2), (2, 0))])).alias("e")).select("volume", "e.a", "e.b")
    back = e.select("volume", F.col("b").alias("a"), F.col("a").alias("b"))
    return e.join(back, ["volume", "a", "b"], "left_anti")
