"""Uniform and adaptive refinement by templates: children are exploded, new vertices shared by key."""

from __future__ import annotations

from itertools import count, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import topology as T
from .mesh import Mesh
from .ordered import dense_ids


def _lattice(name: str, n: int) -> tuple[list[tuple], list[list[int]]]:
    """Points of the refined element, as weights of its corners, and children as indices of points."""
    if name == "edge":
        pts = [(n - k, k) for k in range(n + 1)]
        return pts, [[k, k + 1] for k in range(n)]
    if name == "tri":
        grid = [(i, j) for j in range(n + 1) for i in range(n + 1 - j)]
        num = {p: k for k, p in enumerate(grid)}
        kids = [[num[i, j], num[i + 1, j], num[i, j + 1]] for i, j in grid if i + j < n]
        kids += [[num[i + 1, j], num[i + 1, j + 1], num[i, j + 1]] for i, j in grid if i + j < n - 1]
        return [(n - i - j, i, j) for i, j in grid], kids
    if name in ("quad", "hex"):
        dim = 2 if name == "quad" else 3
        ring = [(0, 0), (1, 0), (1, 1), (0, 1)]
        corner = ring if dim == 2 else [(a, b, c) for c in (0, 1) for a, b in ring]
        grid = [p[::-1] for p in product(range(n + 1), repeat=dim)]
        num = {p: k for k, p in enumerate(grid)}
        pts = []
        for p in grid:
            w = []
            for c in corner:
                f = 1
                for x, s in zip(p, c, strict=True):
                    f *= x if s else n - x
                w.append(f)
            pts.append(tuple(w))
        kids = [[num[tuple(x + s for x, s in zip(p, c, strict=True))] for c in corner] for p in grid if max(p) < n]
        return pts, kids
    if name == "tet":
        # the cube's cut into six tets along one diagonal, kept to the simplex x >= y >= z
        steps = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]
        grid = [(x, y, z) for x in range(n + 1) for y in range(x + 1) for z in range(y + 1)]
        num = {p: k for k, p in enumerate(grid)}
        pts = [(n - x, x - y, y - z, z) for x, y, z in grid]
        kids = []
        for base in product(range(n), repeat=3):
            for order in steps:
                path, at = [base], list(base)
                for axis in order:
                    at[axis] += 1
                    path.append(tuple(at))
                if all(p in num for p in path):
                    even = sum(order[a] > order[b] for a in range(3) for b in range(a + 1, 3)) % 2 == 0
                    ids = [num[p] for p in path]
                    kids.append(ids if even else [ids[1], ids[0], ids[2], ids[3]])
        return pts, kids
    raise ValueError(f"no refinement of {name}")


def uniform(mesh: Mesh, name: str, degree: int) -> tuple[Mesh, DataFrame]:
    """The elements of a type refined: mesh of children, and (child, parent).

    Degree n cuts every edge in n.  A point is known by its corners with their weights, so neighbours share it.
    Vertices at corners keep their ids.
    """
    pts, kids = _lattice(name, degree)
    whole = degree ** {"edge": 1, "tri": 1, "tet": 1, "quad": 2, "hex": 3}[name]
    e = mesh.element.where(F.col("etype") == T.CODE[name])
    conn = F.col("conn")

    def key(weights: tuple) -> Column:
        used = [(k, w) for k, w in enumerate(weights) if w]
        return F.array_sort(F.array(*[F.struct(conn[k].alias("v"), F.lit(w).alias("w")) for k, w in used]))

    points = F.array(*[key(p) for p in pts])
    child = e.select(F.col("id").alias("parent"), points.alias("pts")).select("parent", "pts", F.posexplode(F.array(*[F.array(*map(F.lit, k)) for k in kids])).alias("n", "pick"))
    child = child.select("parent", "n", F.transform("pick", lambda i: F.get("pts", i)).alias("keys"))
    distinct = e.select(F.explode(points).alias("key")).distinct()
    old = distinct.where(F.size("key") == 1).select("key", F.col("key")[0]["v"].alias("vid"))
    last = mesh.vertex.agg(F.max("id")).first()[0] or 0
    new = dense_ids(distinct.where(F.size("key") > 1), ["key"], "vid", last + 1)
    names = old.unionByName(new.select("key", "vid"))
    at = new.select("vid", F.explode("key").alias("s")).select("vid", F.col("s.v").alias("id"), F.col("s.w").alias("w")).join(mesh.vertex, "id")
    made = at.groupBy(F.col("vid").alias("id")).agg(*[(F.sum(F.col(c) * F.col("w")) / whole).alias(c) for c in "xyz"])
    long = child.select("parent", "n", F.posexplode("keys").alias("pos", "key")).join(names, "key")
    rows = long.groupBy("parent", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vid"))), lambda s: s["vid"]).alias("conn"))
    numbered = dense_ids(rows, ["parent", "n"], "id", 1)
    used = names.select(F.col("vid").alias("id"))
    vertex = mesh.vertex.join(old.select(F.col("vid").alias("id")), "id", "left_semi").unionByName(made.join(used, "id", "left_semi"))
    return Mesh.build(vertex, numbered.select(F.lit(T.CODE[name]).cast("tinyint").alias("etype"), "id", "conn")), numbered.select(F.col("id").alias("child"), "parent")


def adaptive_tris(mesh: Mesh, split: Column) -> Mesh:
    """Triangles whose edges satisfy ``split`` (over ax..az, bx..bz of an edge's ends) are cut through these edges' middles.

    One marked edge gives two children, two give three, three give four; neighbours agree as an edge is marked or not for both.
    """
    tri = mesh.element.where(F.col("etype") == T.CODE["tri"])
    c = F.col("conn")
    edges = tri.select(F.explode(F.array(*[F.array_sort(F.array(c[a], c[b])) for a, b in T.EDGES["tri"]])).alias("key")).distinct()
    ends = edges.select("key", F.col("key")[0].alias("a"), F.col("key")[1].alias("b"))
    for end in "ab":
        ends = ends.join(mesh.vertex.select(F.col("id").alias(end), *[F.col(x).alias(f"{end}{x}") for x in "xyz"]), end)
    last = mesh.vertex.agg(F.max("id")).first()[0] or 0
    mids = dense_ids(ends.where(split), ["key"], "mid", last + 1)
    vertex = mesh.vertex.unionByName(mids.select(F.col("mid").alias("id"), *[((F.col(f"a{x}") + F.col(f"b{x}")) / 2).alias(x) for x in "xyz"]))
    marked = tri.select("id", "conn")
    for k, (a, b) in enumerate(T.EDGES["tri"]):
        marked = marked.withColumn("key", F.array_sort(F.array(c[a], c[b]))).join(mids.select("key", F.col("mid").alias(f"m{k}")), "key", "left").drop("key")
    m = [F.col(f"m{k}") for k in range(3)]
    has = [x.isNotNull() for x in m]
    tri_ = lambda *x: F.array(*x)
    case = F.when(has[0] & has[1] & has[2], F.array(tri_(c[0], m[0], m[2]), tri_(m[0], c[1], m[1]), tri_(m[2], m[1], c[2]), tri_(m[0], m[1], m[2])))
    for k in range(3):  # the corners in turn, so that edge k is the first
        v = [c[(k + s) % 3] for s in range(3)]
        e = [m[(k + s) % 3] for s in range(3)]
        h = [has[(k + s) % 3] for s in range(3)]
        case = case.when(h[0] & h[1] & ~h[2], F.array(tri_(v[0], e[0], e[1]), tri_(v[0], e[1], v[2]), tri_(e[0], v[1], e[1])))
    for k in range(3):
        v = [c[(k + s) % 3] for s in range(3)]
        case = case.when(has[k] & ~has[(k + 1) % 3] & ~has[(k + 2) % 3], F.array(tri_(v[0], m[k], v[2]), tri_(m[k], v[1], v[2])))
    rows = marked.select("id", F.posexplode(case.otherwise(F.array(tri_(c[0], c[1], c[2])))).alias("n", "new")).select(F.col("id").alias("parent"), "n", F.col("new").alias("conn"))
    numbered = dense_ids(rows, ["parent", "n"], "id", 1)
    return Mesh.build(vertex, numbered.select(F.lit(T.CODE["tri"]).cast("tinyint").alias("etype"), "id", "conn"))


def tets_to_hexes(mesh: Mesh) -> Mesh:
    """Each tet becomes four hexes about its corners, through the middles of edges, faces and body; neighbours share what lies between."""
    e = mesh.element.where(F.col("etype") == T.CODE["tet"])
    c = F.col("conn")
    key = lambda *k: F.array_sort(F.array(*[c[x] for x in k]))
    kids = []
    for a in range(4):
        x, y, z = [k for k in range(4) if k != a] if a % 2 == 0 else [k for k in range(4) if k != a][::-1]
        kids.append(F.array(key(a), key(a, x), key(a, x, y), key(a, y), key(a, z), key(a, x, z), key(0, 1, 2, 3), key(a, y, z)))
    child = e.select(F.col("id").alias("parent"), F.posexplode(F.array(*kids)).alias("n", "keys"))
    distinct = child.select(F.explode("keys").alias("key")).distinct()
    last = mesh.vertex.agg(F.max("id")).first()[0] or 0
    new = dense_ids(distinct.where(F.size("key") > 1), ["key"], "vid", last + 1)
    names = distinct.where(F.size("key") == 1).select("key", F.col("key")[0].alias("vid")).unionByName(new.select("key", "vid"))
    at = new.select("vid", F.explode("key").alias("id")).join(mesh.vertex, "id").groupBy(F.col("vid").alias("id")).agg(*[F.avg(x).alias(x) for x in "xyz"])
    rows = child.select("parent", "n", F.posexplode("keys").alias("pos", "key")).join(names, "key").groupBy("parent", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "vid"))), lambda s: s["vid"]).alias("conn"))
    numbered = dense_ids(rows, ["parent", "n"], "id", 1)
    return Mesh.build(mesh.vertex.unionByName(at), numbered.select(F.lit(T.CODE["hex"]).cast("tinyint").alias("etype"), "id", "conn"))


def smooth(mesh: Mesh, fixed: DataFrame, tol: float = 1e-4, max_rounds: int | None = None) -> DataFrame:
    """Vertices after Lloyd smoothing: free ones move to the mean of their elements' centroids until none moves over ``tol``.

    ``fixed``: ids that stay.  Each round is two aggregations; its result is cut off from the rounds before.
    Only a caller's ``max_rounds`` ends it earlier.
    """
    from ..checkpoints import persist

    inc = persist(mesh.incidence().select("etype", "id", "vid"))
    free = mesh.vertex.select("id").join(fixed.select("id"), "id", "left_anti").withColumn("free", F.lit(True))
    v = persist(mesh.vertex.join(free, "id", "left").select("id", "x", "y", "z", F.coalesce("free", F.lit(False)).alias("free")))
    for _ in count() if max_rounds is None else range(max_rounds):
        mid = inc.join(v.withColumnRenamed("id", "vid"), "vid").groupBy("etype", "id").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
        to = inc.join(mid, ["etype", "id"]).groupBy("vid").agg(*[F.avg(f"m{c}").alias(f"n{c}") for c in "xyz"])
        j = v.join(to.withColumnRenamed("vid", "id"), "id", "left")
        moves = F.col("free") & F.col("nx").isNotNull()
        step = sum(((F.col(f"n{c}") - F.col(c)) ** 2 for c in "yz"), (F.col("nx") - F.col("x")) ** 2)
        nxt = persist(j.select("id", *[F.when(moves, F.col(f"n{c}")).otherwise(F.col(c)).alias(c) for c in "xyz"], "free", F.when(moves, step).otherwise(0.0).alias("step")))
        most = nxt.agg(F.max("step")).first()[0] or 0.0
        v = nxt.drop("step")
        if most <= tol * tol:
            break
    return v.drop("free")
