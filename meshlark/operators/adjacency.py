"""Incidence joins: adjacency, bridges, layers, sides and skin."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import persist
from ..functions import topology as T


def sides(element: DataFrame, dim: int) -> DataFrame:
    """(etype, id, side, verts, key): sides of a dimension, by canonical numbering; ``key`` is equal for the same cycle either way round.

    Polygons have an edge for each pair of neighbours.
    """
    conn = F.col("conn")
    listed = F.lit(None).cast("array<array<bigint>>")
    for name in T.EDGES:
        if T.DIM[name] <= dim:
            continue
        table = T.side_table(name, dim)
        if table:
            listed = F.when(F.col("etype") == T.CODE[name], F.array(*[F.array(*[conn[k] for k in s]) for s in table])).otherwise(listed)
    if dim == 1:
        ring = T.corners(F.col("etype"), conn)
        listed = F.when(F.col("etype") == T.CODE["polygon"], F.transform(ring, lambda v, k: F.array(v, F.element_at(ring, (k + 1) % F.size(ring) + 1)))).otherwise(listed)
    return element.select("etype", "id", F.posexplode(listed).alias("side", "verts")).withColumn("key", T.cyclic_key(F.col("verts")))


def skin(element: DataFrame, dim: int) -> DataFrame:
    """Sides that exactly one of the elements has, with that element: (key, verts, etype, id, side)."""
    one = sides(element, dim).groupBy("key").agg(F.count("*").alias("n"), F.first("verts").alias("verts"), F.min("etype").alias("etype"), F.min("id").alias("id"), F.min("side").alias("side"))
    return one.where("n = 1").drop("n")


def side_uses(element: DataFrame, dim: int) -> DataFrame:
    """(key, n): how many elements have a side: 1 on the boundary, 2 inside, more where it isn't manifold."""
    return sides(element, dim).groupBy("key").agg(F.count("*").alias("n"))


def vertex_index(incidence: DataFrame) -> DataFrame:
    """(vid, n, first_id, last_id): the inverted index of a mesh, one row a vertex, without its list, which has no bound."""
    return incidence.groupBy("vid").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def opposite_vertices(element: DataFrame, lower: DataFrame) -> DataFrame:
    """(etype, id, side_id, vid): the vertices of an element that a lower entity on it, given as (etype, id, side_id, vid), doesn't have."""
    all_v = element.select("etype", "id", F.explode("conn").alias("vid")).distinct()
    asked = lower.select("etype", "id", "side_id").distinct().join(all_v, ["etype", "id"])
    return asked.join(lower.select("etype", "id", "side_id", "vid"), ["etype", "id", "side_id", "vid"], "left_anti")


def skin_vertices(element: DataFrame, dim: int) -> DataFrame:
    return skin(element, dim).select(F.explode("verts").alias("vid")).distinct()


def boundary_class(element: DataFrame, vertex: DataFrame, angle: float = 40.0) -> DataFrame:
    """(key, kind) of the edges of a surface: boundary (one face), non_manifold (over two), inferred (normals turn by more than ``angle`` degrees) or other."""
    faces = sides(element, 1)
    at = element.select("etype", "id", F.slice("conn", 1, 3).alias("c"))
    xyz = vertex.select(F.col("id").alias("vid"), F.struct("x", "y", "z").alias("p"))
    for k in range(3):
        at = at.withColumn("vid", F.col("c")[k]).join(xyz, "vid").withColumnRenamed("p", f"p{k}").drop("vid")
    u = [F.col("p1")[a] - F.col("p0")[a] for a in "xyz"]
    v = [F.col("p2")[a] - F.col("p0")[a] for a in "xyz"]
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    normal = at.select("etype", "id", F.array(*[c / size for c in n]).alias("n"))
    grouped = faces.join(normal, ["etype", "id"]).groupBy("key").agg(F.count("*").alias("k"), F.array_sort(F.collect_list(F.struct("etype", "id", "n", "verts"))).alias("f"))
    a, b = F.col("f")[0], F.col("f")[1]
    dot = reduce(lambda s, k: s + a["n"][k] * b["n"][k], range(1, 3), a["n"][0] * b["n"][0])
    same_way = a["verts"] == b["verts"]  # neighbours that run alike along the edge have opposite normals
    turned = F.when(same_way, -dot).otherwise(dot) < F.cos(F.radians(F.lit(angle)))
    kind = F.when(F.col("k") == 1, "boundary").when(F.col("k") > 2, "non_manifold").when(turned, "inferred").otherwise("other")
    return grouped.select("key", kind.alias("kind"))


def up_each(incidence: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, etype, id): for every vertex set q of ``queries`` (q, vid), the entities that have all its vertices."""
    v = queries.select("q", "vid").distinct()
    size = v.groupBy("q").agg(F.count("*").alias("n"))
    hit = v.join(incidence.select("etype", "id", "vid").distinct(), "vid").groupBy("q", "etype", "id").agg(F.count("*").alias("k"))
    return hit.join(size, "q").where("k = n").select("q", "etype", "id")


def half_facets(elements: DataFrame) -> DataFrame:
    """(etype, id, side, a, b, sib_id, sib_side): the directed edges of polygons, and of each the next one on the same two vertices.

    Edges on the same vertices follow one another by (id, side), the last one by the first; a border edge, alone on its vertices, has no
    sibling.  An edge from a vertex to itself is left out.
    """
    e = elements.select("etype", "id", "conn", F.posexplode("conn").alias("side", "a"))
    e = e.withColumn("b", F.element_at("conn", F.pmod(F.col("side") + 1, F.size("conn")) + 1)).where("a <> b").drop("conn")
    own = Window.partitionBy(F.least("a", "b"), F.greatest("a", "b"))
    here = F.struct("id", "side")
    after = F.coalesce(F.lead(here).over(own.orderBy("id", "side")), F.min(here).over(own))
    e = e.withColumn("sib", F.when(F.count("*").over(own) > 1, after))
    return e.select("etype", "id", "side", "a", "b", F.col("sib.id").alias("sib_id"), F.col("sib.side").alias("sib_side"))


def up(incidence: DataFrame, vertices: DataFrame, condition: str = "intersect") -> DataFrame:
    """Entities with all (intersect) or any (union) of the vertices (column vid); none for an empty intersection."""
    v = vertices.select("vid").distinct()
    hit = incidence.select("etype", "id", "vid").distinct().join(v, "vid").groupBy("etype", "id").agg(F.count("*").alias("n"))
    if condition == "union":
        return hit.select("etype", "id")
    return hit.join(F.broadcast(v.agg(F.count("*").alias("m"))), F.col("n") == F.col("m")).select("etype", "id")


def down(incidence: DataFrame, entities: DataFrame, condition: str = "union") -> DataFrame:
    """Vertices of any or of all of the entities."""
    e = entities.select("etype", "id").distinct()
    hit = incidence.select("etype", "id", "vid").distinct().join(e, ["etype", "id"]).groupBy("vid").agg(F.count("*").alias("n"))
    if condition == "union":
        return hit.select("vid")
    return hit.join(F.broadcast(e.agg(F.count("*").alias("m"))), F.col("n") == F.col("m")).select("vid")


def match_sides(element: DataFrame, lower: DataFrame, dim: int) -> DataFrame:
    """Existing entities of dimension ``dim`` that are sides: (etype, id, side, to_etype, to_id, sense)."""
    s = sides(element, dim)
    low = lower.select(F.col("etype").alias("to_etype"), F.col("id").alias("to_id"), F.col("conn").alias("own"), T.cyclic_key(F.col("conn")).alias("key"))
    return s.join(low, "key").select("etype", "id", "side", "to_etype", "to_id", T.sense(F.col("own"), F.col("verts")).alias("sense"))


def construct_sides(element: DataFrame, dim: int, first_id: int = 1) -> DataFrame:
    """New entities (etype, id, conn) for every distinct side, ids rising with the key."""
    one = sides(element, dim).groupBy("key").agg(F.min_by("verts", F.struct("etype", "id", "side")).alias("conn"))
    kind = F.when(F.size("conn") == 2, T.CODE["edge"]).when(F.size("conn") == 3, T.CODE["tri"]).otherwise(T.CODE["quad"]).cast("tinyint")
    from .ordered import dense_ids

    return dense_ids(one, ["key"], "id", first_id).select(kind.alias("etype"), "id", "conn")


def bridge(incidence: DataFrame, start: DataFrame, layers: int = 1, keep_start: bool = True) -> DataFrame:
    """(etype, id, layer): entities that share a vertex with the layer before; each layer grows from what the last one found."""
    inc = incidence.select("etype", "id", "vid").distinct()
    found = start.select("etype", "id").distinct().withColumn("layer", F.lit(0))
    frontier = found
    for k in range(1, layers + 1):
        verts = inc.join(frontier.select("etype", "id"), ["etype", "id"]).select("vid").distinct()
        fresh = inc.join(verts, "vid").select("etype", "id").distinct().join(found, ["etype", "id"], "left_anti").withColumn("layer", F.lit(k))
        if layers > 2:
            fresh = persist(fresh)
        found, frontier = found.unionByName(fresh), fresh
    return found if keep_start else found.where("layer > 0")


def depth_from(incidence: DataFrame, start_vertices: DataFrame) -> DataFrame:
    """(etype, id, depth): how many rings of elements lie between an element and the given vertices; the first ring has depth 0.

    The loop ends when a ring is empty; each ring is cut off from the plans before it.  Elements that share a
    vertex are at most one ring apart, so a ring needs to be told from the last two only.
    """
    inc = persist(incidence.select("etype", "id", "vid").distinct())
    verts = start_vertices.select("vid").distinct()
    rings: list[DataFrame] = []
    while True:
        ring = inc.join(verts, "vid").select("etype", "id").distinct()
        for last in rings[-2:]:
            ring = ring.join(last, ["etype", "id"], "left_anti")
        ring = persist(ring.withColumn("depth", F.lit(len(rings))))
        if ring.isEmpty():
            break
        rings.append(ring)
        verts = inc.join(ring.select("etype", "id"), ["etype", "id"]).select("vid").distinct()
    return reduce(DataFrame.unionByName, rings) if rings else inc.select("etype", "id", F.lit(0).alias("depth")).limit(0)


def common(incidence: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Entities adjacent to some vertex of both lists."""
    return up(incidence, a, "union").intersect(up(incidence, b, "union"))


def neighbours(element: DataFrame, dim: int) -> DataFrame:
    """(a_etype, a, b_etype, b): elements that share a side of dimension ``dim``."""
    s = sides(element, dim).select("etype", "id", "key")
    t = s.toDF("b_etype", "b", "key")
    return s.toDF("a_etype", "a", "key").join(t, "key").where((F.col("a") != F.col("b")) | (F.col("a_etype") != F.col("b_etype"))).select("a_etype", "a", "b_etype", "b").distinct()


def opposite_side(element: DataFrame) -> DataFrame:
    """(etype, id, side, opposite): the side without a common vertex, for quads (edges) and hexes (faces)."""
    pairs = {"quad": 1, "hex": 2}
    out = None
    for name, dim in pairs.items():
        table = T.side_table(name, dim)
        rows = [(k, j) for k, s in enumerate(table) for j, t in enumerate(table) if not set(s) & set(t)]
        look = F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.lit(j).alias("opposite")) for k, j in rows]))
        part = element.where(F.col("etype") == T.CODE[name]).select("etype", "id", look.alias("p")).select("etype", "id", "p.side", "p.opposite")
        out = part if out is None else out.unionByName(part)
    return out


def sheets(element: DataFrame) -> DataFrame:
    """(etype, id, side, sheet): dual sheets (hexes) or chords (quads), as components over opposite sides.

    Sides are numbered in the order of their keys; the sheet's number is its smallest.
    """
    from .graph import components
    from .ordered import dense_ids

    quads = element.where(F.col("etype") == T.CODE["quad"])
    s = sides(quads, 1)
    s = persist(s.join(dense_ids(s.select("key").distinct(), ["key"], "node"), "key"))
    opp = opposite_side(quads).where("side < opposite")
    a = s.select("etype", "id", "side", F.col("node").alias("u"))
    b = s.select("etype", "id", F.col("side").alias("opposite"), F.col("node").alias("v"))
    roots = components(opp.join(a, ["etype", "id", "side"]).join(b, ["etype", "id", "opposite"]).select("u", "v"))
    return s.join(roots, "node", "left").select("etype", "id", "side", F.coalesce("root", "node").alias("sheet"))


def dual(mesh) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """Dual mesh of a surface or solid: a vertex (id, x, y, z) at each element's mean, an edge (a, b) for each shared side."""
    dim = mesh.element.select(F.max(T.dimension(F.col("etype")))).first()[0]
    top = mesh.element.where(T.dimension(F.col("etype")) == dim)
    points = mesh.coordinates().join(top.select("etype", "id"), ["etype", "id"], "left_semi")
    edges = neighbours(top, dim - 1).where((F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("a_etype") < F.col("b_etype"))))
    return points, edges
