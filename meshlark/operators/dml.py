"""Edits as new tables: create, delete, merge, upsert, change of order."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import topology as T
from .graph import components
from .mesh import Mesh
from .ordered import dense_ids, rewrite

KEY = ["etype", "id"]


def create_vertices(mesh: Mesh, points: DataFrame) -> Mesh:
    """Points (x, y, z) get ids after the largest, in coordinate order."""
    last = mesh.vertex.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return replace(mesh, vertex=mesh.vertex.unionByName(dense_ids(points.select("x", "y", "z"), ["x", "y", "z"], "id", last + 1).select("id", "x", "y", "z")))


def create_elements(mesh: Mesh, rows: DataFrame) -> Mesh:
    """Rows (etype, conn) get ids after the largest of all elements."""
    last = mesh.element.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    return replace(mesh, element=mesh.element.unionByName(dense_ids(rows.select("etype", "conn"), ["etype", "conn"], "id", last + 1).select("etype", "id", "conn")))


def delete(mesh: Mesh, entities: DataFrame) -> Mesh:
    """Takes entities out of every table, and elements on deleted vertices stay only if they lose none."""
    gone = entities.select(*KEY).distinct()
    verts = gone.where(F.col("etype") == 0).select(F.col("id").alias("vid"))
    broken = mesh.incidence().join(verts, "vid", "left_semi").select(*KEY).distinct()
    all_gone = gone.unionByName(broken).distinct()
    sets = gone.where(F.col("etype") == T.CODE["entityset"]).select(F.col("id").alias("sid"))
    return Mesh(
        mesh.vertex.join(verts, mesh.vertex.id == verts.vid, "left_anti"),
        mesh.element.join(all_gone, KEY, "left_anti"),
        mesh.eset.join(sets, "sid", "left_anti"),
        mesh.member.join(all_gone, KEY, "left_anti").join(sets, "sid", "left_anti"),
        mesh.link.join(sets, mesh.link.parent == sets.sid, "left_anti").join(sets, F.col("child") == sets.sid, "left_anti"),
        {k: t.join(all_gone, KEY, "left_anti") for k, t in mesh.tags.items()},
    )


def upsert(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``changes`` replace those with their key, or come in anew; of several changes of a key the largest row counts."""
    rest = [c for c in table.columns if c not in key]
    new = changes.select(*key).distinct() if not rest else changes.groupBy(*key).agg(F.max(F.struct(*rest)).alias("__new")).select(*key, "__new.*")
    return table.join(new.select(*key), key, "left_anti").unionByName(new.select(*table.columns))


def set_coordinates(mesh: Mesh, rows: DataFrame) -> Mesh:
    """Vertices (id, x, y, z) that exist get these coordinates."""
    known = rows.select("id", "x", "y", "z").join(mesh.vertex.select("id"), "id", "left_semi")
    return replace(mesh, vertex=upsert(mesh.vertex, known, ["id"]))


def set_connectivity(mesh: Mesh, rows: DataFrame) -> Mesh:
    """Elements (etype, id, conn) that exist get this connectivity."""
    known = rows.select("etype", "id", "conn").join(mesh.element.select(*KEY), KEY, "left_semi")
    return replace(mesh, element=upsert(mesh.element, known, KEY))


def edit_adjacencies(adjacent: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None, both_ways: bool = True) -> DataFrame:
    """Explicit adjacencies (etype, id, to_etype, to_id) with rows added and then removed, each the other way round too with ``both_ways``."""
    cols = ["etype", "id", "to_etype", "to_id"]

    def whole(d: DataFrame) -> DataFrame:
        d = d.select(*cols)
        return d.unionByName(d.toDF("to_etype", "to_id", "etype", "id")) if both_ways else d

    out = adjacent.select(*cols)
    if add is not None:
        out = out.unionByName(whole(add))
    out = out.distinct()
    return out if remove is None else out.join(whole(remove).distinct(), cols, "left_anti")


def split_vertices(mesh: Mesh, vertices: DataFrame, side: DataFrame) -> tuple[Mesh, DataFrame]:
    """Every one of the vertices (id) in two: the elements (etype, id) of ``side`` go to the new one, the others keep the old; (old, new) too.

    The mesh is open afterwards along what the split vertices span, as a crack or an interface is.
    """
    last = mesh.vertex.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    some = mesh.vertex.join(vertices.select("id").distinct(), "id", "left_semi")
    pairs = dense_ids(some, ["id"], "new", last + 1)
    moved = mesh.element.join(side.select(*KEY).distinct(), KEY, "left_semi")
    stay = mesh.element.join(side.select(*KEY).distinct(), KEY, "left_anti")
    to = pairs.select(F.col("id").alias("old"), "new")
    twin = pairs.select(F.col("new").alias("id"), "x", "y", "z")
    return replace(mesh, vertex=mesh.vertex.unionByName(twin), element=stay.unionByName(rewrite(moved, to).select("etype", "id", "conn"))), to


def merge_by_value(tag: DataFrame) -> DataFrame:
    """(etype, old, new): of each type and value the smallest id survives."""
    least = tag.groupBy("etype", "value").agg(F.min("id").alias("new"))
    return tag.join(least, ["etype", "value"]).where("id <> new").select("etype", F.col("id").alias("old"), "new")


def merge_close(vertex: DataFrame, tol: float) -> DataFrame:
    """(old, new): vertices nearer than ``tol`` merge into the smallest id of their chain of near ones."""
    from .spatial import within_distance

    pairs = within_distance(vertex, vertex, tol, strict=True).where("a < b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return components(pairs).select(F.col("node").alias("old"), F.col("root").alias("new"))


def apply_merge(mesh: Mesh, vertex_map: DataFrame) -> Mesh:
    """Renames vertices, drops the merged ones, and leaves one of each elements that came to have the same vertex cycle.

    Members of sets follow to the entity that stays, once in a SET; the tags of an entity that goes are dropped.
    """
    old = vertex_map.where("old <> new").select(F.col("old").alias("id"))
    e = rewrite(mesh.element, vertex_map).withColumn("key", T.cyclic_key(F.col("conn")))
    kept = e.groupBy("etype", "key").agg(F.min("id").alias("id"), F.min_by("conn", "id").alias("conn"))
    to = e.select("etype", "id", "key").join(kept.select("etype", "key", F.col("id").alias("new")), ["etype", "key"]).where("id <> new").select("etype", F.col("id").alias("old"), "new")
    to = to.unionByName(vertex_map.where("old <> new").select(F.lit(0).cast("tinyint").alias("etype"), "old", "new"))
    m = mesh.member.join(to.withColumnRenamed("old", "id"), KEY, "left").select("sid", "pos", "etype", F.coalesce("new", "id").alias("id"))
    member = m.where(F.col("pos").isNotNull()).unionByName(m.where(F.col("pos").isNull()).distinct())
    gone = to.select("etype", F.col("old").alias("id"))
    tags = {k: t.join(gone, KEY, "left_anti") for k, t in mesh.tags.items()}
    return replace(mesh, vertex=mesh.vertex.join(old, "id", "left_anti"), element=kept.select("etype", "id", "conn"), member=member, tags=tags)


def transform(vertex: DataFrame, m: list[list[float]]) -> DataFrame:
    """Affine change of coordinates; rows of 3x4."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    new = [r[0] * x + r[1] * y + r[2] * z + r[3] for r in m]
    return vertex.select("id", *[c.alias(n) for c, n in zip(new, "xyz", strict=True)])


def add_mid_nodes(mesh: Mesh, edges: bool = True, faces: bool = False, volumes: bool = False) -> Mesh:
    """Higher order: a new vertex at the mean of each distinct edge (face, volume), appended to the connectivity in canonical order."""
    from .adjacency import sides

    e = mesh.element.withColumn("conn", T.corners(F.col("etype"), F.col("conn")))
    last = mesh.vertex.agg(F.max("id")).first()[0]
    vertex, extra = mesh.vertex, e.select(*KEY, F.lit(-1).alias("dim"), F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("mid")).limit(0)
    for dim, on in ((1, edges), (2, faces), (3, volumes)):
        if not on:
            continue
        s = sides(e, dim) if dim < 3 else e.where(T.dimension(F.col("etype")) == 3).select(*KEY, F.lit(0).alias("side"), F.col("conn").alias("verts"), F.array_sort("conn").alias("key"))
        if dim == 2:
            own = e.where(T.dimension(F.col("etype")) == 2)
            s = s.unionByName(own.select(*KEY, F.lit(0).alias("side"), F.col("conn").alias("verts"), T.cyclic_key(F.col("conn")).alias("key")))
        mids = dense_ids(s.select("key").distinct(), ["key"], "mid", last + 1)
        at = mids.select("mid", F.explode("key").alias("id")).join(mesh.vertex, "id").groupBy("mid").agg(*[F.avg(c).alias(c) for c in "xyz"])
        vertex = vertex.unionByName(at.withColumnRenamed("mid", "id"))
        extra = extra.unionByName(s.join(mids, "key").select(*KEY, F.lit(dim).alias("dim"), "side", "mid"))
        last += mids.count()
    tail = extra.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "side", "mid"))), lambda s: s["mid"]).alias("tail"))
    conn = F.concat("conn", F.coalesce("tail", F.array().cast("array<bigint>")))
    return replace(mesh, vertex=vertex, element=e.join(tail, KEY, "left").select(*KEY, conn.alias("conn")))


def drop_mid_nodes(mesh: Mesh) -> Mesh:
    """Corners only; vertices that only served as mid nodes go."""
    e = mesh.element.withColumn("conn", T.corners(F.col("etype"), F.col("conn")))
    used = e.select(F.explode("conn").alias("id")).distinct()
    was = mesh.element.select(F.explode("conn").alias("id")).distinct().join(used, "id", "left_anti")
    return replace(mesh, vertex=mesh.vertex.join(was, "id", "left_anti"), element=e)


def quads_to_tris(mesh: Mesh, keep: bool = False) -> Mesh:
    """Each quad becomes two triangles."""
    q = mesh.element.where(F.col("etype") == T.CODE["quad"])
    c = F.col("conn")
    halves = q.select(F.explode(F.array(F.array(c[0], c[1], c[2]), F.array(c[0], c[2], c[3]))).alias("conn")).select(F.lit(T.CODE["tri"]).cast("tinyint").alias("etype"), "conn")
    base = mesh if keep else replace(mesh, element=mesh.element.where(F.col("etype") != T.CODE["quad"]))
    last = mesh.element.agg(F.max("id")).first()[0] or 0
    new = dense_ids(halves, ["conn"], "id", last + 1).select("etype", "id", "conn")
    return replace(base, element=base.element.unionByName(new))


def check(mesh: Mesh) -> DataFrame:
    """(problem, etype, id): vertices that connectivity names but don't exist, repeated ids, members that don't exist."""
    inc = mesh.incidence()
    missing = inc.join(mesh.vertex.select(F.col("id").alias("vid")), "vid", "left_anti").select(F.lit("no such vertex").alias("problem"), *KEY)
    twice = mesh.entities().groupBy(*KEY).count().where("count > 1").select(F.lit("repeated id").alias("problem"), *KEY)
    lost = mesh.member.join(mesh.entities(), KEY, "left_anti").select(F.lit("no such member").alias("problem"), *KEY)
    return missing.unionByName(twice).unionByName(lost).distinct()
