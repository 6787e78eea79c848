"""Command line: convert, size, quality, skin, depth, part, refine, merge.

    python -m meshlark convert in.vtk out.msh
    python -m meshlark quality in.vtk
    python -m meshlark part 8 in.vtk out_tables
"""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import quality
from .functions import topology as T
from .operators import adjacency, aggregate, dml, refine, spatial
from .operators.mesh import Mesh
from .sources import registry


def size(mesh: Mesh):  # noqa: ANN201
    """Counts by type, and statistics of the edges' lengths."""
    kinds = aggregate.counts(mesh.element, ["etype"])
    edges = adjacency.construct_sides(mesh.element, 1)
    lengths = quality.measure(edges, mesh.vertex, "edge", ["length"])
    return kinds, aggregate.stats(lengths, ["etype"], "length")


def skin(mesh: Mesh) -> Mesh:
    """The boundary as a mesh of its own."""
    dim = mesh.element.select(F.max(T.dimension(F.col("etype")))).first()[0]
    s = adjacency.skin(mesh.element.where(T.dimension(F.col("etype")) == dim), dim - 1)
    kind = F.when(F.size("verts") == 2, T.CODE["edge"]).when(F.size("verts") == 3, T.CODE["tri"]).otherwise(T.CODE["quad"]).cast("tinyint")
    from .operators.ordered import dense_ids

    e = dense_ids(s.select("key", kind.alias("etype"), F.col("verts").alias("conn")), ["key"], "id").select("etype", "id", "conn")
    used = e.select(F.explode("conn").alias("id")).distinct()
    return Mesh.build(mesh.vertex.join(used, "id", "left_semi"), e)


def depth(mesh: Mesh) -> Mesh:
    dim = mesh.element.select(F.max(T.dimension(F.col("etype")))).first()[0]
    d = adjacency.depth_from(mesh.incidence(), adjacency.skin_vertices(mesh.element, dim - 1))
    return mesh.with_tag("depth", d.withColumnRenamed("depth", "value"))


def part(mesh: Mesh, n: int) -> Mesh:
    """Slices of near-equal size along the Z-order curve of element middles, as the tag PARALLEL_PARTITION."""
    at = mesh.coordinates().where("etype > 0")
    p = spatial.curve_partition(at.select("id", "x", "y", "z"), n)
    tag = at.select("etype", "id").join(p, "id").withColumnRenamed("part", "value")
    return mesh.with_tag("PARALLEL_PARTITION", tag)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="meshlark")
    sub = p.add_subparsers(dest="what", required=True)
    for name, more in {"convert": ["out"], "size": [], "quality": [], "skin": ["out"], "depth": ["out"], "part": ["out"], "refine": ["out"], "merge": ["out"]}.items():
        s = sub.add_parser(name)
        if name in ("part", "refine"):
            s.add_argument("n", type=int)
        if name == "merge":
            s.add_argument("tolerance", type=float)
        s.add_argument("input")
        for m in more:
            s.add_argument(m)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("meshlark").getOrCreate()
    mesh = registry.load(spark, a.input)
    if a.what == "size":
        for d in size(mesh):
            d.show(50, truncate=False)
    elif a.what == "quality":
        for name in ("tri", "quad", "tet", "hex"):
            q = quality.measure(mesh.element, mesh.vertex, name)
            aggregate.metric_range(q, ["etype"], [c for c in q.columns if c not in ("etype", "id")]).show(50, truncate=False)
    else:
        if a.what == "skin":
            mesh = skin(mesh)
        elif a.what == "depth":
            mesh = depth(mesh)
        elif a.what == "part":
            mesh = part(mesh, a.n)
        elif a.what == "merge":
            mesh = dml.apply_merge(mesh, dml.merge_close(mesh.vertex, a.tolerance))
        elif a.what == "refine":
            top = mesh.element.agg(F.max("etype")).first()[0]
            mesh, _ = refine.uniform(replace(mesh, element=mesh.element.where(F.col("etype") == top)), T.ETYPES[top][0], a.n)
        registry.save(mesh, a.out)


if __name__ == "__main__":
    main()
