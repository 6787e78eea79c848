"""Locating points in elements and carrying fields from mesh to mesh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import elements as E
from ..functions import quality
from ..functions import vectors as v
from . import spatial

KEY = ["etype", "id"]


def boxes(element: DataFrame, vertex: DataFrame) -> DataFrame:
    """(etype, id, xmin, xmax ...) of elements."""
    inc = element.select(*KEY, F.explode("conn").alias("vid"))
    at = inc.join(vertex.withColumnRenamed("id", "vid"), "vid")
    return at.groupBy(*KEY).agg(*[f(c).alias(f"{c}{n}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))])


def candidates(points: DataFrame, element: DataFrame, vertex: DataFrame, name: str, eps: float = 1e-9) -> DataFrame:
    """(point, px, py, pz, etype, id, p0 ...): points with the elements of a type whose box holds them."""
    corners = quality.with_corners(element, vertex, name)
    box = boxes(element.where(F.col("etype") == quality.CODE[name]), vertex)
    near = spatial.points_in_boxes(points, box.select("id", *[f"{c}{m}" for c in "xyz" for m in ("min", "max")]), eps)
    return near.select("point", *[F.col(c).alias(f"p{c}") for c in "xyz"], F.col("box").alias("id")).join(corners, "id")


def locate(points: DataFrame, element: DataFrame, vertex: DataFrame, name: str, tol: float = 1e-9) -> DataFrame:
    """(point, etype, id, weights): each point's element, of several the smallest id; points outside have a null id.

    ``weights``: those of the element's corners at the point.
    """
    c = candidates(points, element, vertex, name, tol)
    p = (F.col("px"), F.col("py"), F.col("pz"))
    if name in ("tri", "tet"):
        n = 3 if name == "tri" else 4
        w = (v.barycentric_tri if n == 3 else v.barycentric_tet)(p, [v.at(f"p{k}") for k in range(n)])
        hit = c.withColumn("weights", F.array(*w)).where(F.forall("weights", lambda x: x >= -tol))
    else:
        xi = E.locate(c, name)
        s = E.SIGNS[name].tolist()
        dim = len(s[0])

        def one(signs):  # noqa: ANN001, ANN202
            out = F.lit(1.0 / 2**dim)
            for d, g in enumerate(signs):
                out = out * (1 + g * F.col("xi")[d])
            return out

        hit = xi.withColumn("weights", F.array(*[one(g) for g in s]))
    best = hit.groupBy("point").agg(F.min_by(F.struct("etype", "id", "weights"), "id").alias("b"))
    return points.select(F.col("id").alias("point")).join(best, "point", "left").select("point", "b.etype", "b.id", "b.weights")


def interpolate(located: DataFrame, element: DataFrame, field: DataFrame, method: str = "linear") -> DataFrame:
    """(point, value).  constant: the element's value (etype, id, value); linear: vertex values (id, value) by weights."""
    if method == "constant":
        return located.join(field, KEY, "left").select("point", "value")
    if method != "linear":
        raise ValueError(f"no such method: {method}")
    long = located.join(element, KEY, "left").select("point", F.posexplode_outer("conn").alias("pos", "vid"), "weights")
    got = long.join(field.select(F.col("id").alias("vid"), "value"), "vid", "left")
    return got.groupBy("point").agg(F.sum(F.col("value") * F.get("weights", F.col("pos"))).alias("value"))


def integrals(element: DataFrame, vertex: DataFrame, field: DataFrame, name: str) -> DataFrame:
    """(etype, id, integral) of a vertex field over tris and tets: mean times measure."""
    corners = {"tri": "area", "tet": "volume"}
    size = quality.measure(element, vertex, name, [corners[name]]).withColumnRenamed(corners[name], "size")
    mean = element.where(F.col("etype") == quality.CODE[name]).select(*KEY, F.explode("conn").alias("vid")).join(field.select(F.col("id").alias("vid"), "value"), "vid").groupBy(*KEY).agg(F.avg("value").alias("mean"))
    return size.join(mean, KEY).select(*KEY, (F.col("size") * F.col("mean")).alias("integral"))
