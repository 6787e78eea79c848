"""Overlay of two planar or spherical meshes: intersection polygons, areas and conservative remap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["etype", "id"]


def clip(subject: np.ndarray, window: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """The part of a convex polygon (n, 2) inside another, both anticlockwise: half-plane by half-plane."""
    out = subject
    for k in range(len(window)):
        if not len(out):
            return out
        a, b = window[k], window[(k + 1) % len(window)]
        d = b - a
        side = d[0] * (out[:, 1] - a[1]) - d[1] * (out[:, 0] - a[0])
        pts = []
        for i in range(len(out)):
            j = (i + 1) % len(out)
            if side[i] >= -tol:
                pts.append(out[i])
            if (side[i] > tol and side[j] < -tol) or (side[i] < -tol and side[j] > tol):
                s = side[i] / (side[i] - side[j])
                pts.append(out[i] + s * (out[j] - out[i]))
        out = np.array(pts).reshape(-1, 2)
    return out


def area(p: np.ndarray) -> float:
    if len(p) < 3:
        return 0.0
    x, y = p[:, 0], p[:, 1]
    return 0.5 * float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))


def sphere_area(p: np.ndarray) -> float:
    """Area of a spherical polygon of unit vectors (n, 3), as signed excesses of its fan."""
    total = 0.0
    for k in range(1, len(p) - 1):
        a, b, c = p[0], p[k], p[k + 1]
        total += 2 * math.atan2(float(np.dot(a, np.cross(b, c))), 1 + float(a @ b + b @ c + c @ a))
    return abs(total)


def rings(element: DataFrame, vertex: DataFrame) -> DataFrame:
    """(id, xs, ys, zs): corners of faces in order."""
    long = element.select("id", F.posexplode("conn").alias("pos", "vid")).join(vertex.withColumnRenamed("id", "vid"), "vid")
    s = F.array_sort(F.collect_list(F.struct("pos", "x", "y", "z")))
    return long.groupBy("id").agg(s.alias("s")).select("id", *[F.col(f"s.{c}").alias(f"{c}s") for c in "xyz"])


def intersect(red: DataFrame, red_vertex: DataFrame, blue: DataFrame, blue_vertex: DataFrame, sphere: bool = False) -> DataFrame:
    """(red, blue, area, xs, ys, zs): polygons that pairs of faces share.

    Pairs come from a grid join of bounding boxes.  On the sphere a pair is projected from the centre onto the
    plane that touches the sphere at the red face's middle, where great arcs are straight.
    """
    a, b = rings(red, red_vertex), rings(blue, blue_vertex)
    coords = "xyz" if sphere else "xy"

    def box(d: DataFrame) -> DataFrame:
        grow = 0.0
        if sphere:  # an arc bulges beyond its chord's box by at most this part of its span
            grow = F.greatest(*[F.array_max(f"{c}s") - F.array_min(f"{c}s") for c in coords])
        return d.select("*", *[e for c in coords for e in ((F.array_min(f"{c}s") - grow).alias(f"{c}min"), (F.array_max(f"{c}s") + grow).alias(f"{c}max"))])

    a, b = box(a), box(b)
    mean = a.agg(*[F.avg(F.col(f"{c}max") - F.col(f"{c}min")).alias(c) for c in coords]).first()
    cell = max([m for m in mean if m] or [1.0])

    def listed(d: DataFrame, tag: str) -> DataFrame:
        for k, c in enumerate(coords):
            d = d.withColumn(f"c{k}", F.explode(F.sequence(F.floor(F.col(f"{c}min") / cell), F.floor(F.col(f"{c}max") / cell))))
        keys = [f"c{k}" for k in range(len(coords))]
        return d.select(*keys, *[F.col(x).alias(f"{tag}_{x}") for x in d.columns if x not in keys])

    near = listed(a, "r").join(listed(b, "b"), [f"c{k}" for k in range(len(coords))])
    for k, c in enumerate(coords):  # a pair in many cells counts in the first that both touch
        near = near.where(F.col(f"c{k}") == F.floor(F.greatest(f"r_{c}min", f"b_{c}min") / cell)).where((F.col(f"r_{c}min") <= F.col(f"b_{c}max")) & (F.col(f"b_{c}min") <= F.col(f"r_{c}max")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            rows = []
            for r in d.itertuples():
                p = np.stack([r.r_xs, r.r_ys, r.r_zs], 1)
                q = np.stack([r.b_xs, r.b_ys, r.b_zs], 1)
                if sphere:
                    p, q = p / np.linalg.norm(p, axis=1, keepdims=True), q / np.linalg.norm(q, axis=1, keepdims=True)
                    n = p.sum(0) / np.linalg.norm(p.sum(0))
                    if (q @ n).min() <= 1e-6 or (p @ n).min() <= 1e-6:
                        continue
                    u = np.cross(n, [1.0, 0, 0] if abs(n[0]) < 0.9 else [0, 1.0, 0])
                    u /= np.linalg.norm(u)
                    w = np.cross(n, u)
                    flat = [np.stack([(s @ u) / (s @ n), (s @ w) / (s @ n)], 1) for s in (p, q)]
                else:
                    flat = [p[:, :2], q[:, :2]]
                flat = [f if area(f) >= 0 else f[::-1] for f in flat]
                out = clip(*flat)
                if area(out) <= 1e-14:
                    continue
                if sphere:
                    xyz = n + out[:, :1] * u + out[:, 1:] * w
                    xyz /= np.linalg.norm(xyz, axis=1, keepdims=True)
                    size = sphere_area(xyz)
                else:
                    xyz, size = np.column_stack([out, np.zeros(len(out))]), area(out)
                rows.append((r.r_id, r.b_id, size, *xyz.T.tolist()))
            yield pd.DataFrame(rows, columns=["red", "blue", "area", "xs", "ys", "zs"])

    return near.select("r_id", "r_xs", "r_ys", "r_zs", "b_id", "b_xs", "b_ys", "b_zs").mapInPandas(run, "red bigint, blue bigint, area double, xs array<double>, ys array<double>, zs array<double>")


def remap(overlap: DataFrame, values: DataFrame) -> DataFrame:
    """(id, value) on the blue faces: area-weighted mean of the red values (id, value); the integral is kept."""
    j = overlap.join(values.select(F.col("id").alias("red"), "value"), "red")
    return j.groupBy(F.col("blue").alias("id")).agg((F.sum(F.col("area") * F.col("value")) / F.sum("area")).alias("value"))


def advect(element: DataFrame, vertex: DataFrame, values: DataFrame, t: float, dt: float) -> DataFrame:
    """(id, value): one conservative step of the deforming flow on the unit sphere.

    Vertices are traced back over dt; each departure face takes the area-weighted mean of what it covers.
    """
    from ..functions import sphere

    lon, lat, _ = sphere.to_sphere((F.col("x"), F.col("y"), F.col("z")))
    lon, lat = sphere.departure(lon, lat, t, dt)
    back = vertex.select("id", *[c.alias(n) for c, n in zip(sphere.to_cartesian(lon, lat), "xyz", strict=True)])
    return remap(intersect(element, vertex, element, back, sphere=True), values)
