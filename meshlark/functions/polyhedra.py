"""Convex polyhedra as lists of faces (arrays of corners, outwards anticlockwise): cutting, volume, containment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .topology import FACES


def box(lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    corners = np.array([[x, y, z] for z in (lo[2], hi[2]) for x, y in ((lo[0], lo[1]), (hi[0], lo[1]), (hi[0], hi[1]), (lo[0], hi[1]))], float)
    return [corners[list(f)] for f in FACES["hex"]]


def cut(faces: list[np.ndarray], normal: np.ndarray, offset: float, tol: float = 1e-12) -> list[np.ndarray]:
    """What lies on the side where normal . p + offset <= 0; empty if nothing does.

    Each face is clipped; the points on the plane, sorted around their middle, close the cut.
    """
    out, rim = [], []
    for f in faces:
        side = f @ normal + offset
        pts = []
        for k in range(len(f)):
            j = (k + 1) % len(f)
            if side[k] <= tol:
                pts.append(f[k])
                if abs(side[k]) <= tol:
                    rim.append(f[k])
            if min(side[k], side[j]) < -tol and max(side[k], side[j]) > tol:
                p = f[k] + side[k] / (side[k] - side[j]) * (f[j] - f[k])
                pts.append(p)
                rim.append(p)
        if len(pts) >= 3:
            out.append(np.array(pts))
    if not out or all((np.abs(f @ normal + offset) <= tol).all() for f in out):
        return []
    if any((np.abs(f @ normal + offset) <= tol).all() for f in out) or len(rim) < 3:
        return out  # the plane only touches
    rim = np.array(rim)
    n = normal / np.linalg.norm(normal)
    u = np.cross(n, [1.0, 0, 0] if abs(n[0]) < 0.9 else [0, 1.0, 0])
    w = np.cross(n, u)
    mid = rim.mean(0)
    rim = rim[np.argsort(np.arctan2((rim - mid) @ w, (rim - mid) @ u))]
    keep = np.linalg.norm(rim - np.roll(rim, 1, 0), axis=1) > tol
    if keep.sum() >= 3:
        out.append(rim[keep])
    return out


def volume(faces: list[np.ndarray]) -> float:
    """Tets from one corner to a fan of every face."""
    if not faces:
        return 0.0
    o = faces[0][0]
    return sum(float(np.dot(f[0] - o, np.cross(f[k] - o, f[k + 1] - o))) for f in faces for k in range(1, len(f) - 1)) / 6


def contains(faces: list[np.ndarray], p: np.ndarray, tol: float = 1e-12) -> bool:
    for f in faces:
        n = sum((np.cross(f[k] - f[0], f[k + 1] - f[0]) for k in range(1, len(f) - 1)), np.zeros(3))
        if np.dot(n, p - f[0]) > tol * (1 + np.linalg.norm(n)):
            return False
    return bool(faces)


def cut_boxes(rows: DataFrame) -> DataFrame:
    """(id, volume): boxes (xmin ... zmax) cut by a plane (a, b, c, d): what is left where a x + b y + c z + d <= 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lo, hi = b[["xmin", "ymin", "zmin"]].to_numpy(float), b[["xmax", "ymax", "zmax"]].to_numpy(float)
            plane = b[["a", "b", "c", "d"]].to_numpy(float)
            yield pd.DataFrame({"id": b["id"], "volume": [volume(cut(box(x, y), p[:3], p[3])) for x, y, p in zip(lo, hi, plane, strict=True)]})

    return rows.select("id", *[f"{c}{m}" for c in "xyz" for m in ("min", "max")], "a", "b", "c", "d").mapInPandas(run, "id bigint, volume double")
