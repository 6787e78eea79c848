"""Finite-element maps: evaluate, Jacobian, inverse and integral, vectorised over rows.

Linear simplices have closed forms, which are column expressions in ``vectors``; the bilinear and trilinear
maps are inverted by Newton's method in numpy over whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Signs of the corners in reference coordinates.
SIGNS = {
    "quad": np.array([(-1, -1), (1, -1), (1, 1), (-1, 1)], float),
    "hex": np.array([(-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1)], float),
}
STEPS, TOL, INSIDE = 25, 1e-10, 1e-6


def shape(name: str, xi: np.ndarray) -> np.ndarray:
    """Shape functions (rows, corners) at reference points (rows, dim)."""
    s = SIGNS[name]
    return np.prod(1 + xi[:, None, :] * s[None], axis=2) / 2 ** s.shape[1]


def slopes(name: str, xi: np.ndarray) -> np.ndarray:
    """Their derivatives (rows, corners, dim)."""
    s = SIGNS[name]
    f = 1 + xi[:, None, :] * s[None]
    out = np.empty((*f.shape[:2], s.shape[1]))
    for d in range(s.shape[1]):
        rest = [k for k in range(s.shape[1]) if k != d]
        out[..., d] = s[None, :, d] * np.prod(f[..., rest], axis=2)
    return out / 2 ** s.shape[1]


def evaluate(name: str, xi: np.ndarray, field: np.ndarray) -> np.ndarray:
    """Field (rows, corners, ...) at reference points."""
    return np.einsum("rc,rc...->r...", shape(name, xi), field)


def invert(name: str, corners: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reference coordinates and whether the point is inside; a row whose steps don't settle is outside."""
    dim = SIGNS[name].shape[1]
    corners, points = corners[..., :dim], points[:, :dim]
    xi = np.zeros((len(points), dim))
    for _ in range(STEPS):
        r = evaluate(name, xi, corners) - points
        j = np.einsum("rci,rcd->rid", corners, slopes(name, xi))
        bad = np.abs(np.linalg.det(j)) < 1e-300
        j[bad] = np.eye(dim)
        step = np.linalg.solve(j, r[..., None])[..., 0]
        xi = np.clip(xi - step, -1e6, 1e6)
        if np.abs(step).max(initial=0) < TOL:
            break
    err = np.abs(evaluate(name, xi, corners) - points).max(axis=1, initial=0)
    size = np.abs(corners - corners[:, :1]).max(axis=(1, 2), initial=0) + 1e-300
    return xi, (np.abs(xi).max(axis=1, initial=0) <= 1 + INSIDE) & (err <= 1e-8 * size + 1e-12)


def gauss(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.legendre.leggauss(n)


def integrate(name: str, corners: np.ndarray, field: np.ndarray, n: int = 2) -> np.ndarray:
    """Integral of the field over each element by tensor Gauss quadrature."""
    x, w = gauss(n)
    dim = SIGNS[name].shape[1]
    grid = np.stack(np.meshgrid(*[x] * dim, indexing="ij"), -1).reshape(-1, dim)
    weight = np.prod(np.stack(np.meshgrid(*[w] * dim, indexing="ij"), -1).reshape(-1, dim), axis=1)
    out = np.zeros(len(corners))
    for g, q in zip(grid, weight, strict=True):
        xi = np.repeat(g[None], len(corners), 0)
        j = np.einsum("rci,rcd->rid", corners, slopes(name, xi))
        if dim == corners.shape[2]:
            size = np.linalg.det(j)
        else:  # a surface in space
            size = np.linalg.norm(np.cross(j[..., 0], j[..., 1]), axis=1)
        out += q * evaluate(name, xi, field) * size
    return out


def lobatto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Lobatto points and weights: the ends and the roots of the derivative of Legendre n - 1."""
    c = np.zeros(n)
    c[-1] = 1
    leg = np.polynomial.legendre.Legendre(c)
    x = np.concatenate([[-1], np.sort(leg.deriv().roots().real), [1]])
    return x, 2 / (n * (n - 1) * leg(x) ** 2)


def lagrange(nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lagrange basis (points, nodes)."""
    out = np.ones((len(x), len(nodes)))
    for j in range(len(nodes)):
        for m in range(len(nodes)):
            if m != j:
                out[:, j] *= (x - nodes[m]) / (nodes[j] - nodes[m])
    return out


def spectral(nodes: np.ndarray, xi: np.ndarray, field: np.ndarray) -> np.ndarray:
    """Tensor Lagrange interpolation of (rows, nodes**dim) values, first axis fastest."""
    n, dim = len(nodes), xi.shape[1]
    f = field.reshape(len(xi), *[n] * dim)
    for d in range(dim):  # the last axis of what is left is the fastest
        f = np.einsum("r...n,rn->r...", f, lagrange(nodes, xi[:, d]))
    return f


def locate(pairs: DataFrame, name: str) -> DataFrame:
    """Pairs (point, etype, id, px, py, pz, p0 ...) that hold the point, with xi (array<double>)."""
    n = len(SIGNS[name])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            corners = b[[f"{c}{k}" for k in range(n) for c in "xyz"]].to_numpy(float).reshape(-1, n, 3)
            xi, inside = invert(name, corners, b[["px", "py", "pz"]].to_numpy(float))
            out = b[["point", "etype", "id"]].copy()
            out["xi"] = list(xi)
            yield out[inside]

    flat = pairs.select("point", "etype", "id", "px", "py", "pz", *[F.col(f"p{k}.{c}").alias(f"{c}{k}") for k in range(n) for c in "xyz"])
    return flat.mapInPandas(run, "point bigint, etype tinyint, id bigint, xi array<double>")
