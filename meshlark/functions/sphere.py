"""Spherical geometry and analytic test fields, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vectors as v


def to_sphere(p: v.Vec) -> tuple[Column, Column, Column]:
    """(longitude in [0, 2 pi), latitude, radius)."""
    r = v.norm(p)
    lon = F.atan2(p[1], p[0])
    return F.when(lon < 0, lon + 2 * F.pi()).otherwise(lon), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), p[2] / r))), r


def to_cartesian(lon: Column, lat: Column, r: Column | float = 1.0) -> v.Vec:
    return (r * F.cos(lat) * F.cos(lon), r * F.cos(lat) * F.sin(lon), r * F.sin(lat))


def great_circle(a: v.Vec, b: v.Vec) -> Column:
    """Angle between two directions, stable for small and large ones."""
    return F.atan2(v.norm(v.cross(a, b)), v.dot(a, b))


def triangle_area(a: v.Vec, b: v.Vec, c: v.Vec, r: float = 1.0) -> Column:
    """Area of a spherical triangle by its half-angle tangents."""
    x, y, z = great_circle(b, c), great_circle(a, c), great_circle(a, b)
    s = (x + y + z) / 2
    product = F.tan(s / 2) * F.tan((s - x) / 2) * F.tan((s - y) / 2) * F.tan((s - z) / 2)
    return 4 * F.atan(F.sqrt(F.greatest(product, F.lit(0.0)))) * r * r


def triangle_area_by_angles(a: v.Vec, b: v.Vec, c: v.Vec, r: float = 1.0) -> Column:
    """The same as the excess of its angles."""
    def corner(p: v.Vec, q: v.Vec, s: v.Vec) -> Column:
        m, n = v.cross(p, q), v.cross(p, s)
        return great_circle(m, n)

    return (corner(a, b, c) + corner(b, c, a) + corner(c, a, b) - F.pi()) * r * r


def gnomonic(p: v.Vec, plane: int) -> tuple[Column, Column]:
    """Projection from the centre onto a face of the cube around the unit sphere: 1 x+, 2 y+, 3 x-, 4 y-, 5 z-, 6 z+."""
    x, y, z = p
    return {1: (y / x, z / x), 2: (-x / y, z / y), 3: (y / x, -z / x), 4: (-x / y, -z / y), 5: (-y / z, -x / z), 6: (y / z, -x / z)}[plane]


def from_gnomonic(a: Column, b: Column, plane: int, r: float = 1.0) -> v.Vec:
    one = F.lit(1.0)
    p = {1: (one, a, b), 2: (-a, one, b), 3: (-one, -a, b), 4: (a, -one, b), 5: (b, a, -one), 6: (-b, a, one)}[plane]
    return v.mul(r / v.norm(p), p)


def face_of(p: v.Vec) -> Column:
    """The cube face that the point projects onto."""
    x, y, z = p
    big = F.greatest(F.abs(x), F.abs(y), F.abs(z))
    return F.when(F.abs(x) == big, F.when(x > 0, 1).otherwise(3)).when(F.abs(y) == big, F.when(y > 0, 2).otherwise(4)).otherwise(F.when(z > 0, 6).otherwise(5))


def smooth_field(lon: Column, lat: Column, centers: list[tuple[float, float]], height: float = 0.95, width: float = 5.0) -> Column:
    """Sum of Gaussian hills about centres (longitude, latitude)."""
    p = to_cartesian(lon, lat)
    out = F.lit(0.0)
    for clon, clat in centers:
        q = to_cartesian(F.lit(clon), F.lit(clat))
        out = out + height * F.exp(-width * v.sq(v.sub(p, q)))
    return out


def cosine_bells(lon: Column, lat: Column, centers: list[tuple[float, float]], r: float = 0.5, base: float = 0.1, top: float = 0.9) -> Column:
    """Bells of radius r on a base value."""
    p = to_cartesian(lon, lat)
    out = F.lit(base)
    for clon, clat in centers:
        d = great_circle(p, to_cartesian(F.lit(clon), F.lit(clat)))
        out = out + F.when(d < r, top * 0.5 * (1 + F.cos(F.pi() * d / r))).otherwise(0.0)
    return out


def slotted_cylinders(lon: Column, lat: Column, centers: list[tuple[float, float]], r: float = 0.5, low: float = 0.1, high: float = 1.0) -> Column:
    """Discs with a slot; the second's slot opens the other way."""
    out = F.lit(low)
    p = to_cartesian(lon, lat)
    for k, (clon, clat) in enumerate(centers):
        d = great_circle(p, to_cartesian(F.lit(clon), F.lit(clat)))
        away = F.abs(lon - clon) >= r / 6
        over = (lat - clat) < -5 * r / 12 if k == 0 else (lat - clat) > 5 * r / 12
        out = F.when((d <= r) & (away | over), F.lit(high)).otherwise(out)
    return out


def velocity(lon: Column, lat: Column, t: float, period: float = 5.0, speed: float = 2.4) -> tuple[Column, Column]:
    """Deforming flow that returns after its period: (east, north)."""
    shift = lon - 2 * F.pi() * t / period
    import math

    c = math.cos(math.pi * t / period)
    east = speed * F.sin(shift) ** 2 * F.sin(2 * lat) * c + 2 * F.pi() / period * F.cos(lat)
    return east, speed * F.sin(2 * shift) * F.cos(lat) * c


def departure(lon: Column, lat: Column, t: float, dt: float, steps: int = 4) -> tuple[Column, Column]:
    """Where a point of time t was dt before, by steps back along the flow."""
    h = dt / steps
    for k in range(steps):
        u, w = velocity(lon, lat, t - k * h)
        lon, lat = lon - h * u / F.cos(lat), lat - h * w
    return lon, lat
