"""Entity types and canonical numbering of element sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The entity types in handle order, with dimension and corner count (0: varies).
ETYPES = [
    ("vertex", 0, 1),
    ("edge", 1, 2),
    ("tri", 2, 3),
    ("quad", 2, 4),
    ("polygon", 2, 0),
    ("tet", 3, 4),
    ("pyramid", 3, 5),
    ("prism", 3, 6),
    ("knife", 3, 7),
    ("hex", 3, 8),
    ("polyhedron", 3, 0),
    ("entityset", 4, 0),
]
CODE = {name: k for k, (name, _, _) in enumerate(ETYPES)}
DIM = {name: d for name, d, _ in ETYPES}

# Corners of each edge and each face, by element type.
EDGES = {
    "edge": [(0, 1)],
    "tri": [(0, 1), (1, 2), (2, 0)],
    "quad": [(0, 1), (1, 2), (2, 3), (3, 0)],
    "tet": [(0, 1), (1, 2), (2, 0), (0, 3), (1, 3), (2, 3)],
    "pyramid": [(0, 1), (1, 2), (2, 3), (3, 0), (0, 4), (1, 4), (2, 4), (3, 4)],
    "prism": [(0, 1), (1, 2), (2, 0), (0, 3), (1, 4), (2, 5), (3, 4), (4, 5), (5, 3)],
    "knife": [(0, 1), (1, 2), (2, 3), (3, 0), (0, 4), (1, 5), (2, 6), (3, 5), (4, 5), (5, 6)],
    "hex": [(0, 1), (1, 2), (2, 3), (3, 0), (0, 4), (1, 5), (2, 6), (3, 7), (4, 5), (5, 6), (6, 7), (7, 4)],
}
FACES = {
    "tri": [(0, 1, 2)],
    "quad": [(0, 1, 2, 3)],
    "tet": [(0, 1, 3), (1, 2, 3), (0, 3, 2), (0, 2, 1)],
    "pyramid": [(0, 1, 4), (1, 2, 4), (2, 3, 4), (3, 0, 4), (0, 3, 2, 1)],
    "prism": [(0, 1, 4, 3), (1, 2, 5, 4), (0, 3, 5, 2), (0, 2, 1), (3, 4, 5)],
    "knife": [(0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 5, 6), (3, 0, 4, 5), (0, 3, 2, 1)],
    "hex": [(0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7), (0, 3, 2, 1), (4, 5, 6, 7)],
}


def side_table(name: str, dim: int) -> list[tuple[int, ...]]:
    """Corner lists of the sides of an element type; dimension 0 gives the corners."""
    if dim == 0:
        return [(k,) for k in range(ETYPES[CODE[name]][2])]
    if dim == DIM[name]:
        return [tuple(range(ETYPES[CODE[name]][2]))]
    return (EDGES if dim == 1 else FACES if dim == 2 else {}).get(name, [])


def etype_frame(spark: SparkSession) -> DataFrame:
    rows = [(k, n, d, c) for k, (n, d, c) in enumerate(ETYPES)]
    return spark.createDataFrame(rows, "etype tinyint, name string, dim int, n_corners int")


def dimension(etype: Column) -> Column:
    """Topological dimension of a type code; null for one that doesn't exist."""
    return F.element_at(F.array(*[F.lit(d) for _, d, _ in ETYPES]), F.when((etype >= 0) & (etype < len(ETYPES)), etype.cast("int") + 1))


def corners(etype: Column, conn: Column) -> Column:
    """Connectivity without higher-order nodes; polygons lose repeated trailing vertices."""
    n = F.element_at(F.array(*[F.lit(c) for _, _, c in ETYPES]), etype.cast("int") + 1)
    trailing = F.aggregate(F.reverse(conn), F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda a, v: F.struct((a["n"] + F.when(a["go"] & (v == F.element_at(conn, -1)), 1).otherwise(0)).alias("n"), (a["go"] & (v == F.element_at(conn, -1))).alias("go")), lambda a: a["n"])
    padded = F.when(F.size(conn) > 0, F.slice(conn, 1, F.greatest(F.lit(1), F.size(conn) - trailing + 1))).otherwise(conn)
    return F.when(n > 0, F.slice(conn, 1, n)).when(etype == CODE["polygon"], padded).otherwise(conn)


def pack_handle(etype: Column, eid: Column) -> Column:
    """One sortable number for (type, id): the type sits at bit 56, so no value is negative."""
    return F.shiftleft(etype.cast("bigint"), 56) + eid


def unpack_handle(handle: Column) -> tuple[Column, Column]:
    """(type, id) of a packed handle."""
    return F.shiftright(handle, 56).cast("tinyint"), handle.bitwiseAND(F.lit((1 << 56) - 1))


def cyclic_key(verts: Column) -> Column:
    """Key that is equal exactly for cyclic shifts and reversals of a vertex list.

    The smallest vertex comes first, then its smaller neighbour.  Needs distinct vertices.
    """
    def turned(v: Column) -> Column:
        n = F.size(v)
        at = F.array_position(v, F.array_min(v)).cast("int")
        forward = F.concat(F.slice(v, at, n), F.slice(v, 1, at - 1))
        back = F.concat(F.slice(forward, 1, 1), F.reverse(F.slice(forward, 2, F.greatest(n - 1, F.lit(0)))))
        return F.when(n < 3, F.array_sort(v)).when(F.get(forward, F.lit(1)) <= F.get(back, F.lit(1)), forward).otherwise(back)

    return F.transform(F.array(verts), turned)[0]


def sense(side: Column, reference: Column) -> Column:
    """1 if the side runs as the reference does, -1 if reversed, 0 if they aren't the same cycle."""
    def turn(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        at = F.array_position(b, F.get(a, F.lit(0))).cast("int")
        n = F.size(b)
        shifted = F.concat(F.slice(b, F.greatest(at, F.lit(1)), n), F.slice(b, 1, F.greatest(at - 1, F.lit(0))))
        flipped = F.concat(F.slice(shifted, 1, 1), F.reverse(F.slice(shifted, 2, F.greatest(n - 1, F.lit(0)))))
        same = F.when(n == 2, F.when(a == b, 1).when(a == F.reverse(b), -1).otherwise(0)).when(a == shifted, 1).when(a == flipped, -1).otherwise(0)
        return F.when((at == 0) | (F.size(a) != n), F.lit(0)).otherwise(same)

    return F.transform(F.array(F.struct(side.alias("a"), reference.alias("b"))), turn)[0]
