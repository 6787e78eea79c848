"""Registered queries: structured boxes, topology, quality, spheres, location, overlay and solids.

Boxes, and triples or quadruples of the embeddings' first three components as triangles and tets, stand for meshes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality, sphere
from ..functions import topology as T
from ..functions import vectors as v
from ..operators import adjacency, aggregate, coupler, dml, ordered, overlay, partition, refine, solids, spatial, structured
from ..operators.mesh import Mesh
from . import tables as t

Q, SQL = {}, {}
N = (12, 9, 7)
BOX = (0, 0, 0, *N)


def query(sql: str | None):  # noqa: ANN201
    def put(f):  # noqa: ANN001, ANN202
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _brick(spark: SparkSession) -> Mesh:
    return structured.brick(spark, BOX)


_IJK = f"(SELECT i, j, k, i + {N[0]} * (j + {N[1]} * k) + 1 AS id FROM range({N[0]}) a(i), range({N[1]}) b(j), range({N[2]}) c(k))"
_V = f"(SELECT i, j, k, i + {N[0] + 1} * (j + {N[1] + 1} * k) + 1 AS id FROM range({N[0] + 1}) a(i), range({N[1] + 1}) b(j), range({N[2] + 1}) c(k))"
_NV = f"({N[0] + 1} * (({N[1]} + 1)))"


@query(f"SELECT id, unnest([0,1,2,3,4,5,6,7]) AS pos, unnest([b, b+1, b+1+{N[0] + 1}, b+{N[0] + 1}, b+{_NV}, b+1+{_NV}, b+1+{N[0] + 1}+{_NV}, b+{N[0] + 1}+{_NV}]) AS vid FROM (SELECT id, i + {N[0] + 1} * (j + {N[1] + 1} * k) + 1 AS b FROM {_IJK})")
def structured_brick(spark, sf):
    return _brick(spark).incidence().select("id", "pos", "vid")


@query(f"SELECT id, CAST(i AS DOUBLE) AS x, CAST(j AS DOUBLE) AS y, CAST(k AS DOUBLE) AS z FROM {_V}")
def structured_coordinates(spark, sf):
    return _brick(spark).vertex


@query(f"SELECT id, CAST(least(i, {N[0] - 1} - i, j, {N[1] - 1} - j, k, {N[2] - 1} - k) AS INTEGER) AS depth FROM {_IJK}")
def depth_from_skin(spark, sf):
    """Rings of cells from the boundary inwards."""
    m = _brick(spark)
    return adjacency.depth_from(m.incidence(), adjacency.skin_vertices(m.element, 2)).select("id", "depth")


@query(f"SELECT id, count(*) AS n FROM (SELECT id, unnest(CASE WHEN i = 0 THEN [1] ELSE [] END || CASE WHEN i = {N[0] - 1} THEN [1] ELSE [] END || CASE WHEN j = 0 THEN [1] ELSE [] END || CASE WHEN j = {N[1] - 1} THEN [1] ELSE [] END || CASE WHEN k = 0 THEN [1] ELSE [] END || CASE WHEN k = {N[2] - 1} THEN [1] ELSE [] END) FROM {_IJK}) GROUP BY id")
def skin_faces(spark, sf):
    """Boundary faces of each cell."""
    return adjacency.skin(_brick(spark).element, 2).groupBy("id").agg(F.count("*").alias("n"))


@query(f"SELECT a.id AS a, b.id AS b FROM {_IJK} a JOIN {_IJK} b ON abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1")
def face_neighbours(spark, sf):
    return adjacency.neighbours(_brick(spark).element, 2).select("a", "b")


@query(f"SELECT 'edges' AS kind, {N[0] * (N[1] + 1) * (N[2] + 1) + N[1] * (N[0] + 1) * (N[2] + 1) + N[2] * (N[0] + 1) * (N[1] + 1)} AS n UNION ALL SELECT 'faces', {(N[0] + 1) * N[1] * N[2] + N[0] * (N[1] + 1) * N[2] + N[0] * N[1] * (N[2] + 1)}")
def construct_sides(spark, sf):
    """New edges and faces, one for each distinct side."""
    e = _brick(spark).element
    out = None
    for kind, dim in (("edges", 1), ("faces", 2)):
        part = adjacency.construct_sides(e, dim).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.col("n").cast("int").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"SELECT id, side, CAST(CASE side WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 0 ELSE 1 END AS INTEGER) AS opposite FROM (SELECT i + {N[0]} * j + 1 AS id, unnest([0, 1, 2, 3]) AS side FROM range({N[0]}) a(i), range({N[1]}) b(j))")
def opposite_sides(spark, sf):
    m = structured.brick(spark, (0, 0, 0, N[0], N[1], 0))
    return adjacency.opposite_side(m.element).select("id", "side", "opposite")


@query(f"SELECT {N[0] + N[1]} AS sheets, {2 * N[0] * N[1]} + {N[0] + N[1]} AS edges")
def dual_chords(spark, sf):
    """Chords of a quad grid: one for each row and each column of cells."""
    m = structured.brick(spark, (0, 0, 0, N[0], N[1], 0))
    s = adjacency.sheets(m.element)
    edges = adjacency.sides(m.element, 1).select("key").distinct().agg(F.count("*").cast("int").alias("edges"))
    return s.agg(F.countDistinct("sheet").cast("int").alias("sheets")).crossJoin(F.broadcast(edges))


@query(f"SELECT {N[0] * N[1] * N[2]} AS vertices, {(N[0] - 1) * N[1] * N[2] + N[0] * (N[1] - 1) * N[2] + N[0] * N[1] * (N[2] - 1)} AS edges, round(CAST({N[0] / 2} AS DOUBLE), 6) AS x")
def dual_mesh(spark, sf):
    points, edges = adjacency.dual(_brick(spark))
    p = points.agg(F.count("*").cast("int").alias("vertices"), F.round(F.avg("x"), 6).alias("x"))
    return p.crossJoin(F.broadcast(edges.agg(F.count("*").cast("int").alias("edges")))).select("vertices", "edges", "x")


@query(f"SELECT {(2 * N[0] + 1) * (2 * N[1] + 1) * (2 * N[2] + 1)} AS vertices, {8 * N[0] * N[1] * N[2]} AS cells, 8 AS least, 8 AS most")
def refine_hexes(spark, sf):
    """Degree 2: eight children a cell, sharing new vertices."""
    m, kids = refine.uniform(_brick(spark), "hex", 2)
    per = kids.groupBy("parent").count().agg(F.min("count").cast("int").alias("least"), F.max("count").cast("int").alias("most"))
    one = m.vertex.agg(F.count("*").cast("int").alias("vertices")).crossJoin(F.broadcast(m.element.agg(F.count("*").cast("int").alias("cells"))))
    return one.crossJoin(F.broadcast(per))


@query(f"SELECT {N[0] * N[1] * 2 * 9} AS cells, {(3 * N[0] + 1) * (3 * N[1] + 1)} AS vertices, round(CAST({N[0] * N[1]} AS DOUBLE), 6) AS area")
def refine_tris(spark, sf):
    """Degree 3 over the triangles of a cut quad grid; the area stays."""
    m = dml.quads_to_tris(structured.brick(spark, (0, 0, 0, N[0], N[1], 0)))
    fine, _ = refine.uniform(m, "tri", 3)
    area = quality.measure(fine.element, fine.vertex, "tri", ["area"]).agg(F.count("*").cast("int").alias("cells"), F.round(F.sum("area"), 6).alias("area"))
    return area.crossJoin(F.broadcast(fine.vertex.agg(F.count("*").cast("int").alias("vertices")))).select("cells", "vertices", "area")


@query(f"SELECT {(N[0] + 1) * (N[1] + 1) * (N[2] + 1)} + {N[0] * (N[1] + 1) * (N[2] + 1) + N[1] * (N[0] + 1) * (N[2] + 1) + N[2] * (N[0] + 1) * (N[1] + 1)} AS vertices, 20 AS nodes, {(N[0] + 1) * (N[1] + 1) * (N[2] + 1)} AS corners")
def higher_order(spark, sf):
    """Mid-edge nodes are added and taken away again."""
    m = dml.add_mid_nodes(_brick(spark))
    back = dml.drop_mid_nodes(m)
    count = lambda d, n: d.agg(F.count("*").cast("int").alias(n))
    return count(m.vertex, "vertices").crossJoin(F.broadcast(m.element.agg(F.max(F.size("conn")).alias("nodes")))).crossJoin(F.broadcast(count(back.vertex, "corners")))


@query(f"SELECT CAST({N[0] * N[1] * N[2]} AS DOUBLE) AS volume, CAST({2 * (N[0] * N[1] + N[1] * N[2] + N[0] * N[2])} AS DOUBLE) AS area")
def solid_volume(spark, sf):
    """Divergence theorem over the boundary triangles of a box."""
    return _volume(spark)


def _volume(spark: SparkSession) -> DataFrame:
    d = _surface(spark).select("sense", F.lit(1).alias("solid"), *[f"{c}{k}" for k in range(3) for c in "xyz"])
    return aggregate.volume(d, ["solid"]).select(F.round("volume", 6).alias("volume"), F.round("area", 6).alias("area"))


def _surface(spark: SparkSession) -> DataFrame:
    """(surface, id, volume, sense, v0.., x0..z2): the boundary of the box as triangles, outwards."""
    m = _brick(spark)
    s = adjacency.skin(m.element, 2).select("verts")
    c = F.col("verts")
    tri = s.select(F.explode(F.array(F.array(c[0], c[1], c[2]), F.array(c[0], c[2], c[3]))).alias("conn"))
    tri = ordered.dense_ids(tri, ["conn"], "id").select(F.lit(T.CODE["tri"]).cast("tinyint").alias("etype"), "id", "conn")
    at = quality.with_corners(tri, m.vertex, "tri").join(tri.select("id", "conn"), "id")
    return at.select(F.lit(1).cast("bigint").alias("surface"), "id", F.lit(1).cast("bigint").alias("volume"), F.lit(1).alias("sense"), *[F.col("conn")[k].alias(f"v{k}") for k in range(3)], *[F.col(f"p{k}.{x}").alias(f"{x}{k}") for k in range(3) for x in "xyz"])


#: Points scattered over and around the box, from part keys.
_PROBE = "(SELECT p_partkey AS id, (p_partkey * 37 % 1009) / 1009.0 * 14 - 1 + 0.0137 AS x, (p_partkey * 59 % 1013) / 1013.0 * 11 - 1 + 0.0071 AS y, (p_partkey * 83 % 1019) / 1019.0 * 9 - 1 + 0.0053 AS z FROM part)"


def _probe(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    at = lambda a, m, s, o: ((k * a % m) / F.lit(float(m)) * s - 1 + o).cast("double")
    return t.table(spark, sf, "part").select(k.alias("id"), at(37, 1009, 14, 0.0137).alias("x"), at(59, 1013, 11, 0.0071).alias("y"), at(83, 1019, 9, 0.0053).alias("z"))


_IN = f"x BETWEEN 0 AND {N[0]} AND y BETWEEN 0 AND {N[1]} AND z BETWEEN 0 AND {N[2]}"


@query(f"SELECT id AS point, CAST(CASE WHEN {_IN} THEN floor(x) + {N[0]} * (floor(y) + {N[1]} * floor(z)) + 1 END AS BIGINT) AS id FROM {_PROBE}")
def locate_points(spark, sf):
    """The cell of each point; null outside."""
    m = _brick(spark)
    return coupler.locate(_probe(spark, sf), m.element, m.vertex, "hex").select("point", "id")


@query(f"SELECT id AS point, round(CASE WHEN {_IN} THEN x + 2 * y + 3 * z END, 5) AS value FROM {_PROBE}")
def interpolate_linear(spark, sf):
    """A linear vertex field comes back exactly at the points."""
    m = _brick(spark)
    f = m.vertex.select("id", (F.col("x") + 2 * F.col("y") + 3 * F.col("z")).alias("value"))
    return coupler.interpolate(coupler.locate(_probe(spark, sf), m.element, m.vertex, "hex"), m.element, f).select("point", F.round("value", 5).alias("value"))


@query(f"SELECT id AS point, CAST(CASE WHEN {_IN} THEN floor(x) * 100 + floor(y) END AS DOUBLE) AS value FROM {_PROBE}")
def interpolate_constant(spark, sf):
    m = _brick(spark)
    cell = F.col("id") - 1
    f = m.element.select("etype", "id", ((cell % N[0]) * 100 + F.floor(cell / N[0]) % N[1]).cast("double").alias("value"))
    return coupler.interpolate(coupler.locate(_probe(spark, sf), m.element, m.vertex, "hex"), m.element, f, "constant")


@query(f"SELECT id AS point, {_IN} AS inside FROM {_PROBE}")
def point_in_volume(spark, sf):
    return solids.inside_by_ray(_probe(spark, sf), _surface(spark), 1.5, 40.0).select("point", "inside")


@query(f"SELECT id AS point, {_IN} AS inside FROM {_PROBE}")
def point_in_volume_angle(spark, sf):
    """By solid angles."""
    return solids.winding(_probe(spark, sf), _surface(spark)).select("point", "inside")


@query(f"SELECT id AS ray, round({N[0]} - x, 6) AS t FROM {_PROBE} WHERE {_IN}")
def ray_fire(spark, sf):
    """Distance from points inside to the wall along +x."""
    p = _probe(spark, sf).where(_IN)
    rays = p.select(F.col("id").alias("ray"), *[F.col(c).alias(f"o{c}") for c in "xyz"], *[F.lit(d).alias(f"d{c}") for c, d in zip("xyz", (1.0, 0.0, 0.0), strict=True)])
    return solids.fire(rays, _surface(spark), 1.5, 15.0).select("ray", F.round("t", 6).alias("t"))


@query(f"SELECT id AS point, round(least(x, {N[0]} - x, y, {N[1]} - y, z, {N[2]} - z), 6) AS dist FROM {_PROBE} WHERE {_IN} AND least(x, {N[0]} - x, y, {N[1]} - y, z, {N[2]} - z) <= 1")
def closest_surface(spark, sf):
    """Distance to the wall of points that are at most 1 inside it."""
    return solids.closest(_probe(spark, sf).where(_IN), _surface(spark), 1.0).select("point", F.round("dist", 6).alias("dist"))


# --- overlay -------------------------------------------------------------

_CUT = "FROM range(6) a(i), range(5) b(j), range(4) c(p), range(3) d(q) WHERE least(i + 1, (p + 1) * 1.5) > greatest(i, p * 1.5) AND least(j + 1, (q + 1) * 1.6666666666666667) > greatest(j, q * 1.6666666666666667) + 1e-9"


def _grids(spark: SparkSession):  # noqa: ANN202
    return structured.brick(spark, (0, 0, 0, 6, 5, 0)), structured.brick(spark, (0, 0, 0, 4, 3, 0), (1.5, 5 / 3, 1.0))


@query(f"SELECT i + 6 * j + 1 AS red, p + 4 * q + 1 AS blue, round((least(i + 1, (p + 1) * 1.5) - greatest(i, p * 1.5)) * (least(j + 1, (q + 1) * 5.0 / 3) - greatest(j, q * 5.0 / 3)), 6)::DOUBLE AS area {_CUT}")
def overlay_plane(spark, sf):
    a, b = _grids(spark)
    return overlay.intersect(a.element, a.vertex, b.element, b.vertex).select("red", "blue", F.round("area", 6).alias("area"))


@query("SELECT round(sum(i * 10 + j), 6)::DOUBLE AS before, round(sum(i * 10 + j), 6)::DOUBLE AS after FROM range(6) a(i), range(5) b(j)")
def overlay_remap(spark, sf):
    """The integral before and after the remap to the other grid."""
    a, b = _grids(spark)
    cell = F.col("id") - 1
    f = a.element.select("id", ((cell % 6) * 10 + F.floor(cell / 6)).cast("double").alias("value"))
    over = overlay.intersect(a.element, a.vertex, b.element, b.vertex)
    after = overlay.remap(over, f).agg(F.round(F.sum(F.col("value") * 2.5), 6).alias("after"))
    return f.agg(F.round(F.sum("value"), 6).alias("before")).crossJoin(F.broadcast(after))


# --- embeddings as triangles and tets ---------------------------------------

_C = ", ".join(f"embedding[{k + 1}]::DOUBLE AS {c}" for k, c in enumerate("xyz"))
_TRI = f"(SELECT a.id // 3 AS id, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, c.x AS cx, c.y AS cy, c.z AS cz FROM (SELECT vec_id AS id, {_C} FROM embeddings) a JOIN (SELECT vec_id AS id, {_C} FROM embeddings) b ON b.id = a.id + 1 JOIN (SELECT vec_id AS id, {_C} FROM embeddings) c ON c.id = a.id + 2 WHERE a.id % 3 = 0)"
_LEN = f"""(SELECT id, sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)+(bz-az)*(bz-az)) AS l0, sqrt((cx-bx)*(cx-bx)+(cy-by_)*(cy-by_)+(cz-bz)*(cz-bz)) AS l1, sqrt((ax-cx)*(ax-cx)+(ay-cy)*(ay-cy)+(az-cz)*(az-cz)) AS l2,
0.5 * sqrt(power((by_-ay)*(cz-az)-(bz-az)*(cy-ay), 2) + power((bz-az)*(cx-ax)-(bx-ax)*(cz-az), 2) + power((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax), 2)) AS s FROM {_TRI})"""


def _cells(spark: SparkSession, sf: str, name: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Every n consecutive vectors are an element."""
    p = t.points(spark, sf)
    e = p.groupBy(F.floor(F.col("id") / n).alias("cell")).agg(F.array_sort(F.collect_list("id")).alias("conn")).where(F.size("conn") == n)
    return e.select(F.lit(T.CODE[name]).cast("tinyint").alias("etype"), F.col("cell").alias("id"), "conn"), p


@query(f"SELECT id, round(greatest(l0,l1,l2)/least(l0,l1,l2), 5) AS edge_ratio, round(s, 7) AS area, round((l0*l0+l1*l1+l2*l2)/(4*sqrt(3)*s), 4) AS aspect_frobenius, round(l0*l1*l2*(l0+l1+l2)/(16*s*s), 3) AS radius_ratio, round(4*sqrt(3)*s/(l0*l0+l1*l1+l2*l2), 5) AS shape, round(degrees(acos(greatest(-1,least(1,(l0*l0+l2*l2-l1*l1)/(2*l0*l2))))), 3) AS angle FROM {_LEN}")
def quality_tris(spark, sf):
    e, p = _cells(spark, sf, "tri", 3)
    q = quality.measure(e, p, "tri", ["edge_ratio", "area", "aspect_frobenius", "radius_ratio", "shape"])
    c = quality.with_corners(e, p, "tri").select("id", F.round(v.degrees_between(v.sub(v.at("p1"), v.at("p0")), v.sub(v.at("p2"), v.at("p0"))), 3).alias("angle"))
    return q.join(c, "id").select("id", F.round("edge_ratio", 5).alias("edge_ratio"), F.round("area", 7).alias("area"), F.round("aspect_frobenius", 4).alias("aspect_frobenius"), F.round("radius_ratio", 3).alias("radius_ratio"), F.round("shape", 5).alias("shape"), "angle")


@query(f"""WITH p AS (SELECT vec_id AS id, {_C} FROM embeddings), t AS (SELECT a.id // 4 AS id, b.x-a.x AS ux, b.y-a.y AS uy, b.z-a.z AS uz, c.x-a.x AS vx, c.y-a.y AS vy, c.z-a.z AS vz, d.x-a.x AS wx, d.y-a.y AS wy, d.z-a.z AS wz FROM p a JOIN p b ON b.id = a.id + 1 JOIN p c ON c.id = a.id + 2 JOIN p d ON d.id = a.id + 3 WHERE a.id % 4 = 0)
SELECT id, round((ux*(vy*wz-vz*wy) + uy*(vz*wx-vx*wz) + uz*(vx*wy-vy*wx)) / 6, 8) AS volume, round(ux*(vy*wz-vz*wy) + uy*(vz*wx-vx*wz) + uz*(vx*wy-vy*wx), 8) AS jacobian FROM t""")
def quality_tets(spark, sf):
    e, p = _cells(spark, sf, "tet", 4)
    q = quality.measure(e, p, "tet", ["volume", "jacobian"])
    return q.select("id", F.round("volume", 8).alias("volume"), F.round("jacobian", 8).alias("jacobian"))


@query(f"SELECT 'edge_ratio' AS metric, round(min(greatest(l0,l1,l2)/least(l0,l1,l2)), 5) AS least, round(max(greatest(l0,l1,l2)/least(l0,l1,l2)), 5) AS greatest FROM {_LEN} UNION ALL SELECT 'area', round(min(s), 5), round(max(s), 5) FROM {_LEN}")
def quality_range(spark, sf):
    e, p = _cells(spark, sf, "tri", 3)
    r = aggregate.metric_range(quality.measure(e, p, "tri", ["edge_ratio", "area"]), ["etype"], ["edge_ratio", "area"])
    return r.select("metric", F.round("least", 5).alias("least"), F.round("greatest", 5).alias("greatest"))


@query(f"SELECT vec_id AS id, round(CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END, 6) AS lon, round(asin(z / sqrt(x*x+y*y+z*z)), 6) AS lat FROM (SELECT vec_id, {_C} FROM embeddings)")
def sphere_coordinates(spark, sf):
    p = t.points(spark, sf)
    lon, lat, _ = sphere.to_sphere((F.col("x"), F.col("y"), F.col("z")))
    return p.select("id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@query(f"WITH p AS (SELECT vec_id AS id, {_C} FROM embeddings), u AS (SELECT id, x/sqrt(x*x+y*y+z*z) AS x, y/sqrt(x*x+y*y+z*z) AS y, z/sqrt(x*x+y*y+z*z) AS z FROM p) SELECT a.id, round(acos(greatest(-1, least(1, a.x*b.x+a.y*b.y+a.z*b.z))), 5) AS angle FROM u a JOIN u b ON b.id = a.id + 1")
def great_circles(spark, sf):
    p = t.points(spark, sf)
    b = p.select((F.col("id") - 1).alias("id"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    return p.join(b, "id").select("id", F.round(sphere.great_circle(tuple(F.col(c) for c in "xyz"), tuple(F.col(f"b{c}") for c in "xyz")), 5).alias("angle"))


@query("SELECT round(4 * pi(), 6) AS total")
def sphere_area(spark, sf):
    """Triangles of a cube's skin, projected to the sphere, cover it."""
    m = structured.brick(spark, (-2, -2, -2, 2, 2, 2))
    s = adjacency.skin(m.element, 2).select("verts")
    c = F.col("verts")
    tri = s.select(F.explode(F.array(F.array(c[0], c[1], c[2]), F.array(c[0], c[2], c[3]))).alias("conn"))
    tri = ordered.dense_ids(tri, ["conn"], "id").select(F.lit(T.CODE["tri"]).cast("tinyint").alias("etype"), "id", "conn")
    return quality.with_corners(tri, m.vertex, "tri").agg(F.round(F.sum(sphere.triangle_area(v.at("p0"), v.at("p1"), v.at("p2"))), 6).alias("total"))


_NEAR = f"WITH RECURSIVE p AS (SELECT vec_id AS id, {_C} FROM embeddings), e AS (SELECT a.id AS u, b.id AS v FROM p a JOIN p b ON a.id <> b.id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) < 0.0009), w AS (SELECT id AS node, id AS r FROM p UNION SELECT e.v, w.r FROM w JOIN e ON w.node = e.u)"


@query(f"{_NEAR} SELECT node AS old, min(r) AS new FROM w GROUP BY node HAVING min(r) <> node")
def merge_tolerance(spark, sf):
    """Points nearer than the tolerance, in chains, merge into the smallest id."""
    return dml.merge_close(t.points(spark, sf), 0.03)


@query("SELECT part, count(*) AS n FROM (SELECT CAST(ntile(5) OVER (ORDER BY vec_id) - 1 AS INTEGER) AS part FROM embeddings) GROUP BY part")
def curve_parts(spark, sf):
    """Slices of the Z-order curve have near-equal size."""
    return spatial.curve_partition(t.points(spark, sf), 5).groupBy("part").agg(F.count("*").alias("n"))


@query(f"SELECT {N[0] * N[1] * N[2]} AS cells, 8 AS parts")
def box_partition(spark, sf):
    """A box in eight parts: the sub-boxes tile it."""
    rows = partition.box_parts(BOX, 8, "sqijk")
    d = spark.createDataFrame(rows, "i0 int, j0 int, k0 int, i1 int, j1 int, k1 int")
    return d.agg(F.sum((F.col("i1") - F.col("i0")) * (F.col("j1") - F.col("j0")) * (F.col("k1") - F.col("k0"))).cast("int").alias("cells"), F.count("*").cast("int").alias("parts"))


@query(f"SELECT vid, 4 AS size, true AS closed FROM (SELECT i + {N[0] + 1} * j + 1 AS vid FROM range(1, {N[0]}) a(i), range(1, {N[1]}) b(j))")
def vertex_rings(spark, sf):
    """Faces around each inner vertex of a quad grid, as a closed cycle."""
    m = structured.brick(spark, (0, 0, 0, N[0], N[1], 0))
    return ordered.rings(m.element).where("closed").select("vid", F.size("ring").alias("size"), "closed")


@query(f"SELECT 'boundary' AS kind, {2 * (N[0] + N[1])}::BIGINT AS n UNION ALL SELECT 'other', {2 * N[0] * N[1] - N[0] - N[1]}")
def boundary_kinds(spark, sf):
    """Kinds of the edges of a flat quad grid."""
    m = structured.brick(spark, (0, 0, 0, N[0], N[1], 0))
    return adjacency.boundary_class(m.element, m.vertex).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, round(CASE WHEN s <= 1 THEN s * s / 2 WHEN s < 2 THEN 1 - (2 - s) * (2 - s) / 2 ELSE 1 END, 9) AS volume FROM (SELECT p_partkey, p_size / 23.0::DOUBLE AS s FROM part)")
def cut_cells(spark, sf):
    """Unit cells cut by slanted planes."""
    from ..functions import polyhedra

    p = t.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), *[F.lit(x).alias(f"{c}{m}") for c in "xyz" for m, x in (("min", 0.0), ("max", 1.0))], F.lit(1.0).alias("a"), F.lit(1.0).alias("b"), F.lit(0.0).alias("c"), (-F.col("p_size") / 23.0).alias("d"))
    return polyhedra.cut_boxes(p).select("id", F.round("volume", 9).alias("volume"))
