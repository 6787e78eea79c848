"""Operators on small meshes made by hand."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlark.functions import elements, quality, sphere, strings
from meshlark.functions import topology as T
from meshlark.functions import vectors as v
from meshlark.operators import adjacency, aggregate, dml, graph, mesh, ordered, overlay, partition, refine, sets, solids, spatial, structured

TRI, QUAD, TET = T.CODE["tri"], T.CODE["quad"], T.CODE["tet"]


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


@pytest.fixture(scope="module")
def two_tris(spark):
    vertex = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 1.0, 1.0, 0.0), (4, 0.0, 1.0, 1.0), (9, 5.0, 5.0, 5.0)], mesh.VERTEX)
    element = spark.createDataFrame([(TRI, 1, [1, 2, 3]), (TRI, 2, [1, 3, 4])], mesh.ELEMENT)
    eset = spark.createDataFrame([(100, False, True), (101, True, False)], mesh.ESET)
    member = spark.createDataFrame([(100, None, TRI, 1), (100, None, 11, 101), (101, 0, TRI, 2), (101, 1, TRI, 2)], mesh.MEMBER)
    link = spark.createDataFrame([(100, 101), (101, 100)], mesh.LINK)
    tag = spark.createDataFrame([(TRI, 1, 7)], "etype tinyint, id bigint, value int")
    return mesh.Mesh.build(vertex, element, eset=eset, member=member, link=link, tags={"t": tag})


def test_filters(spark, two_tris):
    m = two_tris
    assert rows(m.by_type("tri"), "id") == [(1,), (2,)]
    assert len(rows(m.by_dimension(0))) == 5 and len(rows(m.by_type("entityset"))) == 2
    t = m.tags["t"]
    assert rows(mesh.tag_filter(m.by_type("tri"), [{"tag": t, "value": 7, "default": 7}]), "id") == [(1,), (2,)]
    assert rows(mesh.tag_filter(m.by_type("tri"), [{"tag": t, "value": 7}]), "id") == [(1,)]
    assert rows(mesh.tag_filter(m.by_type("tri"), [{"tag": t, "value": 8, "default": 8}]), "id") == [(2,)]
    none = m.by_type("tri").limit(0)
    assert rows(mesh.tag_filter(m.by_type("tri"), [{"tag": t}], within=none)) == []
    assert rows(mesh.tag_values(m.by_type("tri"), t, -1), "id", "value") == [(1, 7), (2, -1)]
    assert mesh.contains(m.member, 100, m.by_type("tri"), "union").first()["held"] and not mesh.contains(m.member, 100, m.by_type("tri")).first()["held"]
    assert mesh.contains(m.member, 0, m.by_type("tri")).first()["held"]


def test_catalog():
    c = mesh.TagCatalog()
    with pytest.raises(KeyError):
        c.handle("a", kind="integer")
    d = c.handle("a", kind="integer", create=True, default=3)
    assert c.handle("a", kind="integer") is d
    for bad in ({"kind": "double"}, {"kind": "integer", "excl": True}, {"kind": "integer", "default": 4}, {"kind": "integer", "length": 2}, {"kind": "integer", "length": 0}):
        with pytest.raises(ValueError):
            c.handle("a", **bad)
    assert c.handle("a", kind="double", any_=True) is d


def test_handles(spark):
    df = spark.createDataFrame([(k, 2**40 + k) for k in range(12)], "etype tinyint, id bigint").select("*", T.pack_handle(F.col("etype"), F.col("id")).alias("h"))
    a, b = T.unpack_handle(F.col("h"))
    got = df.select("etype", "id", "h", a.alias("a"), b.alias("b")).orderBy("h").collect()
    assert [r["etype"] for r in got] == list(range(12)) and all((r["a"], r["b"]) == (r["etype"], r["id"]) and r["h"] >= 0 for r in got)


def test_cyclic_key_and_sense(spark):
    r = random.Random(1)
    cases = []
    for _ in range(200):
        n = r.randint(2, 6)
        a = r.sample(range(20), n)
        k = r.randrange(n)
        b = a[k:] + a[:k]
        how = r.choice((1, -1, 0))
        if how == -1:
            b = b[::-1]
        if how == 0:
            b = r.sample(a, n)
        ring = [tuple(a[j:] + a[:j]) for j in range(n)]
        same = tuple(b) in ring
        back = tuple(b[::-1]) in ring
        cases.append((a, b, same, back))
    got = spark.createDataFrame(cases, "a array<int>, b array<int>, same boolean, back boolean").select("*", (T.cyclic_key(F.col("a")) == T.cyclic_key(F.col("b"))).alias("eq"), T.sense(F.col("a"), F.col("b")).alias("s")).collect()
    for x in got:
        assert x["eq"] == (x["same"] or x["back"]), x
        if len(x["a"]) > 2:
            assert x["s"] == (1 if x["same"] else -1 if x["back"] else 0), x
        else:
            assert x["s"] == (1 if x["a"] == x["b"] else -1)


def test_adjacency(spark, two_tris):
    m = two_tris
    inc = m.incidence()
    pair = spark.createDataFrame([(1,), (3,)], "vid bigint")
    assert rows(adjacency.up(inc, pair), "id") == [(1,), (2,)]
    assert rows(adjacency.up(inc, spark.createDataFrame([(2,)], "vid bigint")), "id") == [(1,)]
    assert rows(adjacency.up(inc, pair.limit(0))) == []
    assert len(rows(adjacency.skin(m.element, 1))) == 4
    assert rows(adjacency.neighbours(m.element, 1), "a", "b") == [(1, 2), (2, 1)]
    assert dict(rows(adjacency.boundary_class(m.element, m.vertex, 10).groupBy("kind").count())) == {"boundary": 4, "inferred": 1}
    padded = spark.createDataFrame([(4, 1, [1, 2, 3, 3, 3])], mesh.ELEMENT)
    assert len(rows(adjacency.sides(padded, 1))) == 3


def test_sets(spark, two_tris):
    m = two_tris
    one = spark.createDataFrame([(100,)], "sid bigint")
    assert rows(sets.contents(m.member, one, recursive=True), "id") == [(1,), (2,)]
    assert rows(sets.contents(m.member, one), "etype", "id") == [(TRI, 1), (11, 101)]
    assert rows(sets.children(m.link, one, -1), "child", "hop") == [(100, 2), (101, 1)]
    assert rows(sets.parents(m.link, one, 1), "parent") == [(101,)]
    assert [r["id"] for r in sets.ordered_contents(m.member, 101).collect()] == [2, 2]
    tri = m.by_type("tri")
    assert rows(sets.add(m.member, m.eset, 100, tri).where("sid = 100"), "etype", "id") == [(TRI, 1), (TRI, 2), (11, 101)]
    assert rows(sets.add(m.member, m.eset, 101, tri).where("sid = 101"), "pos", "id") == [(0, 2), (1, 2), (2, 1), (3, 2)]
    assert rows(sets.remove(m.member, 101, tri).where("sid = 101")) == []
    swap = spark.createDataFrame([(TRI, 2, TRI, 1)], "etype tinyint, id bigint, new_etype tinyint, new_id bigint")
    assert rows(sets.swap(m.member, 101, swap).where("sid = 101"), "pos", "id") == [(0, 1), (1, 1)]
    assert rows(sets.convert(m.member, 101, False).where("sid = 101"), "id") == [(2,)]
    assert rows(sets.convert(m.member, 100, True).where("sid = 100"), "pos", "id") == [(0, 1), (1, 101)]
    assert sets.equal(tri, tri).first()["same"]


def test_edits(spark, two_tris):
    m = two_tris
    gone = dml.delete(m, spark.createDataFrame([(0, 4)], "etype tinyint, id bigint"))
    assert rows(gone.element, "id") == [(1,)] and rows(gone.member, "sid", "id") == [(100, 1), (100, 101)]
    assert rows(dml.check(m)) == []
    bad = mesh.Mesh.build(m.vertex.where("id <> 2"), m.element, member=m.member)
    assert ("no such vertex", TRI, 1) in rows(dml.check(bad))
    close = m.vertex.unionByName(spark.createDataFrame([(20, 0.0, 0.0, 1e-4), (21, 0.0, 0.0, 2e-4)], mesh.VERTEX))
    assert rows(dml.merge_close(close, 1.5e-4)) == [(20, 1), (21, 1)]
    doubled = mesh.Mesh.build(close, m.element.unionByName(spark.createDataFrame([(TRI, 3, [3, 2, 20])], mesh.ELEMENT)))
    merged = dml.apply_merge(doubled, dml.merge_close(close, 1.5e-4))
    assert rows(merged.element, "id") == [(1,), (2,)] and merged.vertex.count() == 5
    more = dml.create_elements(dml.create_vertices(m, spark.createDataFrame([(7.0, 7.0, 7.0)], "x double, y double, z double")), spark.createDataFrame([(TRI, [1, 2, 10])], "etype tinyint, conn array<bigint>"))
    assert rows(more.vertex.where("x = 7"), "id") == [(10,)] and rows(more.element.where("size(conn) = 3"), "id") == [(1,), (2,), (3,)]


def test_ordered(spark):
    d = spark.createDataFrame([(k * 3 % 101,) for k in range(101)], "id bigint")
    assert rows(ordered.dense_ids(d, ["id"], "g", 5)) == [(k, k + 5) for k in range(101)]
    assert [n for _, n in rows(ordered.slices(d, ["id"], 7).groupBy("part").count())] == [15, 15, 15, 14, 14, 14, 14]
    assert rows(ordered.slices(d.limit(0), ["id"], 7)) == []
    ids = [1, 2, 3, 7, 8, 9, 10, 11, 12, 40]
    for cell in (2, 4, 1000):
        assert rows(ordered.runs(spark.createDataFrame([(k,) for k in ids], "id bigint"), cell=cell)) == [(1, 3), (7, 12), (40, 40)]
    e = spark.createDataFrame([(1, 5, 2), (1, 6, 1), (1, 7, 0), (1, 8, 9)], "etype tinyint, id bigint, k int")
    assert rows(ordered.permutation(e, "k", 9), "old", "new") == [(5, 7), (6, 6), (7, 5)]


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        hi, lo = max(root(a), root(b)), min(root(a), root(b))
        parent[hi] = lo
    got = dict(rows(graph.components(spark.createDataFrame(edges, "u bigint, v bigint")), "node", "root"))
    assert got == {x: root(x) for x in parent if root(x) != x}


def test_spatial(spark):
    r = random.Random(5)
    pts = [(k, r.random(), r.random() * 2, r.random() - 3) for k in range(120)]
    df = spark.createDataFrame(pts, mesh.VERTEX)
    dist = lambda a, b: math.dist(a[1:], b[1:])
    want = sorted((a[0], b[0]) for a in pts for b in pts if dist(a, b) <= 0.2)
    assert rows(spatial.within_distance(df, df, 0.2), "a", "b") == want
    near = rows(spatial.nearest(df.where("id < 15"), df, 4), "a", "rank", "b")
    assert near == sorted((a[0], k, b[0]) for a in pts[:15] for k, b in enumerate(sorted(pts, key=lambda b: (dist(a, b), b[0]))[:4], 1))
    parts = dict(rows(spatial.rcb(df, 3).groupBy("part").count()))
    assert len(parts) == 8 and max(parts.values()) - min(parts.values()) <= 3
    boxes = spark.createDataFrame([(1, 0.0, 0.5, 0.0, 1.0, -3.0, -2.5), (2, 0.4, 0.6, 0.9, 1.1, -3.0, -2.0)], "id bigint, xmin double, xmax double, ymin double, ymax double, zmin double, zmax double")
    inside = lambda p, b: all(lo <= x <= hi for x, lo, hi in zip(p[1:], b[1::2], b[2::2]))
    assert rows(spatial.points_in_boxes(df, boxes), "point", "box") == sorted((p[0], b[0]) for p in pts for b in map(tuple, boxes.collect()) if inside(p, b))


def test_partition():
    for scheme in partition.SCHEMES:
        for n in (1, 2, 6, 8):
            box = (0, 0, 0, 10, 12, 14)
            cells = [(i, j, k) for b in partition.box_parts(box, n, scheme) for i in range(b[0], b[3]) for j in range(b[1], b[4]) for k in range(b[2], b[5])]
            assert len(cells) == len(set(cells)) == 10 * 12 * 14, scheme


def test_structured(spark):
    ring = structured.brick(spark, (0, 0, 0, 6, 1, 0), periodic=(True, False, False))
    assert ring.vertex.count() == 12 and ring.element.count() == 6
    assert adjacency.skin(ring.element, 1).count() == 12
    assert structured.box_skin(spark, (0, 0, 0, 3, 4, 5)).count() == 2 * (12 + 15 + 20)
    m = structured.three_points([(0, 0, 0), (3, 0, 0), (0, 2, 0)], [(5, 5, 5), (5, 8, 5), (5, 5, 7)])
    assert [sum(m[i][j] * p for j, p in enumerate((3, 2, 0, 1))) for i in range(3)] == [5, 8, 7]
    assert structured.compose(m, structured.three_points([(5, 5, 5), (5, 8, 5), (5, 5, 7)], [(0, 0, 0), (3, 0, 0), (0, 2, 0)])) == [[int(i == j) for j in range(4)] for i in range(4)]


@pytest.mark.parametrize(("name", "n"), [("tet", 2), ("tet", 3), ("hex", 3), ("quad", 5), ("edge", 5), ("tri", 2)])
def test_refinement(spark, name, n):
    box = {"edge": (0, 0, 0, 3, 0, 0), "tri": (0, 0, 0, 2, 2, 0), "quad": (0, 0, 0, 2, 3, 0), "hex": (0, 0, 0, 2, 1, 2)}.get(name)
    if name == "tet":
        vertex = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 0.0, 1.0, 0.0), (4, 0.0, 0.0, 1.0), (5, 1.0, 1.0, 1.0)], mesh.VERTEX)
        m = mesh.Mesh.build(vertex, spark.createDataFrame([(TET, 1, [1, 2, 3, 4]), (TET, 2, [2, 5, 3, 4])], mesh.ELEMENT))
    else:
        m = structured.brick(spark, box)
        m = dml.quads_to_tris(m) if name == "tri" else m
    fine, kids = refine.uniform(m, name, n)
    dim = T.DIM[name]
    assert {c for _, c in rows(kids.groupBy("parent").count())} == {n**dim}
    measure = {"edge": "length", "tri": "area", "quad": "area", "tet": "volume", "hex": "volume"}[name]
    size = lambda x: quality.measure(x.element, x.vertex, name, [measure]).agg(F.sum(measure), F.min(measure)).first()
    assert size(fine)[0] == pytest.approx(size(m)[0]) and size(fine)[1] > 0
    if dim > 1:
        assert adjacency.skin(fine.element, dim - 1).count() == adjacency.skin(m.element, dim - 1).count() * n ** (dim - 1)


def test_adaptive_and_cut(spark):
    m = dml.quads_to_tris(structured.brick(spark, (0, 0, 0, 3, 3, 0)))
    fine = refine.adaptive_tris(m, (F.col("ax") + F.col("bx")) / 2 < 1.1)
    area = quality.measure(fine.element, fine.vertex, "tri", ["area"]).agg(F.sum("area"), F.count("*")).first()
    assert area[0] == pytest.approx(9) and area[1] > 18
    assert adjacency.sides(fine.element, 1).groupBy("key").count().where("count > 2").count() == 0
    vertex = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 0.0, 1.0, 0.0), (4, 0.0, 0.0, 1.0)], mesh.VERTEX)
    hexes = refine.tets_to_hexes(mesh.Mesh.build(vertex, spark.createDataFrame([(TET, 1, [1, 2, 3, 4])], mesh.ELEMENT)))
    q = quality.measure(hexes.element, hexes.vertex, "hex", ["jacobian"]).collect()
    assert hexes.vertex.count() == 15 and len(q) == 4 and all(r["jacobian"] > 0 for r in q)


def test_depth_has_no_last_ring(spark):
    inc = spark.range(103).select(F.lit(T.CODE["edge"]).cast("tinyint").alias("etype"), "id", F.explode(F.array("id", F.col("id") + 1)).alias("vid")).coalesce(1)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = adjacency.depth_from(inc, spark.createDataFrame([(0,)], "vid bigint").coalesce(1))
        assert rows(got, "id", "depth") == [(k, k) for k in range(103)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_smoothing_goes_on_until_nothing_moves(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        vertex = spark.createDataFrame([(k, float(k), float(0 < k < 10), 0.0) for k in range(11)], mesh.VERTEX).coalesce(1)
        element = spark.createDataFrame([(T.CODE["edge"], k, [k, k + 1]) for k in range(10)], mesh.ELEMENT).coalesce(1)
        y = np.array([r[1] for r in rows(refine.smooth(mesh.Mesh.build(vertex, element), spark.createDataFrame([(0,), (10,)], "id bigint").coalesce(1), 0.007), "id", "y")])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert np.abs(y[:-2] - 2 * y[1:-1] + y[2:]).max() / 4 <= 0.007


def test_smoothing(spark):
    m = structured.brick(spark, (0, 0, 0, 4, 4, 0))
    edge = adjacency.skin_vertices(m.element, 1).select(F.col("vid").alias("id"))
    bent = mesh.Mesh.build(m.vertex.withColumn("x", F.when((F.col("x") == 2) & (F.col("y") == 2), 2.4).otherwise(F.col("x"))), m.element)
    got = refine.smooth(bent, edge, 1e-6, 80).where("x <> round(x, 3) OR abs(x - round(x)) > 0.01 OR abs(y - round(y)) > 0.01").count()
    assert got == 0 or refine.smooth(bent, edge, 1e-6, 80).agg(F.max(F.abs(F.col("x") - F.round("x")))).first()[0] < 0.02


def test_element_maps():
    r = np.random.default_rng(2)
    for name in ("quad", "hex"):
        s = elements.SIGNS[name]
        corners = np.concatenate([s, np.zeros((len(s), 3 - s.shape[1]))], 1)[None] + r.uniform(-0.2, 0.2, (50, len(s), 3)) * ([1, 1, 0] if name == "quad" else 1)
        xi = r.uniform(-0.95, 0.95, (50, s.shape[1]))
        got, inside = elements.invert(name, corners, elements.evaluate(name, xi, corners))
        assert np.allclose(got, xi, atol=1e-8) and inside.all()
        far = elements.evaluate(name, np.full((50, s.shape[1]), 1.5), corners)
        assert not elements.invert(name, corners, far)[1].any()
    cube = elements.SIGNS["hex"][None]
    assert elements.integrate("hex", cube, np.ones((1, 8)))[0] == pytest.approx(8)
    x, w = elements.lobatto(5)
    assert w.sum() == pytest.approx(2) and (w * x**6).sum() == pytest.approx(2 / 7)
    xi = r.uniform(-1, 1, (4, 2))
    field = np.array([[a**2 + 3 * b for b in x for a in x]] * 4)
    assert np.allclose(elements.spectral(x, xi, field), xi[:, 0] ** 2 + 3 * xi[:, 1])


def test_quality_of_regular_shapes(spark):
    h = math.sqrt(3) / 2
    vertex = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 0.5, h, 0.0), (4, 0.5, h / 3, math.sqrt(2 / 3))], mesh.VERTEX)
    e = spark.createDataFrame([(TRI, 1, [1, 2, 3]), (TET, 2, [1, 2, 3, 4])], mesh.ELEMENT)
    tri = quality.measure(e, vertex, "tri", average=math.sqrt(3) / 4).first().asDict()
    for k in ("edge_ratio", "aspect_ratio", "radius_ratio", "aspect_frobenius", "condition", "scaled_jacobian", "shape", "relative_size_squared", "shape_and_size", "distortion"):
        assert tri[k] == pytest.approx(1), k
    assert tri["minimum_angle"] == pytest.approx(60) and tri["maximum_angle"] == pytest.approx(60)
    tet = quality.measure(e, vertex, "tet", average=math.sqrt(2) / 12).first().asDict()
    for k in ("edge_ratio", "radius_ratio", "aspect_beta", "aspect_ratio", "aspect_frobenius", "condition", "scaled_jacobian", "shape", "relative_size_squared", "shape_and_size"):
        assert tet[k] == pytest.approx(1), k
    assert tet["aspect_gamma"] == pytest.approx(1, rel=1e-3) and tet["volume"] == pytest.approx(math.sqrt(2) / 12)
    assert tet["minimum_angle"] == pytest.approx(math.degrees(math.acos(1 / 3))) and tet["collapse_ratio"] == pytest.approx(math.sqrt(2 / 3))
    cube = structured.brick(spark, (0, 0, 0, 1, 1, 1))
    hx = quality.measure(cube.element, cube.vertex, "hex").first().asDict()
    for k in ("edge_ratio", "max_edge_ratio", "volume", "stretch", "diagonal", "med_aspect_frobenius", "max_aspect_frobenius", "condition", "jacobian", "scaled_jacobian", "shear", "shape", "relative_size_squared", "distortion"):
        assert hx[k] == pytest.approx(1), k
    assert hx["skew"] == pytest.approx(0) and hx["taper"] == pytest.approx(0) and hx["oddy"] == pytest.approx(0)
    flat = structured.brick(spark, (0, 0, 0, 1, 1, 0))
    qd = quality.measure(flat.element, flat.vertex, "quad").first().asDict()
    for k in ("edge_ratio", "max_edge_ratio", "aspect_ratio", "med_aspect_frobenius", "max_aspect_frobenius", "area", "stretch", "condition", "jacobian", "scaled_jacobian", "shear", "shape", "relative_size_squared", "distortion", "radius_ratio"):
        assert qd[k] == pytest.approx(1), k
    for k in ("skew", "taper", "warpage", "oddy"):
        assert qd[k] == pytest.approx(0), k
    corners = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0.5, 0.5, 1.5), (0, 0, 1), (1, 0, 1), (1, 1, 1)]
    w = spark.createDataFrame([(k + 1, *map(float, c)) for k, c in enumerate(corners)], mesh.VERTEX)
    solid = spark.createDataFrame([(T.CODE["pyramid"], 1, [1, 2, 3, 4, 5]), (T.CODE["prism"], 2, [1, 2, 4, 6, 7, 8])], mesh.ELEMENT)
    assert quality.measure(solid, w, "pyramid").first()["volume"] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        quality.measure(e, vertex, "tri", ["volume"])


def test_vectors(spark):
    r = random.Random(8)
    tri = [(0.0, 0.0, 0.0), (2.0, 0.0, 0.0), (0.0, 1.0, 0.5)]
    pts = [tuple(r.uniform(-2, 3) for _ in range(3)) for _ in range(100)]
    lit = lambda p: tuple(F.lit(x) for x in p)
    df = spark.createDataFrame(pts, "x double, y double, z double")
    p = (F.col("x"), F.col("y"), F.col("z"))
    got = df.select("x", "y", "z", v.closest_on_triangle(p, [lit(c) for c in tri]).alias("c"), v.box_overlaps_triangle(p, lit((0.3, 0.3, 0.3)), [lit(c) for c in tri]).alias("hit")).collect()
    a, b, c = map(np.array, tri)
    grid = np.array([a + i / 60 * (b - a) + j / 60 * (c - a) for i in range(61) for j in range(61 - i)])
    for q in got:
        at = np.array([q["x"], q["y"], q["z"]])
        best = np.linalg.norm(grid - at, axis=1).min()
        mine = np.linalg.norm(np.array([q["c"]["x"], q["c"]["y"], q["c"]["z"]]) - at)
        assert mine <= best + 1e-9 and mine >= best - 0.05
        if (np.abs(grid - at).max(axis=1) <= 0.3).any():
            assert q["hit"]
    m = [(2.0, 0.0, 1.0), (0.0, 3.0, 0.0), (1.0, 0.0, 1.0)]
    assert np.allclose(np.array(v.inverse(m)) @ np.array(m), np.eye(3))


def test_sphere(spark):
    x, y, z = (F.lit(1.0), F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.lit(1.0), F.lit(0.0)), (F.lit(0.0), F.lit(0.0), F.lit(1.0))
    one = spark.range(1).select(sphere.triangle_area(x, y, z).alias("a"), sphere.triangle_area_by_angles(x, y, z).alias("b"), sphere.great_circle(x, y).alias("d")).first()
    assert one["a"] == pytest.approx(math.pi / 2) and one["b"] == pytest.approx(math.pi / 2) and one["d"] == pytest.approx(math.pi / 2)
    r = random.Random(4)
    for _ in range(3):
        p = [r.gauss(0, 1) for _ in range(3)]
        n = math.dist(p, (0, 0, 0))
        vec = tuple(F.lit(c / n) for c in p)
        plane = spark.range(1).select(sphere.face_of(vec).alias("f")).first()["f"]
        back = sphere.from_gnomonic(*sphere.gnomonic(vec, plane), plane)
        got = spark.range(1).select(v.struct(back).alias("p")).first()["p"]
        assert [got["x"], got["y"], got["z"]] == pytest.approx([c / n for c in p])


def test_overlay_on_sphere(spark):
    from meshlark.operators import ordered as o

    def cube(n, turn):
        m = structured.brick(spark, (-n, -n, -n, n, n, n))
        s = o.dense_ids(adjacency.skin(m.element, 2).select(F.col("verts").alias("conn")), ["conn"], "id").select(F.lit(QUAD).cast("tinyint").alias("etype"), "id", "conn")
        c, d = math.cos(turn), math.sin(turn)
        at = m.vertex.select("id", (c * F.col("x") - d * F.col("y")).alias("x"), (d * F.col("x") + c * F.col("y")).alias("y"), "z")
        size = v.norm((F.col("x"), F.col("y"), F.col("z")))
        return s, at.where(size > 0).select("id", *[(F.col(k) / size).alias(k) for k in "xyz"])

    a, av = cube(1, 0.0)
    b, bv = cube(2, 0.3)
    over = overlay.intersect(a, av, b, bv, sphere=True)
    assert over.agg(F.sum("area")).first()[0] == pytest.approx(4 * math.pi, rel=1e-6)
    flat = overlay.remap(over, a.select("id", F.lit(3.0).alias("value")))
    assert {round(r["value"], 9) for r in flat.collect()} == {3.0}


def test_aggregates(spark):
    d = spark.createDataFrame([(1, 2, 3), (1, 5, -2), (2, 2, 0), (2, 9, 4)], "id bigint, part_id bigint, value int")
    want = {"sum": [1, 4], "prod": [-6, 0], "max": [3, 4], "min": [-2, 0], "land": [1, 0], "lor": [1, 1], "lxor": [0, 1]}
    for op, x in want.items():
        assert [round(y) for _, y in rows(aggregate.reduce_tags(d, op, ["id"]))] == x, op
    assert rows(aggregate.exchange_tags(d, ["id"]), "id", "part_id", "value") == [(1, 2, 3), (1, 5, 3), (2, 2, 0), (2, 9, 0)]


def test_topology_restored(spark):
    member = spark.createDataFrame([(1, 10), (2, 20), (2, 21), (3, 30)], "sid bigint, id bigint")
    dims = spark.createDataFrame([(1, 2), (2, 1), (3, 0)], "sid bigint, dim int")
    adjacent = spark.createDataFrame([(20, 10), (21, 10), (30, 21)], "id bigint, up_id bigint")
    assert rows(solids.restore_topology(member, dims, adjacent)) == [(1, 2), (2, 3)]
    sides = spark.createDataFrame([(5, 1, 2)], "surface bigint, forward bigint, reverse bigint")
    hits = spark.createDataFrame([(0, 5, 1), (1, 5, 2)], "ray bigint, surface bigint, volume bigint")
    assert rows(solids.next_volume(sides, hits), "ray", "next") == [(0, 2), (1, 1)]


def test_components_of_long_chains(spark):
    r = random.Random(8)
    ids = list(range(600))
    r.shuffle(ids)
    edges = list(zip(ids[:400], ids[1:400], strict=False)) + list(zip(ids[400:], ids[401:], strict=False)) + [(7_000 + k, 7_000) for k in range(50)]
    least = {x: min(part) for part in (ids[:400], ids[400:], range(7_000, 7_050)) for x in part}
    got = rows(graph.components(spark.createDataFrame(edges, "u bigint, v bigint")), "node", "root")
    assert got == sorted((x, m) for x, m in least.items() if x != m)
    assert rows(graph.components(spark.createDataFrame([], "u bigint, v bigint"))) == []


def test_checkpoints_forget_guessed_sizes(spark):
    from meshlark.checkpoints import persist

    size = lambda d: len(str(d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    d = persist(spark.range(5).withColumn("x", F.lit(1)))
    for _ in range(4):
        d = persist(d.join(d.select("id", F.col("x").alias("y")), "id").select("id", "x"))
    assert size(d) < 25 and rows(d) == [(k, 1) for k in range(5)]


def _soup(spark, tmp_path):
    """Random facets, and points in a small file that unfold to many listed rows."""
    r = random.Random(9)
    spots = [(s, k, *[c + r.uniform(-0.7, 0.7) for _ in range(3) for c in at]) for s in (1, 2) for k in range(30) for at in [[r.uniform(-4, 4) for _ in range(3)]]]
    tris = spark.createDataFrame(spots, "surface bigint, id bigint, " + ", ".join(f"{c}{k} double" for k in range(3) for c in "xyz"))
    pts = [(k, *[r.uniform(-6, 6) for _ in range(3)]) for k in range(200)]
    spark.createDataFrame(pts, mesh.VERTEX).write.parquet(f"{tmp_path}/p")
    return spots, tris, pts, spark.read.parquet(f"{tmp_path}/p")


def _reads_points_once(df):
    """Points are never the side that is broadcast."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "BuildLeft" not in plan


@pytest.mark.parametrize("few", [0, 200_000])
def test_closest_keeps_points_where_they_are(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(solids, "FEW", few, raising=False)
    spots, tris, pts, p = _soup(spark, tmp_path)
    got = solids.closest(p, tris, 1.0)
    assert _reads_points_once(got)
    every = spark.createDataFrame(pts, "point bigint, qx double, qy double, qz double").crossJoin(tris)
    q = tuple(F.col(f"q{c}") for c in "xyz")
    every = every.withColumn("w", v.closest_on_triangle(q, [tuple(F.col(f"{c}{k}") for c in "xyz") for k in range(3)]))
    best = {}
    for x in every.select("point", "surface", "id", v.norm(v.sub(v.at("w"), q)).alias("dist")).collect():
        if x["dist"] <= 1.0:
            best[x["point"]] = min(best.get(x["point"], (9.0,)), (x["dist"], x["surface"], x["id"]))
    assert len(best) > 20 and {x["point"]: (x["dist"], x["surface"], x["id"]) for x in got.collect()} == best


@pytest.mark.parametrize("few", [0, 200_000])
@pytest.mark.parametrize("way", [solids.DIRECTION, (1.0, 0.0, 0.0), (0.0, -0.6, 0.8)])
def test_rays_keep_points_where_they_are(spark, tmp_path, monkeypatch, few, way):
    monkeypatch.setattr(solids, "FEW", few, raising=False)
    _, tris, pts, p = _soup(spark, tmp_path)
    ray = lambda d, k: d.select(F.col(k).alias("ray"), *[F.col(c).alias(f"o{c}") for c in "xyz"], *[F.lit(x).alias(f"d{c}") for c, x in zip("xyz", way, strict=True)])
    got = solids.ray_hits(ray(p, "id"), tris, 0.8, 9.0)
    assert _reads_points_once(got)
    hit = v.ray_triangle(tuple(F.col(f"o{c}") for c in "xyz"), tuple(F.col(f"d{c}") for c in "xyz"), [tuple(F.col(f"{c}{k}") for c in "xyz") for k in range(3)])
    want = ray(spark.createDataFrame(pts, mesh.VERTEX), "id").crossJoin(tris).select("ray", "surface", "id", hit.alias("t")).where("t <= 9")
    assert rows(want) and rows(got, "ray", "surface", "id", "t") == rows(want)
    assert rows(solids.ray_hits(ray(p, "id"), tris.limit(0), 0.8, 9.0)) == []


def test_strings(spark):
    assert strings.id_list("1-3,7") == [1, 2, 3, 7]
    with pytest.raises(ValueError):
        strings.id_list("3-1")
    assert strings.percent("f%%_%.x", 3) == "f%_3.x"
    assert strings.literal("1,2", "integer") == [1, 2] and strings.literal("0x41", "opaque") == b"A" and strings.literal("101", "bit") == 5
    d = spark.createDataFrame([("mat_12_rho_1.0",), ("graveyard",), ("mat_7",)], "n string").select("n", strings.group_properties(F.col("n"), ["mat", "rho", "graveyard"]).alias("m"), strings.unpack(strings.append(strings.append(F.lit("a"), F.lit("b")), F.lit("a"))).alias("u"))
    got = {r["n"]: r["m"] for r in d.collect()}
    assert got == {"mat_12_rho_1.0": {"mat": "12", "rho": "1.0"}, "graveyard": {"graveyard": ""}, "mat_7": {"mat": "7"}}
    assert d.first()["u"] == ["a", "b"]


def test_tree_by_medians(spark):
    import random

    from meshlark.operators import trees

    r = random.Random(3)
    pts = [(k, r.random(), r.random() * 2, r.random()) for k in range(200)]
    nodes, leaves = trees.build(spark.createDataFrame(pts, "id long, x double, y double, z double"), 3)
    at = dict(rows(leaves, "id", "node"))
    boxes = {n["node"]: n for n in nodes.collect()}
    assert len(at) == 200 and sum(n["n"] for n in boxes.values() if n["level"] == 3) == 200 and boxes[1]["n"] == 200
    for k, x, y, z in pts:
        node = at[k]
        while node:
            b = boxes[node]
            assert b["xmin"] <= x <= b["xmax"] and b["ymin"] <= y <= b["ymax"] and b["zmin"] <= z <= b["zmax"]
            node //= 2
    rays = [(k, -1.0, r.random() * 2, r.random(), 1.0, r.uniform(-1, 1), 0.0) for k in range(30)]
    got = {(h["ray"], h["node"]): (h["enter"], h["leave"]) for h in trees.ray_leaves(nodes, spark.createDataFrame(rays, "ray long, ox double, oy double, oz double, dx double, dy double, dz double"), 3).collect()}
    want = {}
    for k, *od in rays:
        for n, b in boxes.items():
            lo, hi = 0.0, float("inf")
            for o, d, c in zip(od[:3], od[3:], "xyz", strict=True):
                if d:
                    s, e = sorted(((b[f"{c}min"] - o) / d, (b[f"{c}max"] - o) / d))
                    lo, hi = max(lo, s), min(hi, e)
                elif not b[f"{c}min"] <= o <= b[f"{c}max"]:
                    hi = -1.0
            if n >= 8 and lo <= hi:
                want[k, n] = (lo, hi)
    assert got.keys() == want.keys() and want
    for k, w in want.items():
        assert got[k] == pytest.approx(w)


def test_oriented_box_and_odd_edits(spark):
    from meshlark.operators import dml, spatial

    line = [(1, t * 3.0, t * 4.0, 0.1 * (t % 2)) for t in range(20)]
    b = aggregate.oriented_box(spark.createDataFrame(line, "g int, x double, y double, z double"), ["g"]).collect()[0]
    assert b["axes"][0] == pytest.approx([0.6, 0.8, 0.0], abs=1e-2) and b["half"][0] == pytest.approx(47.5, abs=1e-2)
    p = "id long, x double, y double, z double"
    far = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, float("nan"), 0.0, 0.0), (3, None, 0.0, 0.0), (4, 1e12, 0.0, 0.0)], p)
    assert rows(spatial.nearest(far, spark.createDataFrame([(9, 1.0, 0.0, 0.0), (8, float("inf"), 0.0, 0.0)], p)), "a", "b") == [(1, 9), (4, 9)]
    base = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], "id long, v int, w string")
    assert rows(dml.upsert(base, spark.createDataFrame([(2, 5, "x"), (2, 7, "c"), (3, 1, "d")], base.schema), ["id"])) == [(1, 1, "a"), (2, 7, "c"), (3, 1, "d")]
