"""Text formats, the registry, options and the native tables."""

import struct

import pytest

from meshlark.functions.topology import CODE
from meshlark.operators import structured
from meshlark.sources import registry
from meshlark.sources import text_formats as tf

VTK = b"""# vtk DataFile Version 3.0
two cells
ASCII
DATASET UNSTRUCTURED_GRID
POINTS 5 double
0 0 0 1 0 0
1 1 0 0 1 0 0.5 0.5 1
CELLS 2 9
4 0 1 2 3
3 0 1 4
CELL_TYPES 2
9
5
CELL_DATA 2
SCALARS block int 1
LOOKUP_TABLE default
4
5
"""


def test_vtk():
    p = tf.parse_vtk(VTK)
    assert p.cells == [(CODE["quad"], [0, 1, 2, 3]), (CODE["tri"], [0, 1, 4])] and p.cell_tags == {"block": {0: 4, 1: 5}}
    again = tf.parse_vtk(tf.render_vtk(p))
    assert again.points == p.points and again.cells == p.cells and again.cell_tags == {"block": {0: 4.0, 1: 5.0}}
    grid = tf.parse_vtk(b"# v\nt\nASCII\nDATASET STRUCTURED_POINTS\nDIMENSIONS 3 2 2\nORIGIN 1 0 0\nSPACING 2 1 1\n")
    assert len(grid.points) == 12 and grid.points[1] == (3.0, 0.0, 0.0) and grid.cells[1] == (CODE["hex"], [1, 2, 5, 4, 7, 8, 11, 10])
    head = b"# v\nt\nBINARY\nDATASET POLYDATA\nPOINTS 3 float\n" + struct.pack(">9f", *range(9)) + b"\nPOLYGONS 1 4\n" + struct.pack(">4i", 3, 0, 1, 2) + b"\n"
    assert tf.parse_vtk(head).cells == [(CODE["tri"], [0, 1, 2])]


def test_stl():
    p = tf.Parsed([(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (1.0, 1.0, 0.0)], [(CODE["tri"], [0, 1, 2]), (CODE["tri"], [1, 3, 2])])
    again = tf.parse_stl(tf.render_stl(p))
    assert again.points == p.points and again.cells == p.cells
    for order in "<>":
        raw = b"x" * 80 + struct.pack(f"{order}I", 2)
        for _, c in p.cells:
            raw += struct.pack(f"{order}12f", 0, 0, 1, *(x for k in c for x in p.points[k])) + b"\0\0"
        assert tf.parse_stl(raw).cells == p.cells
    two = tf.parse_stl(b"solid a\nfacet\nvertex 0 0 0\nvertex -0.0 0 0\nvertex 1 0 0\nendfacet\nendsolid")
    assert len(two.points) == 3
    with pytest.raises(ValueError):
        tf.parse_stl(b"y" * 100)


def test_smf():
    p = tf.parse_smf(b"v 0 0 0\nv 1 0 0\nv 0 1 0\nf 1 2 3\nbegin\ntrans 1 2 3\nscale 2 2 2\nv 1 1 1\nv 2 2 2\nv 3 3 3\nf 1 2 3\nend\nf 1 2 6\n")
    assert p.points[3] == (3.0, 4.0, 5.0) and [c for _, c in p.cells] == [[0, 1, 2], [3, 4, 5], [0, 1, 5]]
    assert tf.parse_smf(tf.render_smf(p)).points == p.points


def test_gmsh():
    two = b"$MeshFormat\n2.2 0 8\n$EndMeshFormat\n$Nodes\n3\n10 0 0 0\n20 1 0 0\n30 0 1 0\n$EndNodes\n$Elements\n2\n1 15 2 0 1 10\n2 2 2 7 8 10 20 30\n$EndElements\n"
    p = tf.parse_gmsh(two)
    assert p.cells == [(CODE["tri"], [0, 1, 2])] and p.cell_tags == {"physical": {0: 7}, "geometric": {0: 8}}
    one = b"$NOD\n3\n1 0 0 0\n2 1 0 0\n3 0 1 0\n$ENDNOD\n$ELM\n1\n1 2 7 8 3 1 2 3\n$ENDELM\n"
    assert tf.parse_gmsh(one).cells == p.cells and tf.parse_gmsh(one).cell_tags == p.cell_tags
    assert tf.parse_gmsh(tf.render_gmsh(p)).cell_tags == p.cell_tags


def test_other_readers():
    p = tf.parse_tetgen(b"4 3 0 0\n1 0 0 0\n2 1 0 0\n3 0 1 0\n4 0 0 1\n---\n1 4 1\n1 1 2 3 4 9\n")
    assert p.cells == [(CODE["tet"], [0, 1, 2, 3])] and p.cell_tags == {"region": {0: 9.0}}
    small = b"GRID    " + b"%8d%8s%8s%8s%8s" % (2, b"", b"1.", b"0.", b"0.")
    large = b"GRID*   " + b"%16d%16s%16s%16s" % (3, b"", b"0.", b"1.0+0") + b"\n*       " + b"%16s" % b"0."
    n = tf.parse_nastran(b"$ c\nGRID,1,,0.,0.,0.\n" + small + b"\n" + large + b"\nCTRIA3,7,5,1,2,3\n")
    assert n.points == [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)] and n.cells == [(CODE["tri"], [0, 1, 2])] and n.cell_tags == {"property": {0: 5.0}}
    a = tf.parse_abaqus(b"*HEADING\nx\n** c\n*NODE\n1, 0, 0, 0\n2, 1, 0, 0\n3, 0, 1\n*ELEMENT, TYPE=S3, ELSET=skin\n1, 1, 2, 3\n")
    assert a.cells == [(CODE["tri"], [0, 1, 2])] and a.cell_tags == {"elset": {0: 1}}
    u = tf.parse_ideas(b"    -1\n  2411\n 1 1 1 1\n 0.0D+00 0.0 0.0\n 2 1 1 1\n 1.0 0.0 0.0\n 3 1 1 1\n 0.0 1.0 0.0\n    -1\n    -1\n  2412\n 1 91 1 1 7 3\n 1 2 3\n    -1\n")
    assert u.cells == [(CODE["tri"], [0, 1, 2])] and u.points[1] == (1.0, 0.0, 0.0)
    assert tf.parse_points(b"1 2 3\n\n4,5,6\n").points == [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]
    assert tf.render_gmv(p).startswith(b"gmvinput") and b"EN,1,1,2,3,4" in tf.render_ansys(p)


def test_options():
    o = registry.Options("TAG=x;LIST=1-3,9;ON;OFF=no;F=1.5 2")
    assert o.get("tag") == "x" and o.ints("list") == [1, 2, 3, 9] and o.reals("F") == [1.5, 2.0]
    assert o.toggle("ON", False) and not o.toggle("OFF", True) and o.toggle("gone", True)
    assert o.unseen() == []
    p = registry.Options(";+a=1;2+b")
    assert p.get("a") == "1;2" and p.unseen() == ["b"] and registry.Options("k=Two").match("k", ["one", "two"]) == 1
    with pytest.raises(ValueError):
        registry.Options("x=maybe").toggle("x", True)


def test_load_and_save(spark, tmp_path):
    (tmp_path / "a.vtk").write_bytes(VTK)
    (tmp_path / "b.vtk").write_bytes(VTK)
    m = registry.load(spark, str(tmp_path / "*.vtk"))
    assert m.vertex.count() == 10 and m.element.count() == 4 and m.tags["block"].count() == 4
    part = registry.load(spark, str(tmp_path / "a.vtk"), tag="block", values=[5])
    assert part.element.count() == 1 and part.vertex.count() == 3
    registry.save(m, str(tmp_path / "tables"))
    again = registry.load(spark, str(tmp_path / "tables"))
    assert again.element.count() == 4 and registry.tag_values(spark, str(tmp_path / "tables"), "block") == [4, 5]
    brick = structured.brick(spark, (0, 0, 0, 2, 2, 2))
    for name in ("x.vtk", "x.msh"):
        registry.save(brick, str(tmp_path / name))
        back = registry.load(spark, str(tmp_path / name))
        assert back.vertex.count() == 27 and back.element.count() == 8
    with pytest.raises(NotImplementedError):
        registry.load(spark, str(tmp_path / "x.h5m"))
    with pytest.raises(ValueError):
        registry.save(brick, str(tmp_path / "x.nas"))


def test_stream(spark, tmp_path):
    from meshlark.streaming import events

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    q = events.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["start"], r["event_type"]): r["n"] for r in events.windowed(src).collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(want) - len(got) <= 24
