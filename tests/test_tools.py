"""Command line, relations and one step of advection."""

import math

import pytest
from pyspark.sql import functions as F

from meshlark import __main__ as cli
from meshlark.operators import relations, structured
from meshlark.sources import registry


def test_command_line(spark, tmp_path, capsys):
    source = str(tmp_path / "in.vtk")
    registry.save(structured.brick(spark, (0, 0, 0, 3, 3, 3)), source)
    cli.main(["convert", source, str(tmp_path / "out.msh")])
    assert registry.load(spark, str(tmp_path / "out.msh")).element.count() == 27
    cli.main(["skin", source, str(tmp_path / "skin.vtk")])
    assert registry.load(spark, str(tmp_path / "skin.vtk")).element.count() == 54
    cli.main(["part", "4", source, str(tmp_path / "parts")])
    assert registry.tag_values(spark, str(tmp_path / "parts"), "PARALLEL_PARTITION") == [0, 1, 2, 3]
    cli.main(["refine", "2", source, str(tmp_path / "fine.vtk")])
    assert registry.load(spark, str(tmp_path / "fine.vtk")).element.count() == 216
    cli.main(["size", source])
    assert "rms" in capsys.readouterr().out


def test_relations(spark):
    a = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "id bigint, tag int")
    b = spark.createDataFrame([(10, 5), (11, 5), (12, None)], "id bigint, tag int")
    r = relations.infer(a, b, ["tag"])
    assert sorted(map(tuple, r.collect())) == [(1, 10), (1, 11)]
    assert sorted(map(tuple, relations.related(r, b, back=True).collect())) == [(10, 1), (11, 1)]


def test_advection_keeps_a_constant(spark):
    from meshlark.functions.topology import CODE
    from meshlark.operators import adjacency, ordered, overlay

    m = structured.brick(spark, (-2, -2, -2, 2, 2, 2))
    e = ordered.dense_ids(adjacency.skin(m.element, 2).select(F.col("verts").alias("conn")), ["conn"], "id").select(F.lit(CODE["quad"]).cast("tinyint").alias("etype"), "id", "conn")
    size = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    v = m.vertex.where(size > 0).select("id", *[(F.col(c) / size).alias(c) for c in "xyz"]).where(F.abs(F.col("z")) < 2)
    got = overlay.advect(e, v, e.select("id", F.lit(2.0).alias("value")), 0.0, 0.01).collect()
    assert len(got) == 96 and all(math.isclose(r["value"], 2.0, rel_tol=1e-9) for r in got)


def test_tolerance_groups(spark):
    d = spark.createDataFrame([(x,) for x in (0.0, 0.9, 1.8, 3.5, 999.6, 1000.3, 5000.0)], "v double")
    got = {r["v"]: r["group"] for r in relations.tolerance_groups(d, "v", 1.0).collect()}
    assert list(got[x] for x in sorted(got)) == [1, 1, 1, 2, 3, 3, 4]
    with pytest.raises(SystemExit):
        cli.main(["nothing"])


def test_polyhedra():
    import numpy as np

    from meshlark.functions import polyhedra as p

    r = np.random.default_rng(6)
    points = r.uniform(0, 1, (20_000, 3))
    for _ in range(20):
        faces = p.box(np.zeros(3), np.ones(3))
        planes = [(r.standard_normal(3), r.uniform(-0.6, 0.6)) for _ in range(3)]
        inside = np.ones(len(points), bool)
        for n, d in planes:
            faces = p.cut(faces, n, d)
            inside &= points @ n + d <= 0
        assert p.volume(faces) == pytest.approx(inside.mean(), abs=0.02)
        for q in points[:30]:
            assert p.contains(faces, q) == all(q @ n + d <= 0 for n, d in planes)
    whole = p.box(np.zeros(3), np.ones(3))
    assert p.volume(p.cut(whole, np.array([1.0, 0, 0]), -1.0)) == pytest.approx(1) and p.cut(whole, np.array([1.0, 0, 0]), 0.5) == []
