"""Formats by name and suffix, and the option string of readers and writers."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.mesh import ELEMENT, VERTEX, Mesh
from . import text_formats as tf


@dataclass(frozen=True)
class Format:
    name: str
    suffixes: tuple[str, ...]
    parse: Callable[[bytes], tf.Parsed] | None
    render: Callable[[tf.Parsed], bytes] | None
    note: str = ""


FORMATS: dict[str, Format] = {}


def register(fmt: Format) -> None:
    """Adds or replaces a format; the first that claims a suffix reads and writes it."""
    FORMATS[fmt.name] = fmt


for _f in (
    Format("VTK", ("vtk",), tf.parse_vtk, tf.render_vtk),
    Format("STL", ("stl",), tf.parse_stl, tf.render_stl),
    Format("SMF", ("smf",), tf.parse_smf, tf.render_smf),
    Format("GMSH", ("msh", "gmsh"), tf.parse_gmsh, tf.render_gmsh),
    Format("TETGEN", ("node", "ele"), tf.parse_tetgen, None),
    Format("NASTRAN", ("nas", "bdf"), tf.parse_nastran, None),
    Format("ABAQUS", ("inp", "abq"), tf.parse_abaqus, None),
    Format("IDEAS", ("unv",), tf.parse_ideas, None),
    Format("TXT", ("txt",), tf.parse_points, None),
    Format("GMV", ("gmv",), None, tf.render_gmv),
    Format("ANSYS", ("ans",), None, tf.render_ansys),
):
    register(_f)

#: Formats that need libraries which aren't at hand; the tables themselves go to Parquet instead.
UNAVAILABLE = {"h5m": "HDF5", "nc": "NetCDF", "exo": "NetCDF", "g": "NetCDF", "cgns": "CGNS", "ccm": "CCMIO", "cub": "a CAD kernel", "sat": "a CAD kernel", "stp": "a CAD kernel"}


def by_suffix(path: str) -> Format:
    suffix = path.rsplit(".", 1)[-1].lower()
    for f in FORMATS.values():
        if suffix in f.suffixes:
            return f
    if suffix in UNAVAILABLE:
        raise NotImplementedError(f"{suffix} needs {UNAVAILABLE[suffix]}; use Parquet tables")
    raise ValueError(f"no format for {path}")


class Options:
    """``KEY=value;FLAG`` with another separator if it starts with ``;`` and that; keys in any case, asked-for ones remembered."""

    def __init__(self, text: str = ""):
        sep = ";"
        if text.startswith(";") and len(text) > 1:
            sep, text = text[1], text[2:]
        self.items = [tuple(p.split("=", 1)) if "=" in p else (p, "") for p in text.split(sep) if p]
        self.seen: set[int] = set()

    def get(self, key: str) -> str | None:
        for k, (name, value) in enumerate(self.items):
            if name.lower() == key.lower():
                self.seen.add(k)
                return value
        return None

    def ints(self, key: str) -> list[int]:
        out = []
        for part in re.split(r"[,\s]+", self.get(key) or ""):
            if m := re.fullmatch(r"(-?\d+)-(-?\d+)", part):
                out += range(int(m[1]), int(m[2]) + 1)
            elif part:
                out.append(int(part))
        return out

    def reals(self, key: str) -> list[float]:
        return [float(p) for p in re.split(r"[,\s]+", self.get(key) or "") if p]

    def toggle(self, key: str, default: bool) -> bool:
        value = self.get(key)
        if value is None:
            return default
        word = value.lower()
        if word in ("", "1", "on", "yes", "true"):
            return True
        if word in ("0", "off", "no", "false"):
            return False
        raise ValueError(f"{key}: {value}")

    def match(self, key: str, allowed: list[str]) -> int:
        value = (self.get(key) or "").lower()
        return [a.lower() for a in allowed].index(value)

    def unseen(self) -> list[str]:
        return [name for k, (name, _) in enumerate(self.items) if k not in self.seen]


def load(spark: SparkSession, path: str, fmt: str | None = None, tag: str | None = None, values: list[int] | None = None) -> Mesh:
    """A mesh from one or many files of a format (globs and folders as Spark takes them), or from a folder of Parquet tables.

    Files are read by Spark, so any store it knows will do; each file is parsed by one task.  Ids are
    made distinct over files by file.  With a tag and values only elements that have them, and their vertices, stay.
    """
    if fmt == "PARQUET" or (fmt is None and "." not in path.rstrip("/").rsplit("/", 1)[-1]):
        mesh = read_tables(spark, path)
    else:
        f = FORMATS[fmt] if fmt else by_suffix(path)
        if f.parse is None:
            raise ValueError(f"{f.name} is write-only")
        mesh = _read(spark, path, f)
    if tag is not None:
        keep = mesh.tags[tag] if values is None else mesh.tags[tag].where(F.col("value").isin(values))
        e = mesh.element.join(keep.select("etype", "id"), ["etype", "id"], "left_semi")
        used = e.select(F.explode("conn").alias("id")).distinct()
        mesh = replace(mesh, element=e, vertex=mesh.vertex.join(used, "id", "left_semi"), tags={k: t.join(e.select("etype", "id"), ["etype", "id"], "left_semi") for k, t in mesh.tags.items()})
    return mesh


def _read(spark: SparkSession, path: str, f: Format) -> Mesh:
    import pandas as pd

    from ..checkpoints import persist
    from ..operators.ordered import dense_ids

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    order = dense_ids(files.select("path"), ["path"], "n", 0)
    parse = f.parse

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            for n, content in zip(b["n"], b["content"], strict=True):
                p = parse(bytes(content))
                base = int(n) << 40
                rows = [("v", 0, base + i, None, None, x, y, z, None) for i, (x, y, z) in enumerate(p.points, 1)]
                rows += [("e", t, base + i, [base + c + 1 for c in conn], None, None, None, None, None) for i, (t, conn) in enumerate(p.cells, 1)]
                for name, values in p.cell_tags.items():
                    rows += [("t", p.cells[i][0], base + i + 1, None, name, float(x), None, None, None) for i, x in values.items()]
                for name, values in p.point_tags.items():
                    rows += [("t", 0, base + i + 1, None, name, float(x), None, None, None) for i, x in values.items()]
                yield pd.DataFrame(rows, columns=["kind", "etype", "id", "conn", "name", "x", "y", "z", "pad"]).drop(columns="pad")

    raw = persist(files.join(order, "path").select("n", "content").mapInPandas(run, "kind string, etype tinyint, id bigint, conn array<bigint>, name string, x double, y double, z double"))
    names = [r["name"] for r in raw.where("kind = 't'").select("name").distinct().collect()]
    tags = {n: raw.where((F.col("kind") == "t") & (F.col("name") == n)).select("etype", "id", F.col("x").alias("value")) for n in sorted(names)}
    return Mesh.build(raw.where("kind = 'v'").select("id", "x", "y", "z"), raw.where("kind = 'e'").select("etype", "id", "conn"), tags=tags)


def save(mesh: Mesh, path: str, fmt: str | None = None) -> None:
    """Parquet tables into a folder; other formats are one file, so the mesh must fit the driver: exports of at most ``LIMIT`` entities."""
    if fmt == "PARQUET" or (fmt is None and "." not in path.rstrip("/").rsplit("/", 1)[-1]):
        write_tables(mesh, path)
        return
    f = FORMATS[fmt] if fmt else by_suffix(path)
    if f.render is None:
        raise ValueError(f"{f.name} is read-only")
    n = mesh.vertex.count() + mesh.element.count()
    if n > LIMIT:
        raise ValueError(f"{n} entities are too many for one file; save Parquet tables")
    rows = mesh.vertex.orderBy("id").collect()
    ids = {r["id"]: k for k, r in enumerate(rows)}
    cells = mesh.element.orderBy("etype", "id").collect()
    place = {(r["etype"], r["id"]): k for k, r in enumerate(cells)}
    tags = {name: {place[r["etype"], r["id"]]: r["value"] for r in t.collect() if (r["etype"], r["id"]) in place} for name, t in mesh.tags.items()}
    parsed = tf.Parsed([(r["x"], r["y"], r["z"]) for r in rows], [(r["etype"], [ids[v] for v in r["conn"]]) for r in cells], {k: v for k, v in tags.items() if v}, {})
    spark = mesh.vertex.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs  # noqa: SLF001
    target = hadoop.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)  # noqa: SLF001
    out.write(bytearray(f.render(parsed)))
    out.close()


#: Entities that an export to one file may have.
LIMIT = 5_000_000


def write_tables(mesh: Mesh, path: str) -> None:
    """The native form: one Parquet table each, sorted by id within files, so row groups can be skipped."""
    mesh.vertex.sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/vertex")
    mesh.element.sortWithinPartitions("etype", "id").write.mode("overwrite").parquet(f"{path}/element")
    for name in ("eset", "member", "link"):
        getattr(mesh, name).write.mode("overwrite").parquet(f"{path}/{name}")
    names = sorted(mesh.tags)
    mesh.vertex.sparkSession.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/tag_names")
    for n in names:
        mesh.tags[n].write.mode("overwrite").parquet(f"{path}/tag_{n}")


def read_tables(spark: SparkSession, path: str) -> Mesh:
    names = [r["name"] for r in spark.read.parquet(f"{path}/tag_names").collect()]
    read = lambda n: spark.read.parquet(f"{path}/{n}")
    return Mesh.build(read("vertex").select(*[c.split()[0] for c in VERTEX.split(", ")]), read("element").select(*[c.split()[0] for c in ELEMENT.split(", ")]), eset=read("eset"), member=read("member"), link=read("link"), tags={n: read(f"tag_{n}") for n in names})


def tag_values(spark: SparkSession, path: str, name: str) -> list[int]:
    """Distinct integer values of a tag in saved tables, reading that column alone."""
    return sorted(int(r["value"]) for r in spark.read.parquet(f"{path}/tag_{name}").select("value").distinct().collect())
