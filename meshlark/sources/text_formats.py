"""Parsers and writers of mesh text formats; each takes or gives a file's bytes."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

from ..functions.topology import CODE


@dataclass
class Parsed:
    """Points, cells (type code, point indices from 0), and tags by name: index to value."""

    points: list[tuple[float, float, float]] = field(default_factory=list)
    cells: list[tuple[int, list[int]]] = field(default_factory=list)
    cell_tags: dict[str, dict[int, float]] = field(default_factory=dict)
    point_tags: dict[str, dict[int, float]] = field(default_factory=dict)


# Cell type numbers of the formats.
VTK_TYPES = {3: "edge", 4: "edge", 5: "tri", 7: "polygon", 9: "quad", 10: "tet", 12: "hex", 13: "prism", 14: "pyramid", 21: "edge", 22: "tri", 23: "quad", 24: "tet", 25: "hex"}
VTK_OUT = {"edge": 3, "tri": 5, "polygon": 7, "quad": 9, "tet": 10, "hex": 12, "prism": 13, "pyramid": 14}
GMSH_TYPES = {1: ("edge", 2), 2: ("tri", 3), 3: ("quad", 4), 4: ("tet", 4), 5: ("hex", 8), 6: ("prism", 6), 7: ("pyramid", 5), 8: ("edge", 3), 9: ("tri", 6), 11: ("tet", 10), 15: ("vertex", 1)}
NASTRAN_TYPES = {"CBAR": ("edge", 2), "CROD": ("edge", 2), "CTRIA3": ("tri", 3), "CQUAD4": ("quad", 4), "CTETRA": ("tet", 4), "CPENTA": ("prism", 6), "CHEXA": ("hex", 8), "CPYRAM": ("pyramid", 5)}
ABAQUS_TYPES = {"T3D2": ("edge", 2), "B31": ("edge", 2), "S3": ("tri", 3), "CPS3": ("tri", 3), "S4": ("quad", 4), "S4R": ("quad", 4), "CPS4": ("quad", 4), "C3D4": ("tet", 4), "C3D6": ("prism", 6), "C3D8": ("hex", 8), "C3D8R": ("hex", 8), "C3D10": ("tet", 10)}
IDEAS_TYPES = {11: ("edge", 2), 21: ("edge", 2), 41: ("tri", 3), 91: ("tri", 3), 44: ("quad", 4), 94: ("quad", 4), 111: ("tet", 4), 112: ("prism", 6), 115: ("hex", 8)}


def parse_vtk(raw: bytes) -> Parsed:
    """Legacy ASCII or binary files: unstructured grids, polygons, structured points and grids, rectilinear grids; scalar attributes."""
    head, _, body = raw.partition(b"\n")
    _, _, body = body.partition(b"\n")
    kind, _, body = body.partition(b"\n")
    reader = _VtkReader(body, kind.strip().upper() == b"BINARY")
    p = Parsed()
    dims = origin = spacing = None
    axes: dict[str, list[float]] = {}
    what, count = "", 0
    while (word := reader.word()) is not None:
        key = word.upper()
        if key == "DATASET":
            reader.word()
        elif key == "DIMENSIONS":
            dims = [int(reader.word()) for _ in range(3)]
        elif key == "ORIGIN":
            origin = [float(reader.word()) for _ in range(3)]
        elif key in ("SPACING", "ASPECT_RATIO"):
            spacing = [float(reader.word()) for _ in range(3)]
        elif key.endswith("_COORDINATES"):
            n, dtype = int(reader.word()), reader.word()
            axes[key[0]] = reader.numbers(n, dtype)
        elif key == "POINTS":
            n, dtype = int(reader.word()), reader.word()
            v = reader.numbers(3 * n, dtype)
            p.points = [tuple(map(float, v[k : k + 3])) for k in range(0, 3 * n, 3)]
        elif key in ("CELLS", "POLYGONS", "LINES", "VERTICES", "TRIANGLE_STRIPS"):
            n, size = int(reader.word()), int(reader.word())
            v, k, rows = reader.numbers(size, "int"), 0, []
            for _ in range(n):
                rows.append([int(x) for x in v[k + 1 : k + 1 + int(v[k])]])
                k += 1 + int(v[k])
            if key == "CELLS":
                pending = rows
            elif key == "POLYGONS":
                p.cells += [(CODE[{3: "tri", 4: "quad"}.get(len(c), "polygon")], c) for c in rows]
            elif key == "LINES":
                p.cells += [(CODE["edge"], [a, b]) for c in rows for a, b in zip(c, c[1:], strict=False)]
            elif key == "TRIANGLE_STRIPS":
                p.cells += [(CODE["tri"], [c[k + k % 2], c[k + 1 - k % 2], c[k + 2]]) for c in rows for k in range(len(c) - 2)]
        elif key == "CELL_TYPES":
            types = reader.numbers(int(reader.word()), "int")
            for t, c in zip(types, pending, strict=True):
                if int(t) == 11:  # a voxel lists its corners along the axes
                    p.cells.append((CODE["hex"], [c[k] for k in (0, 1, 3, 2, 4, 5, 7, 6)]))
                elif int(t) == 8:
                    p.cells.append((CODE["quad"], [c[k] for k in (0, 1, 3, 2)]))
                elif int(t) in VTK_TYPES:
                    p.cells.append((CODE[VTK_TYPES[int(t)]], c))
                elif int(t) != 1:
                    raise ValueError(f"no such cell type: {t}")
        elif key in ("CELL_DATA", "POINT_DATA"):
            what, count = key, int(reader.word())
        elif key == "SCALARS":
            name, dtype = reader.word(), reader.word()
            parts = int(reader.word()) if reader.peek().isdigit() else 1
            if reader.peek().upper() == "LOOKUP_TABLE":
                reader.word(), reader.word()
            v = reader.numbers(count * parts, dtype)
            store = p.cell_tags if what == "CELL_DATA" else p.point_tags
            for c in range(parts):
                store[name if parts == 1 else f"{name}_{c}"] = {k: v[k * parts + c] for k in range(count)}
        elif key in ("VECTORS", "NORMALS"):
            name, dtype = reader.word(), reader.word()
            v = reader.numbers(3 * count, dtype)
            store = p.cell_tags if what == "CELL_DATA" else p.point_tags
            for c in range(3):
                store[f"{name}_{c}"] = {k: v[3 * k + c] for k in range(count)}
        elif key == "FIELD":
            reader.word()
            for _ in range(int(reader.word())):
                name, parts, n, dtype = reader.word(), int(reader.word()), int(reader.word()), reader.word()
                v = reader.numbers(parts * n, dtype)
                store = p.cell_tags if what == "CELL_DATA" else p.point_tags
                for c in range(parts):
                    store[name if parts == 1 else f"{name}_{c}"] = {k: v[k * parts + c] for k in range(n)}
    if dims:
        _grid(p, dims, axes, origin, spacing)
    return p


class _VtkReader:
    def __init__(self, body: bytes, binary: bool):
        self.body, self.binary, self.at = body, binary, 0

    def word(self) -> str | None:
        m = re.compile(rb"\s*(\S+)").match(self.body, self.at)
        if not m:
            return None
        self.at = m.end()
        return m[1].decode("latin-1")

    def peek(self) -> str:
        at = self.at
        w = self.word() or ""
        self.at = at
        return w

    def numbers(self, n: int, dtype: str) -> list[float]:
        dtype = dtype.lower()
        whole = dtype not in ("float", "double")
        if not self.binary:
            out = []
            for _ in range(n):
                w = self.word()
                out.append(int(w) if whole else float(w))
            return out
        code = {"float": "f", "double": "d", "int": "i", "long": "q", "char": "b", "unsigned_char": "B", "short": "h", "unsigned_short": "H", "unsigned_int": "I", "unsigned_long": "Q"}[dtype]
        self.at = self.body.index(b"\n", self.at) + 1
        size = struct.calcsize(code) * n
        out = list(struct.unpack(f">{n}{code}", self.body[self.at : self.at + size]))
        self.at += size
        return out


def _grid(p: Parsed, dims: list[int], axes: dict, origin: list[float] | None, spacing: list[float] | None) -> None:
    if not p.points:
        if not axes:
            o, s = origin or [0, 0, 0], spacing or [1, 1, 1]
            axes = {a: [o[k] + s[k] * i for i in range(dims[k])] for k, a in enumerate("XYZ")}
        p.points = [(x, y, z) for z in axes["Z"] for y in axes["Y"] for x in axes["X"]]
    n = [max(1, d - 1) for d in dims]
    live = [d > 1 for d in dims]
    step = (1, dims[0], dims[0] * dims[1])
    use = [step[k] for k in range(3) if live[k]]
    for k in range(n[2]):
        for j in range(n[1]):
            for i in range(n[0]):
                c = i + j * step[1] + k * step[2]
                if len(use) == 3:
                    ring = [c, c + use[0], c + use[0] + use[1], c + use[1]]
                    p.cells.append((CODE["hex"], ring + [x + use[2] for x in ring]))
                elif len(use) == 2:
                    p.cells.append((CODE["quad"], [c, c + use[0], c + use[0] + use[1], c + use[1]]))
                elif use:
                    p.cells.append((CODE["edge"], [c, c + use[0]]))


NAMES = {code: name for name, code in CODE.items()}


def render_vtk(p: Parsed) -> bytes:
    cells = [(t, c) for t, c in p.cells if NAMES[t] in VTK_OUT]
    out = ["# vtk DataFile Version 3.0", "mesh", "ASCII", "DATASET UNSTRUCTURED_GRID", f"POINTS {len(p.points)} double"]
    out += [" ".join(map(repr, q)) for q in p.points]
    out += [f"CELLS {len(cells)} {sum(len(c) + 1 for _, c in cells)}"]
    out += [" ".join(map(str, [len(c), *c])) for _, c in cells]
    out += [f"CELL_TYPES {len(cells)}", *[str(VTK_OUT[NAMES[t]]) for t, _ in cells]]
    if p.cell_tags:
        out.append(f"CELL_DATA {len(cells)}")
        for name, values in p.cell_tags.items():
            out += [f"SCALARS {name} double 1", "LOOKUP_TABLE default", *[repr(float(values.get(k, -1))) for k in range(len(cells))]]
    return ("\n".join(out) + "\n").encode()


def parse_stl(raw: bytes) -> Parsed:
    """ASCII or binary in either byte order; vertices with the same bits are one."""
    p, seen = Parsed(), {}

    def point(xyz: tuple[float, ...]) -> int:
        key = struct.pack("<3d", *xyz)
        if key not in seen:
            seen[key] = len(p.points)
            p.points.append(tuple(map(float, xyz)))
        return seen[key]

    if raw.lstrip()[:5].lower() == b"solid" and b"facet" in raw[:2000]:
        v = [tuple(map(float, m.split()[1:4])) for m in re.findall(rb"vertex[^\n\r]*", raw)]
    else:
        for order in "<>":
            (n,) = struct.unpack(f"{order}I", raw[80:84])
            if len(raw) == 84 + 50 * n:
                break
        else:
            raise ValueError("not an STL file")
        v = []
        for k in range(n):
            f = struct.unpack(f"{order}12f", raw[84 + 50 * k : 132 + 50 * k])
            v += [f[3:6], f[6:9], f[9:12]]
    for k in range(0, len(v) - 2, 3):
        p.cells.append((CODE["tri"], [point(x) for x in v[k : k + 3]]))
    return p


def render_stl(p: Parsed) -> bytes:
    out = ["solid mesh"]
    for t, c in p.cells:
        if t != CODE["tri"]:
            continue
        a, b, d = (p.points[k] for k in c)
        u, w = [y - x for x, y in zip(a, b, strict=True)], [y - x for x, y in zip(a, d, strict=True)]
        n = (u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0])
        size = sum(x * x for x in n) ** 0.5 or 1.0
        out += ["facet normal " + " ".join(repr(x / size) for x in n), "outer loop", *["vertex " + " ".join(map(repr, q)) for q in (a, b, d)], "endloop", "endfacet"]
    return ("\n".join([*out, "endsolid mesh"]) + "\n").encode()


def parse_smf(raw: bytes) -> Parsed:
    """``v`` and ``f`` lines; ``begin``/``end`` scope ``trans`` and ``scale``, and vertex numbers count from the scope's first."""
    p, stack = Parsed(), [((1.0, 1.0, 1.0), (0.0, 0.0, 0.0), 0)]
    for line in raw.decode("latin-1").splitlines():
        w = line.split()
        if not w or w[0].startswith("#"):
            continue
        s, o, base = stack[-1]
        if w[0] == "v":
            p.points.append(tuple(float(x) * k + d for x, k, d in zip(w[1:4], s, o, strict=True)))
        elif w[0] in ("f", "t"):
            ids = [int(x.split("/")[0]) for x in w[1:]]
            conn = [base + i - 1 if i > 0 else len(p.points) + i for i in ids]
            p.cells.append((CODE[{3: "tri", 4: "quad"}.get(len(conn), "polygon")], conn))
        elif w[0] == "begin":
            stack.append((s, o, len(p.points)))
        elif w[0] == "end":
            stack.pop()
        elif w[0] == "trans":
            stack[-1] = (s, tuple(d + k * float(x) for x, k, d in zip(w[1:4], s, o, strict=True)), base)
        elif w[0] == "scale":
            stack[-1] = (tuple(k * float(x) for x, k in zip(w[1:4], s, strict=True)), o, base)
    return p


def render_smf(p: Parsed) -> bytes:
    out = [f"v {' '.join(map(repr, q))}" for q in p.points]
    out += [f"f {' '.join(str(k + 1) for k in c)}" for t, c in p.cells if t in (CODE["tri"], CODE["quad"], CODE["polygon"])]
    return ("\n".join(out) + "\n").encode()


def parse_gmsh(raw: bytes) -> Parsed:
    """Versions 1 and 2 in ASCII; physical and geometric ids become tags."""
    lines = [x.strip() for x in raw.decode("latin-1").splitlines()]
    p, ids, k = Parsed(), {}, 0
    while k < len(lines):
        head = lines[k].upper()
        k += 1
        if head in ("$NOD", "$NODES"):
            n = int(lines[k])
            for row in lines[k + 1 : k + 1 + n]:
                w = row.split()
                ids[int(w[0])] = len(p.points)
                p.points.append(tuple(map(float, w[1:4])))
            k += n + 1
        elif head in ("$ELM", "$ELEMENTS"):
            n = int(lines[k])
            for row in lines[k + 1 : k + 1 + n]:
                w = list(map(int, row.split()))
                if head == "$ELM":
                    labels, conn = w[2:4], w[5:]
                else:
                    labels, conn = w[3 : 3 + w[2]], w[3 + w[2] :]
                name, size = GMSH_TYPES[w[1]]
                if name == "vertex":
                    continue
                for tag, value in zip(("physical", "geometric"), labels, strict=False):
                    p.cell_tags.setdefault(tag, {})[len(p.cells)] = value
                p.cells.append((CODE[name], [ids[c] for c in conn[:size]]))
            k += n + 1
    return p


def render_gmsh(p: Parsed) -> bytes:
    code = {name: k for k, (name, _) in reversed(GMSH_TYPES.items())}
    out = ["$MeshFormat", "2.2 0 8", "$EndMeshFormat", "$Nodes", str(len(p.points)), *[f"{k} {' '.join(map(repr, q))}" for k, q in enumerate(p.points, 1)], "$EndNodes"]
    rows = [(k, code[NAMES[t]], c) for k, (t, c) in enumerate(p.cells) if NAMES[t] in code]
    label = lambda k, tag: int(p.cell_tags.get(tag, {}).get(k, 0))
    out += ["$Elements", str(len(rows)), *[f"{n} {t} 2 {label(k, 'physical')} {label(k, 'geometric')} {' '.join(str(x + 1) for x in c)}" for n, (k, t, c) in enumerate(rows, 1)], "$EndElements"]
    return ("\n".join(out) + "\n").encode()


def parse_tetgen(raw: bytes) -> Parsed:
    """A .node file, or .node and .ele joined by a line ``---``; numbering starts at the first node's."""
    p = Parsed()
    nodes, _, elements = raw.decode("latin-1").partition("\n---\n")
    rows = [r.split("#")[0].split() for r in nodes.splitlines() if r.split("#")[0].strip()]
    first = int(rows[1][0]) if len(rows) > 1 else 0
    p.points = [tuple((*map(float, r[1 : 1 + int(rows[0][1])]), 0.0)[:3]) for r in rows[1 : 1 + int(rows[0][0])]]
    rows = [r.split("#")[0].split() for r in elements.splitlines() if r.split("#")[0].strip()]
    if rows:
        size, extra = int(rows[0][1]), int(rows[0][2]) if len(rows[0]) > 2 else 0
        for k, r in enumerate(rows[1 : 1 + int(rows[0][0])]):
            p.cells.append((CODE["tri" if size in (3, 6) else "tet"], [int(x) - first for x in r[1 : 1 + (3 if size in (3, 6) else 4)]]))
            if extra:
                p.cell_tags.setdefault("region", {})[k] = float(r[1 + size])
    return p


def parse_nastran(raw: bytes) -> Parsed:
    """Bulk data in free, small or large fields."""
    p, ids = Parsed(), {}
    cards: list[list[str]] = []
    for line in raw.decode("latin-1").splitlines():
        line = line.split("$")[0].rstrip()
        if not line:
            continue
        if "," in line:
            f = [x.strip() for x in line.split(",")]
        else:
            name = line[:8].strip()
            width = 16 if name.endswith("*") else 8
            f = [name, *[line[k : k + width].strip() for k in range(8, min(len(line), 72), width)]]
        if f[0] in ("", "*", "+") or f[0][0] in "*+":
            cards[-1] += f[1:]
        else:
            cards.append(f)

    def real(x: str) -> float:
        return float(re.sub(r"(?<=[\d.])([+-]\d+)$", r"e\1", x)) if x else 0.0

    for c in cards:
        name = c[0].rstrip("*").upper()
        if name == "GRID":
            ids[int(c[1])] = len(p.points)
            p.points.append((real(c[3]), real(c[4]), real(c[5])))
    for c in cards:
        name = c[0].rstrip("*").upper()
        if name in NASTRAN_TYPES:
            kind, n = NASTRAN_TYPES[name]
            conn = [int(x) for x in c[3:] if x][:n]
            p.cell_tags.setdefault("property", {})[len(p.cells)] = float(c[2] or 0)
            p.cells.append((CODE[kind], [ids[x] for x in conn]))
    return p


def parse_abaqus(raw: bytes) -> Parsed:
    """*NODE and *ELEMENT sections; an ELSET becomes a tag that numbers the sets in order."""
    p, ids, section, kind, label = Parsed(), {}, "", None, 0
    sets: dict[str, int] = {}
    for line in raw.decode("latin-1").splitlines():
        s = line.strip()
        if not s or s.startswith("**"):
            continue
        if s.startswith("*"):
            key, *args = [x.strip() for x in s.upper().split(",")]
            section, opts = key, dict(a.split("=", 1) for a in args if "=" in a)
            kind = ABAQUS_TYPES.get(opts.get("TYPE", ""))
            label = sets.setdefault(opts["ELSET"], len(sets) + 1) if section == "*ELEMENT" and "ELSET" in opts else 0
            continue
        w = [x.strip() for x in s.split(",") if x.strip()]
        if section == "*NODE":
            ids[int(w[0])] = len(p.points)
            p.points.append(tuple((*map(float, w[1:4]), 0.0, 0.0)[:3]))
        elif section == "*ELEMENT" and kind:
            if label:
                p.cell_tags.setdefault("elset", {})[len(p.cells)] = label
            p.cells.append((CODE[kind[0]], [ids[int(x)] for x in w[1 : 1 + kind[1]]]))
    return p


def parse_ideas(raw: bytes) -> Parsed:
    """Universal files: datasets 2411 and 781 (nodes), 2412 and 780 (elements)."""
    lines = raw.decode("latin-1").splitlines()
    p, ids, k = Parsed(), {}, 0
    while k < len(lines):
        if lines[k].strip() != "-1" or k + 1 >= len(lines):
            k += 1
            continue
        kind, k = lines[k + 1].strip(), k + 2
        body = []
        while k < len(lines) and lines[k].strip() != "-1":
            body.append(lines[k])
            k += 1
        k += 1
        j = 0
        while j < len(body):
            w = body[j].split()
            if kind in ("2411", "781"):
                ids[int(w[0])] = len(p.points)
                p.points.append(tuple(float(x.replace("D", "E").replace("d", "e")) for x in body[j + 1].split()[:3]))
                j += 2
            elif kind in ("2412", "780"):
                n, fe = int(w[5] if kind == "2412" else w[-1]), int(w[1])
                j += 1
                if fe in (11, 21, 22, 24) and kind == "2412":
                    j += 1  # beams have a line of their own first
                conn: list[int] = []
                while len(conn) < n:
                    conn += map(int, body[j].split())
                    j += 1
                if fe in IDEAS_TYPES:
                    name, size = IDEAS_TYPES[fe]
                    p.cells.append((CODE[name], [ids[c] for c in conn[:size]]))
            else:
                j += 1
    return p


def parse_points(raw: bytes) -> Parsed:
    """One point a line."""
    return Parsed([tuple((*map(float, re.split(r"[,\s]+", s.strip())[:3]), 0.0, 0.0)[:3]) for s in raw.decode().splitlines() if s.strip()])


def render_gmv(p: Parsed) -> bytes:
    names = {"tri": "tri", "quad": "quad", "tet": "tet", "hex": "hex", "prism": "prism", "pyramid": "pyramid", "edge": "line"}
    out = ["gmvinput ascii", f"nodev {len(p.points)}", *[" ".join(map(repr, q)) for q in p.points]]
    cells = [(names[NAMES[t]], c) for t, c in p.cells if NAMES[t] in names]
    out += [f"cells {len(cells)}", *[f"{n} {len(c)} {' '.join(str(x + 1) for x in c)}" for n, c in cells], "endgmv"]
    return ("\n".join(out) + "\n").encode()


def render_ansys(p: Parsed) -> bytes:
    out = ["/PREP7", *[f"N,{k},{','.join(map(repr, q))}" for k, q in enumerate(p.points, 1)]]
    out += [f"EN,{k},{','.join(str(x + 1) for x in c)}" for k, (_, c) in enumerate(p.cells, 1)]
    return ("\n".join([*out, "FINISH"]) + "\n").encode()
