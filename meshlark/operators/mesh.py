"""A mesh as named DataFrames, with scans, filters and projections."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import topology as T

VERTEX = "id bigint, x double, y double, z double"
ELEMENT = "etype tinyint, id bigint, conn array<bigint>"
MEMBER = "sid bigint, pos int, etype tinyint, id bigint"
LINK = "parent bigint, child bigint"
ESET = "sid bigint, ordered boolean, track boolean"


@dataclass(frozen=True)
class Mesh:
    """vertex, element, eset, member and link tables, and tags by name.

    A tag table is (etype, id, value).  All operators return new DataFrames; nothing is changed in place.
    """

    vertex: DataFrame
    element: DataFrame
    eset: DataFrame | None = None
    member: DataFrame | None = None
    link: DataFrame | None = None
    tags: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def build(cls, vertex: DataFrame, element: DataFrame, **rest) -> Mesh:
        spark = vertex.sparkSession
        none = {"eset": ESET, "member": MEMBER, "link": LINK}
        filled = {k: rest.get(k) if rest.get(k) is not None else spark.createDataFrame([], s) for k, s in none.items()}
        return cls(vertex, element, tags=rest.get("tags", {}), **filled)

    def entities(self) -> DataFrame:
        """(etype, id) of all vertices, elements and sets."""
        v = self.vertex.select(F.lit(0).cast("tinyint").alias("etype"), "id")
        s = self.eset.select(F.lit(T.CODE["entityset"]).cast("tinyint").alias("etype"), F.col("sid").alias("id"))
        return v.unionByName(self.element.select("etype", "id")).unionByName(s)

    def by_type(self, name: str) -> DataFrame:
        code = T.CODE[name]
        if code == 0:
            return self.vertex.select(F.lit(0).cast("tinyint").alias("etype"), "id")
        if name == "entityset":
            return self.entities().where(F.col("etype") == code)
        return self.element.where(F.col("etype") == code).select("etype", "id")

    def by_dimension(self, dim: int) -> DataFrame:
        """Types of a dimension are neighbours in handle order, so this is a range filter."""
        codes = [k for k, (_, d, _) in enumerate(T.ETYPES) if d == dim]
        return self.entities().where(F.col("etype").between(min(codes), max(codes)))

    def incidence(self) -> DataFrame:
        """(etype, id, pos, vid): connectivity, one row a vertex."""
        return self.element.select("etype", "id", F.posexplode("conn").alias("pos", "vid"))

    def coordinates(self) -> DataFrame:
        """(etype, id, x, y, z): of vertices their own, of elements the mean of their vertices'."""
        at = self.incidence().join(self.vertex.withColumnRenamed("id", "vid"), "vid").groupBy("etype", "id").agg(*[F.avg(c).alias(c) for c in "xyz"])
        return self.vertex.select(F.lit(0).cast("tinyint").alias("etype"), "id", "x", "y", "z").unionByName(at)

    def connectivity(self, name: str | None = None, corners_only: bool = False) -> DataFrame:
        e = self.element if name is None else self.element.where(F.col("etype") == T.CODE[name])
        return e.select("etype", "id", T.corners(F.col("etype"), F.col("conn")).alias("conn")) if corners_only else e

    def with_tag(self, name: str, values: DataFrame) -> Mesh:
        return replace(self, tags=self.tags | {name: values.select("etype", "id", "value")})


def tag_filter(entities: DataFrame, predicates: list[dict], condition: str = "intersect", within: DataFrame | None = None) -> DataFrame:
    """Entities (etype, id) for which all or any of the tag predicates hold.

    A predicate has ``tag`` (etype, id, value) and may have ``value`` and ``default``.  Without a value
    it asks that the entity has the tag; with one, that the tag has it, where an entity
    without the tag counts with the default.  ``within`` bounds an intersection and is added to a union.
    """
    out, hits = entities.select("etype", "id"), []
    for k, p in enumerate(predicates):
        name = f"__v{k}"
        t = p["tag"].select("etype", "id", F.struct("value").alias(name))
        out = out.join(t, ["etype", "id"], "left")
        has = F.col(name).isNotNull()
        if p.get("value") is None:
            hits.append(has)
        else:
            held = F.col(f"{name}.value")
            if p.get("default") is not None:
                held = F.when(has, held).otherwise(F.lit(p["default"]))
            hits.append(F.coalesce(held == F.lit(p["value"]), F.lit(False)))
    cond: Column | None = None
    for h in hits:
        cond = h if cond is None else (cond & h if condition == "intersect" else cond | h)
    out = out.where(F.lit(condition == "intersect") if cond is None else cond).select("etype", "id").distinct()
    if within is None:
        return out
    w = within.select("etype", "id").distinct()
    return out.join(w, ["etype", "id"], "left_semi") if condition == "intersect" else out.unionByName(w).distinct()


def tag_values(entities: DataFrame, tag: DataFrame, default: object = None, strict: bool = False) -> DataFrame:
    """(etype, id, value) with the default where the tag is missing; ``strict`` drops nothing but marks it in ``missing``."""
    out = entities.join(tag.select("etype", "id", "value", F.lit(True).alias("__has")), ["etype", "id"], "left")
    kind = tag.schema["value"].dataType
    value = F.when(F.col("__has"), F.col("value")).otherwise(F.lit(default).cast(kind))
    cols = ["etype", "id", value.alias("value")]
    return out.select(*cols, (F.col("__has").isNull() & F.lit(default is None)).alias("missing")) if strict else out.select(*cols)


def bits_equal(tag: DataFrame, mask: int, bits: int) -> DataFrame:
    """Entities whose masked bits are the pattern."""
    return tag.where(F.col("value").bitwiseAND(F.lit(mask)) == bits).select("etype", "id")


def contains(members: DataFrame, sid: int, wanted: DataFrame, condition: str = "intersect") -> DataFrame:
    """One row, ``held``: whether the set has all (intersect) or any of the entities; set 0, the root, has all."""
    if sid == 0:
        return wanted.sparkSession.createDataFrame([(True,)], "held boolean")
    w = wanted.select("etype", "id").distinct()
    m = members.where(F.col("sid") == sid).select("etype", "id", F.lit(1).alias("in")).distinct()
    got = w.join(m, ["etype", "id"], "left").agg(F.count("*").alias("n"), F.count("in").alias("k"))
    return got.select(((F.col("k") == F.col("n")) if condition == "intersect" else F.col("k") > 0).alias("held"))


def contains_each(members: DataFrame, wanted: DataFrame, condition: str = "intersect") -> DataFrame:
    """(sid, held) for every set of ``wanted`` (sid, etype, id): whether it has all (intersect) or any of the entities asked of it."""
    w = wanted.select("sid", "etype", "id").distinct()
    m = members.select("sid", "etype", "id", F.lit(1).alias("in")).distinct()
    got = w.join(m, ["sid", "etype", "id"], "left").groupBy("sid").agg(F.count("*").alias("n"), F.count("in").alias("k"))
    return got.select("sid", ((F.col("k") == F.col("n")) if condition == "intersect" else F.col("k") > 0).alias("held"))


def status_filter(entities: DataFrame, column: str, mask: int, op: str) -> DataFrame:
    """AND: all bits of the mask set; OR: any; NOT: none."""
    bits = F.col(column).bitwiseAND(F.lit(mask))
    return entities.where({"and": bits == mask, "or": bits != 0, "not": bits == 0}[op])


class TagCatalog:
    """Tag definitions with find-or-create rules."""

    KINDS = ("opaque", "integer", "double", "bit", "handle")

    def __init__(self) -> None:
        self.defs: dict[str, dict] = {}

    def handle(self, name: str, length: int = 1, kind: str = "opaque", storage: str = "sparse", default: object = None, create: bool = False, excl: bool = False, any_: bool = False, default_ok: bool = False) -> dict:
        """Finds, checks or creates a definition.

        KeyError: not there and not to be created; ValueError: there but exclusive, or of another
        kind, length, storage or default; length -1 is a varying one, 0 is no length.
        """
        if kind not in self.KINDS or length == 0 or length < -1:
            raise ValueError(f"{name}: no such kind or length")
        if (d := self.defs.get(name)) is not None:
            if excl:
                raise ValueError(f"{name}: exists")
            if not any_:
                if (d["kind"], d["length"]) != (kind, length) or (create and d["storage"] != storage):
                    raise ValueError(f"{name}: another kind, length or storage")
                if default is not None and d["default"] != default and not default_ok:
                    raise ValueError(f"{name}: another default")
            return d
        if not (create or excl):
            raise KeyError(name)
        self.defs[name] = d = {"name": name, "length": length, "kind": kind, "storage": storage, "default": default}
        return d

    def delete(self, name: str) -> None:
        del self.defs[name]
