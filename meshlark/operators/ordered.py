"""Ordered analytics: ids, slices, runs, permutations and rings, without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import persist


def dense_ids(df: DataFrame, order: list[str], name: str = "gid", first: int = 1) -> DataFrame:
    """Consecutive ids in the given order.

    Rows are range-partitioned and numbered within their partition; the partitions' counts, a row each,
    give the offsets.  Equal keys are numbered in any order among themselves.
    """
    dealt = persist(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()))
    counts = dealt.groupBy("__p").count()
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__o"))
    local = F.row_number().over(Window.partitionBy("__p").orderBy(*order))
    return dealt.join(F.broadcast(offsets), "__p").withColumn(name, (F.col("__o") + local + (first - 1)).cast("bigint")).drop("__p", "__o")


def search(values: DataFrame, keys: DataFrame, value: str = "value") -> DataFrame:
    """(id, pos): for every key (id, and a column ``value``) how many of the values are less: where it would go into the sorted list.

    A key's place among keys and values together, less its place among the keys, both by range partitions.
    """
    k = keys.select("id", F.col(value).alias("v"))
    both = k.withColumn("late", F.lit(0)).unionByName(values.select(F.lit(None).cast(keys.schema["id"].dataType).alias("id"), F.col(value).alias("v"), F.lit(1).alias("late")))
    among = dense_ids(both, ["v", "late", "id"], "a", 0).where("late = 0").select("id", "a")
    return among.join(dense_ids(k, ["v", "id"], "b", 0).select("id", "b"), "id").select("id", (F.col("a") - F.col("b")).alias("pos"))


def slices(df: DataFrame, order: list[str], parts: int, name: str = "part") -> DataFrame:
    """Contiguous slices of near-equal size, numbered from 0; the first n mod ``parts`` have one row more."""
    numbered = dense_ids(df, order, "__g", 0)
    n = numbered.agg(F.count("*").alias("__n"))
    q, r = F.floor(F.col("__n") / parts), F.col("__n") % parts
    cut = r * (q + 1)
    part = F.when(F.col("__g") < cut, F.floor(F.col("__g") / (q + 1))).otherwise(r + F.floor((F.col("__g") - cut) / F.greatest(q, F.lit(1))))
    return numbered.crossJoin(F.broadcast(n)).withColumn(name, part.cast("int")).drop("__g", "__n")


def runs(ids: DataFrame, col: str = "id", cell: int = 1 << 20) -> DataFrame:
    """(first, last): runs of consecutive ids.

    Runs are found within cells of the id axis, which many tasks share; those that meet at cell borders are then joined, and
    there are at most two of these a cell.
    """
    d = ids.select(F.col(col).alias("id")).distinct().withColumn("cell", F.floor(F.col("id") / cell))
    w = Window.partitionBy("cell").orderBy("id")
    own = d.withColumn("g", F.col("id") - F.row_number().over(w)).groupBy("cell", "g").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    inner = own.where((F.col("first") != F.col("cell") * cell) & (F.col("last") != (F.col("cell") + 1) * cell - 1)).select("first", "last")
    edge = own.where((F.col("first") == F.col("cell") * cell) | (F.col("last") == (F.col("cell") + 1) * cell - 1))
    o = Window.orderBy("first")
    joined = edge.withColumn("new", F.coalesce((F.col("first") != F.lag("last").over(o) + 1).cast("int"), F.lit(1))).withColumn("k", F.sum("new").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return inner.unionByName(joined.groupBy("k").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("first", "last"))


def permutation(entities: DataFrame, key: str, skip: object = None) -> DataFrame:
    """(etype, old, new): within each type ids are dealt out anew in the order of (key, id); rows with the skip value keep theirs.

    The new ids are the old ones of the rows that move, in rising order.
    """
    moving = entities if skip is None else entities.where(F.col(key) != F.lit(skip))
    by_key = dense_ids(moving.select("etype", "id", key), ["etype", key, "id"], "k")
    by_id = dense_ids(moving.select(F.col("etype").alias("t"), F.col("id").alias("new")), ["t", "new"], "k")
    return by_key.join(by_id, "k").select("etype", F.col("id").alias("old"), "new")


def rewrite(element: DataFrame, vertex_map: DataFrame) -> DataFrame:
    """Connectivity with vertices renamed by (old, new); vertices without a row keep their name."""
    long = element.select("etype", "id", F.posexplode("conn").alias("pos", "old"))
    named = long.join(vertex_map.select("old", "new"), "old", "left").select("etype", "id", "pos", F.coalesce("new", "old").alias("v"))
    conn = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"])
    return named.groupBy("etype", "id").agg(conn.alias("conn"))


def rings(element: DataFrame, dim: int = 1) -> DataFrame:
    """(vid, ring, closed): the faces around each vertex of a surface as an ordered cycle (or open fan).

    A ring is bounded by the faces of a vertex; groups are per vertex.
    """
    from ..functions import topology as T

    faces = element.where(T.dimension(F.col("etype")) == 2).select("etype", "id", T.corners(F.col("etype"), F.col("conn")).alias("c"))
    n = F.size("c")
    around = faces.select("id", F.explode(F.transform("c", lambda v, k: F.struct(v.alias("vid"), F.element_at("c", (k + 1) % n + 1).alias("out"), F.element_at("c", (k + n - 1) % n + 1).alias("back")))).alias("s")).select("id", "s.*")

    def walk(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        nxt = {int(b): (int(i), int(o)) for i, o, b in zip(pdf["id"], pdf["out"], pdf["back"], strict=True)}
        by_out = {int(o): int(b) for o, b in zip(pdf["out"], pdf["back"], strict=True)}
        ends = sorted(b for b in nxt if b not in by_out)
        start = ends[0] if ends else min(nxt, key=lambda b: nxt[b][0])
        ring, at, used = [], start, set()
        while at in nxt and at not in used:
            used.add(at)
            i, o = nxt[at]
            ring.append(i)
            at = o
        return pd.DataFrame({"vid": [int(pdf["vid"].iloc[0])], "ring": [ring], "closed": [at == start and not ends]})

    return around.groupBy("vid").applyInPandas(walk, "vid bigint, ring array<bigint>, closed boolean")
