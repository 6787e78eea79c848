"""Relations between two models, storage estimates, and searches in sorted tuples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def infer(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """(a, b): entities and sets of two models that agree on all the tags ``on``; both sides have ``id`` and these columns.

    A tag that is missing agrees with nothing.
    """
    a, b = left.select(F.col("id").alias("a"), *on), right.select(F.col("id").alias("b"), *on)
    return a.join(b, on).select("a", "b")


def related(relation: DataFrame, ids: DataFrame, back: bool = False) -> DataFrame:
    """Partners of the entities (column id), either way."""
    own, other = ("b", "a") if back else ("a", "b")
    return relation.join(ids.select(F.col("id").alias(own)), own).select(F.col(own).alias("id"), F.col(other).alias("partner"))


def storage(mesh) -> DataFrame:  # noqa: ANN001
    """(table, rows, bytes): what the tables take with 8 bytes a number, as an estimate."""
    v = mesh.vertex.agg(F.count("*").alias("rows")).select(F.lit("vertex").alias("table"), "rows", (F.col("rows") * 32).alias("bytes"))
    e = mesh.element.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("conn") + 1), F.lit(0)).alias("n")).select(F.lit("element").alias("table"), "rows", (F.col("n") * 8 + F.col("rows")).alias("bytes"))
    m = mesh.member.agg(F.count("*").alias("rows")).select(F.lit("member").alias("table"), "rows", (F.col("rows") * 21).alias("bytes"))
    return v.unionByName(e).unionByName(m)


def tolerance_groups(points: DataFrame, col: str, eps: float) -> DataFrame:
    """Rows with ``group``: values sorted, a new group begins where the step from the one before is over eps.

    Values are dealt over cells of many eps; the last of each earlier cell, a row a cell, tells whether a cell's first
    group goes on from before.
    """
    from pyspark.sql import Window

    cell = 1000 * eps
    d = points.withColumn("__c", F.floor(F.col(col) / cell))
    w = Window.partitionBy("__c").orderBy(col)
    d = d.withColumn("__step", F.col(col) - F.lag(col).over(w))
    ends = d.groupBy("__c").agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.sum((F.col("__step") > eps).cast("int")).alias("inner"))
    o = Window.orderBy("__c")
    starts = ends.withColumn("fresh", F.coalesce((F.col("lo") - F.lag("hi").over(o) > eps).cast("int"), F.lit(1)))
    before = starts.withColumn("base", F.sum("fresh").over(o) + F.coalesce(F.sum(F.coalesce("inner", F.lit(0))).over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = d.join(before.select("__c", "base"), "__c")
    return out.withColumn("group", (F.col("base") + F.coalesce(F.sum((F.col("__step") > eps).cast("int")).over(w), F.lit(0))).cast("bigint")).drop("__c", "__step", "base")
