"""The driver's tables read as a mesh.

part: vertices; orders: elements over the parts of their line items; region, nation, customer,
order: sets by containment and parent/child links; suppliers: parts of a partition; labels: a sparse tag on documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Containment levels are told apart by these offsets of set ids.
REGION, NATION, CUSTOMER = 1_000_000_000_000, 2_000_000_000_000, 3_000_000_000_000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), *[e[k].cast("double").alias(c) for k, c in enumerate("xyz")], "label")


def incidence(spark: SparkSession, sf: str) -> DataFrame:
    """(etype, id, vid): distinct order-part pairs; an order is a polygon."""
    return table(spark, sf, "lineitem").select(F.lit(4).cast("tinyint").alias("etype"), F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("vid")).distinct()


def elements(spark: SparkSession, sf: str) -> DataFrame:
    """(etype, id, conn) with the parts of an order as its vertex list."""
    w = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]
    items = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct(*w))), lambda s: s["l_partkey"]).alias("conn"))
    return items.select(F.lit(4).cast("tinyint").alias("etype"), F.col("l_orderkey").alias("id"), "conn")


def links(spark: SparkSession, sf: str) -> DataFrame:
    """(parent, child): region to nation to customer to order."""
    n = table(spark, sf, "nation").select((F.col("n_regionkey") + F.lit(REGION)).alias("parent"), (F.col("n_nationkey") + F.lit(NATION)).alias("child"))
    c = table(spark, sf, "customer").select((F.col("c_nationkey") + F.lit(NATION)).alias("parent"), (F.col("c_custkey") + F.lit(CUSTOMER)).alias("child"))
    o = table(spark, sf, "orders").select((F.col("o_custkey") + F.lit(CUSTOMER)).alias("parent"), F.col("o_orderkey").alias("child"))
    return n.unionByName(c).unionByName(o)


def set_members(spark: SparkSession, sf: str) -> DataFrame:
    """(sid, pos, etype, id): containment of sets in sets, and of orders in customers."""
    n = F.lit(None).cast("int").alias("pos")
    up = links(spark, sf).select(F.col("parent").alias("sid"), n, F.when(F.col("child") >= NATION, 11).otherwise(4).cast("tinyint").alias("etype"), F.col("child").alias("id"))
    return up


def tag(spark: SparkSession, sf: str, name: str, key: str, value: str, etype: int = 4) -> DataFrame:
    return table(spark, sf, name).select(F.lit(etype).cast("tinyint").alias("etype"), F.col(key).alias("id"), F.col(value).alias("value"))


def part_of(spark: SparkSession, sf: str) -> DataFrame:
    """(id, part_id): suppliers as the parts that share a vertex."""
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_suppkey").alias("part_id")).distinct()


def home_part(spark: SparkSession, sf: str) -> DataFrame:
    """(id, part_id): each order's one part, its smallest supplier."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_suppkey").alias("part_id"))
