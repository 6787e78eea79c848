"""Set algebra, membership edits, containment and parent/child closure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import reach

KEY = ["etype", "id"]


def unite(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).union(b.select(*KEY)).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).intersect(b.select(*KEY))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).distinct().join(b.select(*KEY), KEY, "left_anti")


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, ``same``: whether two ranges hold the same entities."""
    both = a.select(*KEY).distinct().withColumn("k", F.lit(1)).unionByName(b.select(*KEY).distinct().withColumn("k", F.lit(2)))
    odd = both.groupBy(*KEY).agg(F.sum("k").alias("k")).where("k <> 3")
    return odd.agg((F.count("*") == 0).alias("same"))


def equal_sets(member: DataFrame) -> DataFrame:
    """(sid, same_as): for every set the smallest set with the same contents, itself if there is none smaller.

    Sets of one size and of two equal checksums over their members are compared with the smallest of them member by member;
    one that differs from it in spite of these stands for itself.
    """
    m = member.select("sid", *KEY).distinct()
    sums = m.groupBy("sid").agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64(*KEY), F.lit(1 << 40))).alias("s"), F.bit_xor(F.xxhash64(*KEY, F.lit(7))).alias("x"))
    first = sums.groupBy("n", "s", "x").agg(F.min("sid").alias("rep"))
    asked = sums.join(first, ["n", "s", "x"]).select("sid", "rep", "n")
    held = asked.where("rep <> sid").join(m, "sid").join(m.withColumnRenamed("sid", "rep"), ["rep", *KEY]).groupBy("sid").agg(F.count("*").alias("k"))
    return asked.join(held, "sid", "left").select("sid", F.when(F.col("k") == F.col("n"), F.col("rep")).otherwise(F.col("sid")).alias("same_as"))


def pass_down(member: DataFrame, tag: DataFrame) -> DataFrame:
    """(etype, id, value): every set's tag value (sid, value) on its members; a member of several sets has a row for each value."""
    return member.join(tag.select("sid", "value"), "sid").select(*KEY, "value").distinct()


def within(member: DataFrame, sids: DataFrame, lowest: int, highest: int, recursive: bool = False) -> DataFrame:
    """(sid, etype, id): contents of sets whose type code lies between two: a type, or a dimension's neighbouring types."""
    return contents(member, sids, recursive).where(F.col("etype").between(lowest, highest))


def _once(member: DataFrame) -> DataFrame:
    return member.where(F.col("pos").isNotNull()).unionByName(member.where(F.col("pos").isNull()).dropDuplicates(["sid", *KEY]))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with k, from 0 in each set; a set of any size spreads over tasks."""
    from .ordered import dense_ids

    k = dense_ids(rows, ["sid", *order], "k", 0)
    return k.join(k.groupBy("sid").agg(F.min("k").alias("k0")), "sid").withColumn("k", F.col("k") - F.col("k0")).drop("k0")


def add_each(member: DataFrame, eset: DataFrame, rows: DataFrame) -> DataFrame:
    """Members with the rows (sid, etype, id) added: a SET holds each once, an ORDERED set appends them in the order of ``pos``, if there, and id."""
    order = ["pos"] if "pos" in rows.columns else []
    last = member.groupBy("sid").agg(F.max("pos").alias("last"))
    new = _numbered(rows.select("sid", *order, *KEY), [*order, *KEY]).join(eset.select("sid", "ordered"), "sid").join(last, "sid", "left")
    pos = F.when(F.col("ordered"), (F.coalesce("last", F.lit(-1)) + 1 + F.col("k")).cast("int"))
    return _once(member.unionByName(new.select("sid", pos.alias("pos"), *KEY)))


def add(member: DataFrame, eset: DataFrame, sid: int, entities: DataFrame) -> DataFrame:
    """:func:`add_each` for one set."""
    return add_each(member, eset, entities.withColumn("sid", F.lit(sid).cast("bigint")))


def remove_each(member: DataFrame, rows: DataFrame) -> DataFrame:
    """Members without the rows (sid, etype, id); of an ordered set all occurrences go."""
    return member.join(rows.select("sid", *KEY).distinct(), ["sid", *KEY], "left_anti")


def remove(member: DataFrame, sid: int, entities: DataFrame) -> DataFrame:
    return remove_each(member, entities.withColumn("sid", F.lit(sid).cast("bigint")))


def swap_each(member: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every (sid, etype, id) that stands in ``pairs`` becomes (new_etype, new_id), in place where ordered; a SET stays free of repeats."""
    p = pairs.select("sid", *KEY, "new_etype", "new_id")
    return _once(member.join(p, ["sid", *KEY], "left").select("sid", "pos", F.coalesce("new_etype", "etype").alias("etype"), F.coalesce("new_id", "id").alias("id")))


def swap(member: DataFrame, sid: int, pairs: DataFrame) -> DataFrame:
    return swap_each(member, pairs.withColumn("sid", F.lit(sid).cast("bigint")))


def convert_each(member: DataFrame, ordered: bool) -> DataFrame:
    """All sets of ``member`` as the other kind: to SET drops order and repeats; to ORDERED numbers in (etype, id) order."""
    if ordered:
        new = _numbered(member.select("sid", *KEY), KEY).withColumn("pos", F.col("k").cast("int"))
    else:
        new = member.select("sid", *KEY).distinct().withColumn("pos", F.lit(None).cast("int"))
    return new.select(*member.columns)


def convert(member: DataFrame, sid: int, ordered: bool) -> DataFrame:
    own, rest = member.where(F.col("sid") == sid), member.where(F.col("sid") != sid)
    return rest.unionByName(convert_each(own, ordered))


def contents(member: DataFrame, sids: DataFrame, recursive: bool = False, hops: int = -1) -> DataFrame:
    """(sid, etype, id): distinct contents; recursive ones leave out the contained sets themselves and take in what these hold."""
    from ..functions.topology import CODE

    code = CODE["entityset"]
    start = sids.select(F.col("sid").alias("start")).distinct()
    if not recursive:
        return member.join(start, member.sid == start.start).select("sid", *KEY).distinct()
    inner = member.where(F.col("etype") == code).select(F.col("sid").alias("parent"), F.col("id").alias("child"))
    below = reach(inner, start, hops).select("start", "node")
    all_sets = start.select("start", F.col("start").alias("node")).unionByName(below).distinct()
    held = member.where(F.col("etype") != code).select(F.col("sid").alias("node"), *KEY)
    return all_sets.join(held, "node").select(F.col("start").alias("sid"), *KEY).distinct()


def children(link: DataFrame, sids: DataFrame, hops: int = 1) -> DataFrame:
    """(sid, child, hop): descendants up to and with ``hops`` steps; -1: all."""
    return reach(link, sids.select(F.col("sid").alias("start")), hops).select(F.col("start").alias("sid"), F.col("node").alias("child"), "hop")


def parents(link: DataFrame, sids: DataFrame, hops: int = 1) -> DataFrame:
    back = link.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    return reach(back, sids.select(F.col("sid").alias("start")), hops).select(F.col("start").alias("sid"), F.col("node").alias("parent"), "hop")


def owners(member: DataFrame, entities: DataFrame) -> DataFrame:
    """Sets that hold the entities."""
    return member.join(entities.select(*KEY).distinct(), KEY).select(*KEY, "sid").distinct()


def ordered_contents(member: DataFrame, sid: int) -> DataFrame:
    """Order and repeats kept for an ordered set."""
    return member.where(F.col("sid") == sid).orderBy("pos", *KEY).select(*KEY)


def range_lookup(ranges: DataFrame, keys: DataFrame, cell: int = 1 << 16) -> DataFrame:
    """(key, value): keys looked up in disjoint intervals (start, count, value -> value + key - start).

    Intervals are dealt over cells of the key axis, so this is an equi-join.
    """
    r = ranges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("start") + F.col("count") - 1) / cell))))
    k = keys.withColumn("cell", F.floor(F.col("key") / cell))
    return k.join(r, "cell").where((F.col("key") >= F.col("start")) & (F.col("key") < F.col("start") + F.col("count"))).select("key", (F.col("value") + F.col("key") - F.col("start")).alias("value"))


def first_of(df: DataFrame, by: list[str], order: list[str], k: int = 1) -> DataFrame:
    """The first k rows of each group, by a total order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
