"""Connected components over an edge table, without gathering edges anywhere.

Each round (a) deals edges by their larger end and contracts every partition
with a union-find, so an end with several parents links those parents, and
(b) jumps pointers: parent becomes grandparent.  Labels only fall, each round
halves the depth, and the loop ends when a round changes nothing: every node
then has exactly one edge, to the smallest node of its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import persist


#: Edges that a task holds at once, in up to 100 MB.
HOLD = 200_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star edges (node, smallest node) of what the partition's edges connect, ``HOLD`` edges at a time.

    Edges come sorted by ``u``.  Where a cut falls between edges of one ``u``, the next part starts with its edge to the smallest node so far.
    """
    parent: dict[int, int] = {}
    seen: set[tuple[int, int]] = set()

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top and up != x:
            parent[x] = top
            x = up
        return top

    def add(u: int, v: int) -> None:
        a, c = root(u), root(v)
        if a != c:
            parent[max(a, c)] = min(a, c)
            parent.setdefault(min(a, c), min(a, c))

    def stars(carried: int | None = None) -> pa.RecordBatch:
        found = [(x, r) for x in list(parent) if x != carried and (r := root(x)) != x]
        changed = [int(e not in seen) for e in found]
        return pa.record_batch([pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64()), pa.array(changed, pa.int32())], ["u", "v", "changed"])

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if len(seen) >= HOLD:
                carry = root(u)
                yield stars(u)
                parent.clear()
                seen.clear()
                if carry != u:
                    seen.add((u, carry))
                    add(u, carry)
            seen.add((u, v))
            add(u, v)
    if parent:
        yield stars()


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star edges (u, v) of the edges that a function of a worker yields.

    Within that function, as a ``mapInArrow`` on another's result would keep a second worker beside each.
    """
    for b in _contract(batches):
        yield b.select(["u", "v"])


def contract(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").mapInArrow(_contract, "u bigint, v bigint, changed int")


def components(edges: DataFrame, max_rounds: int = 60, stars: bool = False) -> DataFrame:
    """(node, root) of every node that has an edge to a smaller one.

    ``edges`` has bigint columns ``u`` and ``v``, in any order, repeats and loops
    allowed.  A node that is its component's smallest has no row.  No edges: no rows.
    ``stars``: the edges come out of :func:`contracted`, and aren't contracted again before they are dealt.
    """
    e = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = persist(e if stars else contract(e))
    for _ in range(max_rounds):
        c = contract(e.repartition(F.col("u")).sortWithinPartitions("u", "v"))
        # written out, as a join right above an aggregate can't split what the children of one large component's root read
        up = persist(e.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("z")))
        nxt = persist(c.join(up, c.v == up.w, "left").select("u", F.coalesce("z", "v").alias("v"), (F.col("changed") + F.col("z").isNotNull().cast("int")).alias("changed")))
        moved = nxt.agg(F.sum("changed")).first()[0] or 0
        e = nxt
        if not moved:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
