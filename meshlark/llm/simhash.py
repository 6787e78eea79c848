"""SimHash near-duplicates by pivot distance tables.

A document's 64-bit fingerprint takes the majority of every bit over the XXH64
values of its word shingles.  Two rules of linking are offered.

:func:`near_duplicates` links fingerprints that differ in at most two bits.  It works on
distinct fingerprints (exact copies collapse first):

1.  The reference fingerprints are the origin and the 64 unit vectors.  The
    difference of the distances to unit j and to the origin is 1 - 2*bit_j, so
    two fingerprints have equal columns over a band of references exactly when
    they agree on that band's bits.  With ``RADIUS + 2`` bands, two linked ones
    have equal columns over at least two bands: each pair of bands is a bucket key.
    A bucket of more than ``bucket_limit`` members is cut again in the same way by its
    other bits, so it spreads over many tasks; no link is lost by that either.
2.  In a bucket, a table of Hamming distances to ``n_pivots`` pseudo-random
    reference fingerprints discards every pair whose largest coordinate
    difference is over the radius (triangle inequality, so no link is lost).
3.  Survivors are verified on the fingerprints themselves.

:func:`similar` links texts whose sets of five-word shingles have a Jaccard similarity of
``similarity`` or more.  At 0.8 the fingerprints of a pair differ in up to 14 bits, too many for
buckets of fingerprint bits, so texts meet by bands of minimum hashes instead
(``BANDS`` bands of ``ROWS``: a pair at 0.8 is missed once in 5000 times, closer ones less).
Then pivot tables with ``WIDE`` as the radius discard, and survivors are verified on the
shingle sets themselves, each set read once for every block that it is compared with.

Wherever many members meet in one place, :func:`near_stars` returns what connects them and not
all their pairs: a member that joins the largest cluster is compared only with those outside it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, blobs, persist, sliced
from .components import components, contracted

RADIUS = 2
BLOCK = 1 << 15
#: Words of a shingle and similarity where no contract says otherwise.
SIZE, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 3
#: Bits in which fingerprints of similar texts may differ: 9.6 expected at similarity 0.8, deviation 2.9.
WIDE = 22
#: Shingles of texts that are held in one task for comparison.
HOLD = 1 << 20


def _hashes(text: bytes | None, size: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles in order, by blocks; nothing for a text without words."""
    w = (text or b"").lower().split()  # bytes: A-Z only; 0x20 and 0x09-0x0D
    if len(w) < size:
        if w:
            yield np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)], np.uint64)
        return
    n = len(w) - size + 1
    for s in range(0, n, BLOCK):
        part = w[s : s + BLOCK + size - 1]
        sh = map(b" ".join, zip(*(part[k:] for k in range(size)), strict=False))
        yield np.fromiter(map(xxhash.xxh64_intdigest, sh, repeat(42)), np.uint64)


def _majority(blocks: Iterator[np.ndarray]) -> int:
    n, ones = 0, np.zeros(64, np.int64)
    for h in blocks:
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """Unsigned fingerprint of UTF-8 text over all shingles, repeats included; zero without words."""
    return _majority(_hashes(text, size))


def shingle_set(text: bytes | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct shingle hashes; one zero for a text without words."""
    found = list(_hashes(text, size))
    return np.unique(np.concatenate(found)) if found else np.zeros(1, np.uint64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp) of every row; fp holds the 64 bits as a signed bigint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, size) for t in blobs(b.column(1))], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fp)], ["id", "fp"])

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id bigint, fp bigint")


def pivots(n: int) -> np.ndarray:
    """Pseudo-random reference fingerprints, the same on every machine."""
    return np.random.default_rng(20_240_229).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def distances(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """The table of Hamming distances, a row for each fingerprint."""
    out = np.empty((len(fps), len(refs)), np.int8)
    for k, r in enumerate(refs):
        out[:, k] = np.bitwise_count(fps ^ r)
    return out


def near_pairs(fps: np.ndarray, start: np.ndarray, sizes: np.ndarray, refs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius inside small groups, which start at ``start``; equal-sized groups go together."""
    out_a, out_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for m in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(m, 1)
        at = start[sizes == m]
        step = max(1, 200_000 // len(i))
        for s in range(0, len(at), step):
            lo = at[s : s + step]
            rows = (lo[:, None] + np.arange(m)).ravel()
            dist = distances(fps[rows], refs)
            la = (np.arange(len(lo))[:, None] * m + i).ravel()
            lb = (np.arange(len(lo))[:, None] * m + j).ravel()
            for k in range(0, len(refs), 8):  # coordinates in groups; few pairs reach the later ones
                keep = np.abs(dist[la, k : k + 8] - dist[lb, k : k + 8]).max(axis=1, initial=0) <= radius
                la, lb = la[keep], lb[keep]
            a, b = rows[la], rows[lb]
            near = np.bitwise_count(fps[a] ^ fps[b]) <= radius
            out_a.append(a[near])
            out_b.append(b[near])
    return np.concatenate(out_a), np.concatenate(out_b)


def near_stars(fps: np.ndarray, refs: np.ndarray, radius: int, accept: Callable[[int, np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Index pairs that connect all that the pairs within the radius (and accepted) connect; one fewer than members at most.

    ``accept``: of a member and others, which of these it may be linked to.  A member is first tried against the first member of the largest cluster: if it joins, only those outside that cluster are left to compare.
    """
    m, dist, out = len(fps), distances(fps, refs), []
    label, rest, big, lead, count = np.arange(m), np.empty(0, np.int64), -1, -1, np.ones(m, np.int64)

    def near(i: int, among: np.ndarray) -> np.ndarray:
        for k in range(0, len(refs), 8):
            among = among[np.abs(dist[among, k : k + 8] - dist[i, k : k + 8]).max(axis=1, initial=0) <= radius]
        among = among[np.bitwise_count(fps[among] ^ fps[i]) <= radius]
        return among[accept(i, among)] if accept is not None and len(among) else among

    for i in range(1, m):
        hits = near(i, np.array([lead])) if big >= 0 else np.empty(0, np.int64)
        if len(hits):
            out.append((i, lead))
            label[i] = big
            count[big] += 1
            hits = near(i, rest)
        else:
            hits = near(i, np.arange(i))
        moved = False
        for h in hits.tolist():
            a, b = label[i], label[h]
            if a == b:
                continue
            out.append((i, h))
            if count[a] < count[b]:
                a, b = b, a
            label[: i + 1][label[: i + 1] == b] = a
            count[a] += count[b]
            moved = True
        top = label[i] if big < 0 or count[label[i]] > count[label[lead]] else label[lead]
        if count[top] > 1 and (moved or top != big):
            seen = np.flatnonzero(label[: i + 1] == top)
            big, lead = int(top), int(seen[0])
            rest = np.flatnonzero(label[: i + 1] != big)
        elif label[i] != big:
            rest = np.append(rest, i)
    return out


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """(columns, start, size) of runs with equal first ``keys`` columns; rows come sorted by these, and a run is never cut.

    All columns are bigints.
    """
    left: list[np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if left is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(left, cols, strict=True)]
        edge = np.zeros(len(cols[0]) - 1, bool)
        for c in cols[:keys]:
            edge |= c[1:] != c[:-1]
        start = np.concatenate([[0], np.flatnonzero(edge) + 1])
        last = int(start[-1])
        left = [c[last:].copy() for c in cols]
        if last:
            start = start[:-1]
            yield cols, start, np.diff(np.append(start, last))
    if left is not None:
        yield left, np.array([0]), np.array([len(left[0])])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(bands: list[int]) -> list[int]:
    return [_signed(a | b) for a, b in combinations(bands, 2)]


def bucket_links(bucketed: DataFrame, keys: list[str], n_pivots: int, radius: int, ratio: float = 0.0, stars: bool = False) -> DataFrame:
    """Edges (u, v) over bigint columns ``node``, ``fp`` and ``n`` that connect the members of every bucket which lie within the radius.

    With ``ratio``, a pair whose smaller ``n`` is less than that share of the larger one isn't linked.  With ``stars``, a partition's
    edges give way to star edges that connect the same.
    """
    refs = pivots(n_pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, start, size in groups(batches, len(keys)):
            node, fps, n = cols[-3], np.ascontiguousarray(cols[-2]).view(np.uint64), cols[-1]
            few = (size > 1) & (size <= 64)
            a, b = near_pairs(fps, start[few], size[few], refs, radius)
            if ratio:
                keep = np.minimum(n[a], n[b]) >= ratio * np.maximum(n[a], n[b])
                a, b = a[keep], b[keep]
            out = [np.stack([a, b], 1)]
            for s, k in zip(start[size > 64].tolist(), size[size > 64].tolist(), strict=True):
                ok = (lambda i, js, s=s: np.minimum(n[s + i], n[s + js]) >= ratio * np.maximum(n[s + i], n[s + js])) if ratio else None
                out.append(np.array(near_stars(fps[s : s + k], refs, radius, ok), np.int64).reshape(-1, 2) + s)
            found = node[np.concatenate(out)]
            yield pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])

    rows = bucketed.select(*keys, "node", "fp", "n")
    found = (lambda batches: contracted(run(batches))) if stars else run
    return rows.repartition(*keys).sortWithinPartitions(*keys, "n", "node").mapInArrow(found, "u bigint, v bigint")


def link(distinct_fps: DataFrame, bucket_limit: int = 4096, n_pivots: int = 32, stars: bool = False) -> DataFrame:
    """Edges (u, v) that connect every two fingerprints within two bits, ``stars`` as in :func:`bucket_links`; ``fp`` must be distinct."""
    quarters = [0xFFFF << 16 * k for k in range(RADIUS + 2)]
    first = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in _masks(quarters)])
    keyed = distinct_fps.select("fp", F.posexplode(first).alias("band", "key"))
    full = persist(keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1"))
    shared = keyed.join(full, ["band", "key"])
    # second cut: four bands of the other 32 bits, two of which agree again
    second = []
    for a, b in combinations(range(4), 2):
        free = [k for k in range(4) if k not in (a, b)]
        second.append(_masks([0xFF << (16 * k + h) for k in free for h in (0, 8)]))
    cuts = F.element_at(F.array(*[F.array(*map(F.lit, m)) for m in second]), F.col("band") + 1)
    none = F.array(F.lit(0).cast("bigint"))
    parts = shared.select("fp", "band", "key", F.posexplode(F.when(F.col("n") > bucket_limit, cuts).otherwise(none)).alias("sub", "mask"))
    parts = parts.select(F.col("band").cast("bigint").alias("band"), "key", F.col("sub").cast("bigint").alias("sub"), F.col("fp").bitwiseAND(F.col("mask")).alias("subkey"), F.col("fp").alias("node"), "fp", F.lit(1).cast("bigint").alias("n"))
    return bucket_links(parts, ["band", "key", "sub", "subkey"], n_pivots, RADIUS, stars=stars)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, bucket_limit: int = 4096, n_pivots: int = 32) -> DataFrame:
    """One row per input row: id, fp (bigint bits) and component_id, the smallest id that links reach.

    Null or word-less texts have fingerprint zero and link like any other.  A null
    id never is a component's id unless all ids of the component are null.  Texts of any length
    are hashed whole, block by block.  Repeated rows each give a row; an empty table gives none.
    Other columns, whatever their names, are ignored.
    """
    fps = persist(fingerprints(df, id_col, text_col, size))
    return components_of(fps, bucket_limit, n_pivots)


def components_of(fps: DataFrame, bucket_limit: int = 4096, n_pivots: int = 32) -> DataFrame:
    """(id, fp) with component_id."""
    reps = persist(fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    roots = components(link(reps.select("fp"), bucket_limit, n_pivots, stars=True), stars=True)
    named = persist(reps.join(roots, reps.fp == roots.node, "left").select("fp", "rep", "copies", F.coalesce("root", "fp").alias("root")))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    label = persist(named.join(least, "root").select("fp", "component_id", "copies"))
    rows = label.agg(F.sum("copies")).first()[0] or 0
    # fingerprints with a 2000th of all rows each: 2000 at most, which are broadcast; the others have no hot key
    hot = F.broadcast(label.where(F.col("copies") * 2000 > rows).select("fp", "component_id"))
    rest = label.where(F.col("copies") * 2000 <= rows).select("fp", "component_id")
    return fps.join(hot, "fp").select("id", "fp", "component_id").unionByName(fps.join(rest, "fp").select("id", "fp", "component_id"))


# --- similarity of shingle sets --------------------------------------------


def _odd(n: int) -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """Keys of the bands of minimum hashes of a set."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    odd = _odd(BANDS * ROWS)
    for s in range(0, len(shingles), BLOCK):
        least = np.minimum(least, (shingles[None, s : s + BLOCK] * odd[:, None]).min(axis=1))
    least = (least ^ (least >> np.uint64(29))).reshape(BANDS, ROWS)
    key = np.zeros(BANDS, np.uint64)
    for k in range(ROWS):
        key = (key ^ least[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def _said(text_col: str) -> Column:
    """A text's name: nulls and empty texts share one."""
    return F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"))


def signatures(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, said, fp, n, keys) of every row: text name, fingerprint of the shingle set, its size, band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            fps, n, keys = [], [], []
            for t in blobs(b.column(2)):
                x = shingle_set(t, size)
                fps.append(_majority(iter([x])))
                n.append(len(x))
                keys.append(band_keys(x))
            flat = pa.array(np.concatenate([*keys, np.empty(0, np.int64)]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), flat)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(n, pa.int64()), lists], ["id", "said", "fp", "n", "keys"])

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), _said(text_col).alias("said"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "id bigint, said string, fp bigint, n bigint, keys array<bigint>")


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similarity: float = SIMILARITY, n_pivots: int = 32, hold: int = HOLD) -> DataFrame:
    """One row per distinct text: said (MD5 of the text), id (the smallest, nulls last) and root, the same for all texts that links reach.

    Two texts link when their sets of ``size``-word shingles have a Jaccard similarity of ``similarity`` or more;
    a text of fewer words is one shingle, and texts without words (nulls too) link with each other.  An empty table gives no row;
    other columns are ignored.  A group of any size is compared in blocks of ``hold`` shingles.
    """
    sig = persist(signatures(df, id_col, text_col, size))
    texts = sig.groupBy("said").agg(F.min("id").alias("id"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    texts = persist(texts.withColumn("node", F.monotonically_increasing_id()))
    keyed = texts.select("node", "fp", "n", F.posexplode("keys").alias("band", "key")).withColumn("band", F.col("band").cast("bigint"))
    maybe = components(bucket_links(keyed, ["key", "band"], n_pivots, WIDE, similarity, stars=True), stars=True)
    maybe = maybe.unionByName(maybe.select(F.col("root").alias("node"), "root").distinct())
    members = texts.select("node", "said", "id", "n").join(maybe, "node")
    edges = _verified(df, members, id_col, text_col, size, similarity, n_pivots, hold)
    roots = components(edges, stars=True)
    return texts.select("said", "id", "node").join(roots, "node", "left").select("said", "id", F.coalesce("root", "node").alias("root"))


class Alike:
    """Which of some sets have the similarity to one of them, exactly."""

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.sets, self.similarity, self.holders = sets, similarity, None
        self.sizes = np.array([len(x) for x in sets])

    def common(self, i: int) -> np.ndarray:
        """Members that each set shares with set ``i``, by who holds what."""
        if self.holders is None:
            flat = np.concatenate(self.sets)
            order = np.argsort(flat, kind="stable")
            owner = np.repeat(np.arange(len(self.sets)), self.sizes)[order]
            first = np.flatnonzero(np.concatenate([[True], np.diff(flat[order]) != 0]))
            self.holders = flat[order][first], first, np.append(first[1:], len(flat)), owner
        values, first, end, owner = self.holders
        at = np.searchsorted(values, self.sets[i])
        start, n = first[at], end[at] - first[at]
        places = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.bincount(owner[places], minlength=len(self.sets))

    def __call__(self, i: int, js: np.ndarray) -> np.ndarray:
        x, y = self.sizes[i], self.sizes[js]
        fit = np.minimum(x, y) >= self.similarity * np.maximum(x, y)
        if fit.sum() > 8:
            common = self.common(i)[js]
        else:
            common = np.zeros(len(js), np.int64)
            for k in np.flatnonzero(fit).tolist():
                common[k] = len(np.intersect1d(self.sets[i], self.sets[js[k]], assume_unique=True))
        return fit & (common >= self.similarity * (x + y - common))


def _blocks(members: DataFrame, hold: int) -> DataFrame:
    """``members`` (root, n, node ...) with ``block``: the ``hold`` of shingles in which a member starts, in its group's order of (n, node).

    Rows are range-partitioned, so a group of any size spreads over tasks; within a partition its sums run on from those of
    its rows in earlier partitions.  Only groups in several partitions have any, two for each partition at most.
    """
    from pyspark.sql import Window

    dealt = persist(members.repartitionByRange("root", "n", "node").withColumn("p", F.spark_partition_id()))
    sums = dealt.groupBy("root", "p").agg(F.sum("n").alias("s"))
    long = sums.groupBy("root").agg(F.count("*").alias("k")).where("k > 1").select("root")
    earlier = Window.partitionBy("root").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.join(long, "root", "left_semi").select("root", "p", F.sum("s").over(earlier).alias("before"))
    run_up = Window.partitionBy("root", "p").orderBy("n", "node")
    at = F.coalesce("before", F.lit(0)) + F.sum("n").over(run_up) - F.col("n")
    return dealt.join(F.broadcast(before), ["root", "p"], "left").withColumn("block", F.floor(at / hold)).drop("p", "before")


def _verified(df: DataFrame, members: DataFrame, id_col: str, text_col: str, size: int, similarity: float, n_pivots: int, hold: int) -> DataFrame:
    """Star edges (u, v) between texts of a candidate group that connect what all pairs of them that are similar by their shingle sets connect.

    A group goes by blocks of ``hold`` shingles in order of set size; every two blocks meet in one task.
    """
    cut = _blocks(members, hold)
    blocks = cut.groupBy("root", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    # blocks meet unless all sets of the one are too small for those of the other
    a, b = blocks.select("root", F.col("block").alias("i"), F.col("hi")), blocks.select("root", F.col("block").alias("j"), F.col("lo"))
    meet = a.join(b, "root").where((F.col("i") <= F.col("j")) & (F.col("hi") >= F.lit(similarity) * F.col("lo"))).select("root", "i", "j")
    goes = meet.select("root", F.col("i").alias("block"), "i", "j").unionByName(meet.where("i < j").select("root", F.col("j").alias("block"), "i", "j"))
    dealt = cut.join(goes, ["root", "block"]).select("root", "i", "j", "n", "node", "said", F.col("id").alias("rid"))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), _said(text_col).alias("name"), F.col(text_col).cast("string").alias("t"))
    whole = dealt.join(rows, (F.col("said") == F.col("name")) & F.col("rid").eqNullSafe(F.col("id"))).select("root", "i", "j", "n", "node", "t")
    refs = pivots(n_pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, nodes, sets = None, [], []

        def edges() -> pa.RecordBatch:
            fps = np.array([_majority(iter([x])) for x in sets], np.uint64)
            alike = Alike(sets, similarity)
            got = near_stars(fps, refs, WIDE, alike)
            return pa.record_batch([pa.array([nodes[p] for p, _ in got], pa.int64()), pa.array([nodes[q] for _, q in got], pa.int64())], ["u", "v"])

        for b in sliced(batches):
            keys = zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True)
            for (*key, node), t in zip(keys, blobs(b.column(5)), strict=True):
                if key != at:
                    if len(sets) > 1:
                        yield edges()
                    at, nodes, sets = key, [], []
                if not nodes or nodes[-1] != node:  # a repeated row has the same node
                    nodes.append(node)
                    sets.append(shingle_set(t, size))
        if len(sets) > 1:
            yield edges()

    meeting = whole.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "n", "node")
    return meeting.mapInArrow(lambda batches: contracted(run(batches)), "u bigint, v bigint")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` without near-duplicates by :func:`similar`: of each group the text with the smallest id stays.

    Of several texts of that id, the one with the smallest MD5; of repeated rows, one.  Rows without an id give way to rows with
    one.  All columns are kept with their values, whatever their names; an empty table stays empty.
    """
    groups_ = similar(df, id_col, text_col, size, similarity)
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "said")).alias("f")
    stay = groups_.groupBy("root").agg(first).select(F.col("f.id").alias("__stay_id"), F.col("f.said").alias("__stay_said"))
    clear, back = aside(df, ["__id", "__said", "__stay_id", "__stay_said"])
    rows = clear.withColumns({"__id": F.col(id_col).cast("bigint"), "__said": _said(text_col)})
    kept = rows.join(stay, F.col("__id").eqNullSafe(F.col("__stay_id")) & (F.col("__said") == F.col("__stay_said")), "left_semi")
    return back(kept.dropDuplicates(["__id", "__said"]).drop("__id", "__said"))
