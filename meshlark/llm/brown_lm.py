"""Class-based n-gram scoring after Brown.

Words are assigned to classes in two steps.  Exchange clustering moves each of the ``TOP`` most frequent
words to the class that raises the likelihood of the class bigrams most, until none moves.  Every other word
of the ``HEAD`` most frequent ones, a bound on what is broadcast, then joins the class that its own counts of classes before
and after it, gathered from all training texts, make likeliest.  The end of a text has a class to itself, and so have all words
past the head, to which those seen once and the unknown ones belong: in that class each has the share of its own smoothed count, and what is
seen of words that occur once says when to expect a new one.

A text's probability multiplies, word by word, the smoothed class transition and the emission of the word by its class.
All counts come from all training rows; those of words past the head reach their documents by a join on the word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, persist, remainder

#: Words that have classes and whose counts are broadcast, at most.
HEAD = 1 << 17
TOP = 1000
CLASSES = 48
#: Classes of the end and of the words past the head.
END, PAST = 0, 1
#: Distinct words, or word and class pairs, that a task holds before it hands counts on.
HOLD = 300_000
#: Weight of the class unigram in a transition.
SMOOTH = 5.0


def word_counts(rows: DataFrame) -> DataFrame:
    """(w, n) over column t: words as bytes, the end of a text as the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["w", "n"])

        for b in batches:
            for t in blobs(b.column(0)):
                c.update((t or b"").lower().split())
                if len(c) > HOLD:
                    yield out()
                    c.clear()
            c[b""] += b.num_rows
        if c:
            yield out()

    return rows.mapInArrow(run, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


def head_words(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """Words (not the end) of the largest counts, ``most`` or fewer, and none that was seen once: all above a count that a histogram of log counts gives."""
    step = F.floor(F.log2("n") * 8).cast("int")
    words = counts.where((F.length("w") > 0) & (F.col("n") > 1))
    got = sorted(((r["k"], r["count"]) for r in words.groupBy(step.alias("k")).count().collect()), reverse=True)
    total, least = 0, None
    for k, n in got:
        if total + n > most:
            break
        total, least = total + n, k
    if least is None:
        return []
    rows = words.where(step >= least).collect()
    return sorted(((bytes(r["w"]), r["n"]) for r in rows), key=lambda x: (-x[1], x[0]))


@dataclass
class Model:
    """Head words with counts and classes, and log10 probabilities; ``past``: smoothed count of all words past the head."""

    n: int
    v: int
    head: dict[bytes, int] = field(default_factory=dict)
    count: np.ndarray = field(default_factory=lambda: np.empty(0))
    #: class of each head word, and last that of the words past the head
    classes: np.ndarray = field(default_factory=lambda: np.array([PAST]))
    move: np.ndarray = field(default_factory=lambda: np.zeros((CLASSES, CLASSES)))
    emit: np.ndarray = field(default_factory=lambda: np.zeros(1))
    past: float = 0.5


def places(words: list[bytes], head: dict[bytes, int]) -> np.ndarray:
    """Head positions of the words, -1 past the head."""
    return np.fromiter((head.get(w, -1) for w in words), np.int64, len(words))


def bigrams(rows: DataFrame, head: dict[bytes, int], kind: np.ndarray, kinds: int, end: int) -> np.ndarray:
    """Counts of neighbouring kinds over column t; ``kind``: that of each head word, last that of all others.  A text starts and ends with ``end``."""
    bc = rows.sparkSession.sparkContext.broadcast((head, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, kind = bc.value
        total, held, size = np.zeros(kinds * kinds, np.int64), [], 0

        def fold() -> None:
            nonlocal held, size
            if held:
                total.__iadd__(np.bincount(np.concatenate(held), minlength=kinds * kinds))
            held, size = [], 0

        edge = np.array([end])
        for b in batches:
            for t in blobs(b.column(0)):
                ids = np.concatenate([edge, kind[places((t or b"").lower().split(), head)], edge])
                held.append(ids[:-1] * kinds + ids[1:])
                size += len(ids)
                if size > 2_000_000:
                    fold()
        fold()
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["k", "n"])

    out = np.zeros(kinds * kinds, np.int64)
    for r in rows.mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["k"]] = r["n"]
    return out.reshape(kinds, kinds)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(b: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """Class of every item; the last two items, the others and the end, have classes ``PAST`` and ``END`` to themselves.

    Every move raises the likelihood, so it ends.
    """
    items = len(b)
    b = b.astype(np.float64)
    weight = b.sum(0) + b.sum(1)
    order = np.lexsort((np.arange(items - 2), -weight[:-2]))
    own = np.zeros(items, np.int64)
    own[order] = 2 + np.arange(items - 2) % (classes - 2)
    own[-2:] = PAST, END
    one = np.zeros((items, classes))
    one[np.arange(items), own] = 1
    right, left = b @ one, b.T @ one  # counts of an item before, after each class
    n = one.T @ right
    diag = np.arange(classes)
    moved = True
    while moved:
        moved = False
        for w in order:
            if not weight[w]:
                continue
            r, q, c, s = right[w].copy(), left[w].copy(), own[w], b[w, w]
            r[c] -= s
            q[c] -= s
            m = n.copy()
            m[c] -= r
            m[:, c] -= q
            m[c, c] -= s
            rows, cols = m.sum(1) + q, m.sum(0) + r  # what classes have besides the item, with the item as neighbour
            gain = (_f(m + r) - _f(m)).sum(1) + (_f(m + q[:, None]) - _f(m)).sum(0)
            d = m[diag, diag]
            gain += _f(d + r + q + s) - _f(d + r) - _f(d + q) + _f(d)
            gain -= _f(rows + r.sum() + s) - _f(rows) + _f(cols + q.sum() + s) - _f(cols)
            gain[[END, PAST]] = -np.inf
            k = int(gain.argmax())
            if gain[k] <= gain[c] + 1e-6:
                continue
            m[k] += r
            m[:, k] += q
            m[k, k] += s
            n = m
            right[:, c] -= b[:, w]
            right[:, k] += b[:, w]
            left[:, c] -= b[w]
            left[:, k] += b[w]
            own[w] = k
            moved = True
    return own


def likeliest(n: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The class that each word joins: rows of ``right`` and ``left`` count the classes after and before it, ``n`` is of all other words."""
    rows, cols = n.sum(1), n.sum(0)
    r, q = right[:, None, :], left[:, :, None]
    gain = (_f(n + r) - _f(n)).sum(2) + (_f(n + q) - _f(n)).sum(1)
    gain -= _f(rows + right.sum(1)[:, None]) - _f(rows) + _f(cols + left.sum(1)[:, None]) - _f(cols)
    gain[:, [END, PAST]] = -np.inf
    return gain.argmax(1)


def join_classes(rows: DataFrame, head: dict[bytes, int], classes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Classes of the head words past ``TOP`` by their neighbours' classes over column t; at most ``HEAD`` rows come back."""
    bc = rows.sparkSession.sparkContext.broadcast((head, classes, n))
    both = 2 * CLASSES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, classes, _ = bc.value
        edge, held, size = np.array([END]), [], 0

        def folded() -> tuple[np.ndarray, np.ndarray]:
            code, inv = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            return code, np.bincount(inv, np.concatenate([x for _, x in held])).astype(np.uint32)

        def out() -> Iterator[pa.RecordBatch]:
            code, times = folded()
            word = code // both
            start = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
            ends = np.append(start[1:], len(code))
            side, times = (code % both).astype(np.uint8), times.astype("<u4")
            for s in range(0, len(start), 20_000):
                packed = [side[x:y].tobytes() + times[x:y].tobytes() for x, y in zip(start[s : s + 20_000].tolist(), ends[s : s + 20_000].tolist(), strict=True)]
                yield pa.record_batch([pa.array(word[start[s : s + 20_000]]), pa.array(packed, pa.binary())], ["k", "c"])

        for b in batches:
            for t in blobs(b.column(0)):
                at = places((t or b"").lower().split(), head)
                seq = np.concatenate([edge, classes[at], edge])
                own = np.flatnonzero(at >= TOP)
                base = at[own] * both
                held.append((np.concatenate([base + seq[own + 2], base + CLASSES + seq[own]]), np.ones(2 * len(own), np.uint32)))
                size += 2 * len(own)
                if size > 10 * HOLD:
                    held = [folded()]
                    size = len(held[0][0])
                    if size > 5 * HOLD:
                        yield from out()
                        held, size = [], 0
        if size:
            yield from out()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, word, sums = bc.value[2], [], []

        def out() -> pa.RecordBatch:
            x = np.array(sums)
            got = likeliest(n, x[:, :CLASSES], x[:, CLASSES:])
            return pa.record_batch([pa.array(word, pa.int64()), pa.array(got.astype(np.int64))], ["k", "c"])

        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not word or word[-1] != k:
                    if len(word) >= 256:
                        yield out()
                        word, sums = [], []
                    word.append(k)
                    sums.append(np.zeros(both))
                m = len(c) // 5
                sums[-1][np.frombuffer(c, np.uint8, m)] += np.frombuffer(c, "<u4", m, m)
        if word:
            yield out()

    found = classes.copy()
    parts = rows.mapInArrow(count, "k bigint, c binary").repartition("k").sortWithinPartitions("k")
    for r in parts.mapInArrow(choose, "k bigint, c bigint").collect():
        found[r["k"]] = r["c"]
    return found


def train(rows: DataFrame, counts: DataFrame, head: int = HEAD) -> Model:
    """``rows``: training texts as column t; ``counts``: their :func:`word_counts`."""
    whole = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.length("w") == 0, F.col("n"))).alias("ends")).first()
    model = Model(whole["n"] or 0, whole["v"])
    if not model.n:
        return model
    words = head_words(counts, head)
    model.head = {w: k for k, (w, _) in enumerate(words)}
    model.count = np.array([n for _, n in words], np.float64)
    top = min(TOP, len(words))
    kind = np.append(np.minimum(np.arange(len(words)), top), top)
    b = bigrams(rows, model.head, kind, top + 2, top + 1)
    own = exchange(b)
    one = np.zeros((len(b), CLASSES))
    one[np.arange(len(b)), own] = 1
    seeds = np.append(np.where(np.arange(len(words)) < top, own[np.minimum(np.arange(len(words)), top)], PAST), PAST)
    model.classes = join_classes(rows, model.head, seeds, one.T @ b @ one) if len(words) > top else seeds
    n = bigrams(rows, model.head, model.classes, CLASSES, END).astype(np.float64)
    past_words = model.v - len(words) - 1
    model.past = model.n - model.count.sum() - whole["ends"] + 0.5 * (past_words + 1)
    mass = np.bincount(model.classes[:-1], model.count, CLASSES)
    mass[END], mass[PAST] = whole["ends"], model.past
    model.move = np.log10(np.maximum((n + SMOOTH * mass / mass.sum()) / (n.sum(1, keepdims=True) + SMOOTH), 1e-300))
    model.emit = np.append(np.log10(model.count / mass[model.classes[:-1]]), -math.log10(model.past))
    return model


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 1, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Learns from rows whose crc32(id as text) mod ``folds`` is not ``held``; a row with a null id
    is neither learned from nor held out.  A null text is empty: its only token is the end.  With nothing
    to learn from both scores are 0.  Texts of any length are read whole.  Repeated rows each count and give a row; an empty table gives none;
    other columns, whatever their names, are ignored.
    """
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = docs.where(remainder("id", folds) != held).select("t")
    counts = persist(word_counts(rows))
    model = train(rows, counts, head)
    ends = (counts.where(F.length("w") == 0).select("n").first() or [0])[0]
    bc = df.sparkSession.sparkContext.broadcast((model.n, model.v, model.head, model.count, model.classes, model.move, model.emit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_train, v, head, count, classes, move, emit = bc.value
        base_of_all = math.log10(n_train + 0.5 * (v + 1))
        logs = np.append(np.log10(count + 0.5), 0.0)
        edge = np.array([END])
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            for i, t in zip(b.column(0).to_pylist(), blobs(b.column(1)), strict=True):
                key = xxhash.xxh64_intdigest(t or b"") - (1 << 63)
                words = (t or b"").lower().split()
                n = len(words) + 1
                tail: Counter[bytes] = Counter()
                base, total, known = 0.0, 0.0, 0
                if n_train:
                    at = places(words, head)
                    far = np.flatnonzero(at < 0)
                    tail = Counter([words[k] for k in far.tolist()])
                    base = float(logs[at].sum()) + math.log10(ends + 0.5) - n * base_of_all
                    seq = np.concatenate([edge, classes[at], edge])
                    total = float(move[seq[:-1], seq[1:]].sum()) + float(emit[at].sum())
                    known = n - len(far)
                first = tail.popitem() if tail else (b" %d" % (key & 0xFFFF), 0)  # no word: spread, and joined to nothing
                for k, (w, c) in enumerate([first, *tail.items()]):
                    for col, x in zip(cols, (key, i, n, known, base, total, w, c) if not k else (key, i, None, None, None, None, w, c), strict=True):
                        col.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["key", "id", "n", "known", "base", "total", "w", "c"])

    parts = docs.mapInArrow(run, "key bigint, id bigint, n bigint, known bigint, base double, total double, w binary, c bigint")
    joined = parts.join(counts.select(F.col("w").alias("cw"), F.col("n").alias("cn")), F.col("w") == F.col("cw"), "left")
    log = F.col("c") * F.log10(F.coalesce("cn", F.lit(0)) + 0.5)
    # rows are told apart by id and text, not by where they stand, so a task that runs again gives the same; repeated rows come out as often as they went in
    out = joined.groupBy("key", "id").agg(
        F.count("n").alias("copies"), F.max("n").alias("n_tokens"), F.max("known").alias("near"), F.sum(F.when(F.col("cn").isNotNull(), F.col("c")).otherwise(0)).alias("also"),
        F.sum(log).alias("far"), F.max("base").alias("base"), F.max("total").alias("total"),
    )
    far = F.col("far") / F.col("copies") if model.n else F.lit(0.0)
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    return out.select(
        F.col("id").alias("doc_id"),
        F.coalesce(remainder("id", folds) == held, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("near") + F.floor(F.col("also") / F.col("copies"))).cast("bigint").alias("n_known"),
        F.lit(model.n).cast("bigint").alias("train_tokens"),
        (F.col("base") + far).alias("base_score"),
        (F.col("total") + far).alias("score"),
    )
