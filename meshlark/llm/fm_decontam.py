"""Benchmark decontamination by FM-index.

Every task cuts its rows into shards, and indexes each shard's word sequence: suffix
array, Burrows-Wheeler transform, wavelet-matrix ranks and sampled suffix
positions.  All benchmark phrases are searched backwards at once; occurrences
are located by walking to a sampled position, and their spans merged per document.

The index alphabet is the phrases' own words; all others are one symbol that no
phrase holds.  A run of phrase words shorter than the shortest phrase can't hold
an occurrence and isn't indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alnum_words, blobs, byte_table

WINDOW = 10
#: Names of the columns that :func:`hits` adds.
ADDED = ("n_words", "spans", "n_hit", "items", "contaminated")
#: Words indexed together.
SHARD = 1 << 19
#: Every how many text positions the suffix array is kept.
SAMPLE = 8
#: Bytes of benchmark text searched in one pass over the documents.
BLOCK_BYTES = 8 << 20


class WaveletMatrix:
    """rank(c, i): how often c stands before position i."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones = bits, [], []
        for k in range(bits - 1, -1, -1):
            bit = ((seq >> k) & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(seq) - int(bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(i), i
        for level, k in enumerate(range(self.bits - 1, -1, -1)):
            ones, zeros = self.ones[level], self.zeros[level]
            one = ((c >> k) & 1).astype(bool)
            lo = np.where(one, zeros + ones[lo], lo - ones[lo])
            hi = np.where(one, zeros + ones[hi], hi - ones[hi])
        return hi - lo

    def symbol(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            one = (ones[i + 1] - ones[i]).astype(bool)
            out = (out << 1) | one
            i = np.where(one, zeros + ones[i], i - ones[i])
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Prefix doubling; ``seq`` ends in a unique smallest symbol."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        step = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = step
        if step[-1] == n - 1:
            return order
        k *= 2


class FMIndex:
    def __init__(self, seq: np.ndarray, alphabet: int):
        """``seq``: symbols from 1 up to ``alphabet`` - 1."""
        text = np.concatenate([seq, [0]]).astype(np.int64)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.n = len(text)
        self.wavelet = WaveletMatrix(bwt, max(1, int(alphabet - 1).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        kept = sa % SAMPLE == 0
        self.mark = np.concatenate([[0], np.cumsum(kept)])
        self.sampled = sa[kept]

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the rows of ``phrases`` (right-aligned, 0-padded to the left)."""
        m, width = phrases.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        for k in range(width - 1, -1, -1):
            live = live[(length[live] > width - 1 - k) & (hi[live] > lo[live])]
            if not len(live):
                break
            c = phrases[live, k]
            lo[live] = self.before[c] + self.wavelet.rank(c, lo[live])
            hi[live] = self.before[c] + self.wavelet.rank(c, hi[live])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        out, at, rows, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(at):
            done = (self.mark[rows + 1] - self.mark[rows]).astype(bool)
            out[at[done]] = self.sampled[self.mark[rows[done]]] + steps
            at, rows = at[~done], rows[~done]
            c = self.wavelet.symbol(rows)
            rows = self.before[c] + self.wavelet.rank(c, rows)
            steps += 1
        return out


class Phrases:
    """Windows of the benchmark items; equal windows of several items are one phrase."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        tab, found = byte_table(), {}
        self.ids = sorted({i for i, _ in items})
        place = {x: k for k, x in enumerate(self.ids)}
        for item, text in items:
            w = alnum_words(text, tab)
            for s in range(max(1, len(w) - window + 1) if w else 0):
                found.setdefault(tuple(w[s : s + window]), set()).add(place[item])
        keys = sorted(found)
        self.items = [sorted(found[k]) for k in keys]
        self.length = np.array([len(k) for k in keys], np.int64)
        self.shortest = int(self.length.min(initial=window))
        self.code = {x: k for k, x in enumerate(sorted({x for k in keys for x in k}), 2)}
        self.rows = np.zeros((len(keys), window), np.int64)
        for r, key in enumerate(keys):
            self.rows[r, window - len(key) :] = [self.code[x] for x in key]

    def plain(self) -> dict:
        """What a broadcast carries: no class of this package, which executors need not have."""
        return dict(self.__dict__)

    @classmethod
    def of(cls, plain: dict) -> Phrases:
        ph = cls.__new__(cls)
        ph.__dict__.update(plain)
        return ph


def shard_hits(docs: list[np.ndarray], ph: Phrases) -> tuple[list[np.ndarray], list[set[int]]]:
    """Per document (arrays of word codes, 0 for a word that no phrase has): merged spans, and items that occur."""
    spans, items = [np.empty((0, 2), np.int64)] * len(docs), [set() for _ in docs]
    seq, pos, own = [], [], []
    for d, w in enumerate(docs):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (w > 0).astype(np.int8), [0]])))
        s, e = edge[::2], edge[1::2]
        long = e - s >= ph.shortest
        for a, b in zip(s[long].tolist(), e[long].tolist(), strict=True):
            seq += [w[a:b], np.ones(1, w.dtype)]
            pos.append(np.arange(a, b + 1))
            own.append(np.full(b + 1 - a, d))
    if not seq:
        return spans, items
    index = FMIndex(np.concatenate(seq), len(ph.code) + 2)
    pos, own = np.concatenate(pos), np.concatenate(own)
    lo, hi = index.search(ph.rows, ph.length)
    hit = np.flatnonzero(hi > lo)
    if not len(hit):
        return spans, items
    n = hi[hit] - lo[hit]
    rows = np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    phrase = np.repeat(hit, n)
    at = index.locate(rows)
    doc, begin = own[at], pos[at]
    end = begin + ph.length[phrase]
    for d, p in np.unique(np.stack([doc, phrase], 1), axis=0).tolist():
        items[d].update(ph.items[p])
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    cut = np.concatenate([np.flatnonzero(np.diff(doc)) + 1, [len(doc)]])
    s = 0
    for e in cut.tolist():
        b, t = begin[s:e], np.maximum.accumulate(end[s:e])
        new = np.concatenate([[True], b[1:] > t[:-1]])
        first = np.flatnonzero(new)
        spans[doc[s]] = np.stack([b[first], t[np.concatenate([first[1:] - 1, [e - s - 1]])]], 1)
        s = e
    return spans, items


def together(spans: list[np.ndarray]) -> np.ndarray:
    """Spans of several searches of one document, merged."""
    spans = [x for x in spans if len(x)]
    if len(spans) < 2:
        return spans[0] if spans else np.empty((0, 2), np.int64)
    x = np.concatenate(spans)
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    ends = np.maximum.accumulate(x[:, 1])
    first = np.flatnonzero(np.concatenate([[True], x[1:, 0] > ends[:-1]]))
    return np.stack([x[first, 0], ends[np.append(first[1:] - 1, len(x) - 1)]], 1)


def _loaded(part) -> dict:  # noqa: ANN001
    """A broadcast's value, read anew from the worker's file so that it isn't kept."""
    path = getattr(part, "_path", None)
    return part.load_from_path(path) if path else part.value


def find(df: DataFrame, parts: list, text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """All columns of ``df`` with those of :data:`ADDED`.

    ``parts``: broadcasts of phrases, :meth:`Phrases.plain`.  A task has one of them in memory at a time.
    """
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab = byte_table()
        only = Phrases.of(parts[0].value) if len(parts) == 1 else None
        for b in batches:
            texts = blobs(b.column(at))
            n_words, spans, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
            for part in parts:
                ph = only or Phrases.of(_loaded(part))
                held, size, first = [], 0, 0
                for k, text in enumerate([*texts, None]):
                    if k == len(texts) or size >= shard:
                        for j, (s, i) in enumerate(zip(*shard_hits(held, ph), strict=True)):
                            spans[first + j].append(s)
                            items[first + j].update(ph.ids[x] for x in i)
                        held, size, first = [], 0, k
                    if k < len(texts):
                        w = alnum_words(text, tab)
                        n_words[k] = len(w)
                        held.append(np.fromiter((ph.code.get(x, 0) for x in w), np.int32, len(w)))
                        size += len(w)
            merged = [together(x) for x in spans]
            cols = [
                pa.array(n_words, pa.int64()),
                pa.array([x.tolist() for x in merged], pa.list_(pa.list_(pa.int64()))),
                pa.array([int((x[:, 1] - x[:, 0]).sum()) for x in merged], pa.int64()),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                pa.array([len(x) > 0 for x in merged], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *ADDED])

    kinds = [T.LongType(), T.ArrayType(T.ArrayType(T.LongType())), T.LongType(), T.ArrayType(T.StringType()), T.BooleanType()]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in zip(ADDED, kinds, strict=True))]))


def blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Phrases]:
    """The benchmark in parts of about ``block_bytes`` of text, streamed to the driver."""
    held, size = [], 0
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("string").cast("binary").alias("t"))
    for r in rows.toLocalIterator():
        held.append((r["i"], bytes(r["t"]) if r["t"] is not None else None))
        size += len(held[-1][1] or b"") + 64
        if size >= block_bytes:
            yield Phrases(held, window)
            held, size = [], 0
    yield Phrases(held, window)


def hits(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``df`` with n_words, spans (of words, merged), n_hit, items (ids as strings, sorted) and contaminated.

    A benchmark beyond ``block_bytes`` is broadcast in blocks, one at a time, and a task searches its rows for one block after
    the other, so what driver and tasks hold in memory stays bounded; only disk holds all blocks.  A null text has no words; an item
    without words occurs nowhere; a null item id reads as an empty string.  Texts of any length are searched whole.
    Repeated rows each give a row; an empty table, of documents or items, is no error.  A column of ``df`` with an added name, in any case, gives way.
    """
    df = df.select(*[c for c in df.columns if c.lower() not in ADDED or c == text_col])
    sc = df.sparkSession.sparkContext
    parts = []
    for ph in blocks(benchmark, item_col, item_text, window, block_bytes):
        parts.append(sc.broadcast(ph.plain()))
    return find(df, parts, text_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from those of :func:`hits`."""
    return found.select(F.col(id_col).cast("bigint").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
