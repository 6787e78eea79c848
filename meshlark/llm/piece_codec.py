"""Encoding and decoding with a SentencePiece vocabulary, by N-best segmentation.

A text is a lattice of pieces between character positions.  A forward Viterbi
pass gives the best score of every prefix; these are exact heuristics for an A-star
search backwards from the end, which so yields complete segmentations best first.
The search's first goal follows the best edges, which is done in numpy for all units of a
length at once; what else there is comes from the search's queue.

The vocabulary file is of merge type: its pieces have ranks and no probabilities.  Sums of ranks
would favour many small pieces, so a piece's score is its log-probability by Zipf's law,
1 / (rank + ``SHIFT``) over the sum of these; pieces that no merge makes come last.

Spaces become U+2581, one of which is put in front.  No piece has U+2581 after another
character, so the lattice falls apart into units (U+2581s and what follows them):
each is searched on its own, and a text's N best combine its units' lists.
Characters without a piece of their own are spelled in byte pieces, as is a U+2581 of
the text itself, so decoding gives back every text exactly.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import math
import re
import struct
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a U+2581 of the text; a lone surrogate is in no valid text.
LITERAL = "\udc81"
#: Units that a generation of a worker's memory has; the last full one is kept beside it, both in about 70 MB.
CACHE = 98_304
#: Longest unit that is remembered.
SHORT = 64
#: Added to a merge rank before Zipf's law gives its probability.
SHIFT = 300
#: Units of a length from which numpy handles them together; the results are the same either way.
TOGETHER = 4
_STEP = np.uint64(0x9E3779B97F4A7C15)


_first = itemgetter(0)


class Slots:
    """Piece numbers by a 64-bit hash of their characters: tables of falling size, each for what the ones before had no free slot for."""

    def __init__(self, pieces: list[str]):
        left = {}
        for k, p in enumerate(pieces):
            h = 0
            for c in p:
                h = (h * int(_STEP) + ord(c) + 1) % 2**64
            left[h] = k
        self.tables, bits = [], 18
        while left:
            keys, at, more = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), {}
            odd = (0xD6E8FEB86659FD93 + 2 * len(self.tables)) % 2**64
            for h, k in left.items():
                x = (h * odd % 2**64) >> (64 - bits)
                if at[x] < 0:
                    keys[x], at[x] = h, k
                else:
                    more[h] = k
            self.tables.append((np.uint64(odd), np.uint64(64 - bits), keys, at))
            left, bits = more, max(8, bits - 3)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 for none."""
        out = np.full(h.shape, -1, np.int32)
        for odd, shift, keys, at in self.tables:
            x = (h * odd) >> shift
            hit = np.nonzero(keys[x] == h)
            out[hit] = at[x[hit]]
        return out


class Codec:
    """Vocabulary and search; made by each worker from plain values (:meth:`plain`)."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], names: list[bytes], n: int = 3):
        self.pieces, self.byte_ids, self.names, self.n = pieces, byte_ids, names, n
        self.longest = max(map(len, pieces), default=1)
        self.byte_score = min((s for _, s in pieces.values()), default=0.0) - 10.0
        self.whole = any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.cache: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        # letter by letter: (what leads on, piece that ends here or None)
        self.trie: dict[str, list] = {}
        for p, (i, s) in pieces.items():
            kids, node = self.trie, None
            for c in p:
                node = kids.setdefault(c, [{}, None])
                kids = node[0]
            node[1] = ((i,), s)
        self.slots = Slots(list(pieces))
        # pieces, then ASCII characters in byte pieces, then none
        self.slot_ids = np.array([*[i for i, _ in pieces.values()], *byte_ids[:128], -1], np.int32)
        self.slot_scores = np.array([*[s for _, s in pieces.values()], *[self.byte_score] * 128, -math.inf])

    def plain(self) -> tuple:
        """What a broadcast carries, so that executors need no class of this package: ``Codec(*plain)`` is the same again."""
        return self.pieces, self.byte_ids, self.names, self.n

    @classmethod
    def load(cls, path: str = MODEL, n: int = 3) -> Codec:
        """Reads a model file; on the driver only."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ranks, byte_ids, names = {}, [0] * 256, []
        for i in range(m.get_piece_size()):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                byte_ids[int(p[3:5], 16)] = i
                names.append(bytes([int(p[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                names.append(b"")
            else:
                ranks[p] = (i, min(-m.get_score(i), float(m.get_piece_size())))
                names.append(p.replace(SPACE, " ").encode())
        whole = math.log(math.fsum(1 / (r + SHIFT) for _, r in ranks.values())) if ranks else 0.0
        return cls({p: (i, -math.log(r + SHIFT) - whole) for p, (i, r) in ranks.items()}, byte_ids, names, n)

    def spell(self, c: str) -> tuple[tuple[int, ...], float]:
        """(ids, score) of a character in byte pieces."""
        raw = (SPACE if c == LITERAL else c).encode()
        return tuple([self.byte_ids[b] for b in raw]), self.byte_score * len(raw)

    def edges(self, unit: str, i: int) -> list[tuple[int, tuple[int, ...], float]]:
        """(end, ids, score) of all that leads on from position i."""
        back = self.lattice(unit)[1]
        return [(j, *e[2]) for j in range(i + 1, len(unit) + 1) for e in back[j] if e[1] == i]

    def lattice(self, unit: str) -> tuple[list[float], list[list[tuple]]]:
        """Viterbi scores of all positions, and the edges (score with the best way there, start, (ids, own score)) into each."""
        size, pieces, trie, longest = len(unit), self.pieces, self.trie, self.longest
        best = [0.0] + [-math.inf] * size
        back: list[list[tuple]] = [[] for _ in range(size + 1)]
        for i in range(size):
            to_here = best[i]
            if unit[i] not in pieces:
                p = self.spell(unit[i])
                back[i + 1].append((to_here + p[1], i, p))
                if to_here + p[1] > best[i + 1]:
                    best[i + 1] = to_here + p[1]
            kids, j = trie, i
            for c in unit[i : i + longest]:
                node = kids.get(c)
                if node is None:
                    break
                kids, p = node
                j += 1
                if p is not None:
                    f = to_here + p[1]
                    back[j].append((f, i, p))
                    if f > best[j]:
                        best[j] = f
        return best, back

    def search(self, unit: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids), best first; equal scores in the order of discovery.

        A hypothesis is a segmentation of the unit's end from a position on; with the Viterbi score up to
        there it has the exact score of its best completion.  So the best edge backwards keeps a hypothesis best, and is
        followed at once; the others wait, and no more wait than can still be among the n best.
        """
        size, back = len(unit), self.lattice(unit)[1]
        done: list[tuple[float, tuple[int, ...]]] = []
        waiting: list[tuple] = []
        tick = 0
        j, g, tail = size, 0.0, None
        while True:
            room = n - len(done) - 1
            while j:
                edges = back[j]
                top = max(edges, key=_first) if len(edges) > 1 else edges[0]
                if room and len(edges) > 1:
                    for e in edges:
                        if e is not top and (len(waiting) < room or e[0] + g > -waiting[-1][0]):
                            tick += 1
                            bisect.insort(waiting, (-(e[0] + g), tick, e[1], g + e[2][1], (e[2][0], tail)))
                            del waiting[room:]
                p = top[2]
                g, tail, j = g + p[1], (p[0], tail), top[1]
            ids: list[int] = []
            while tail is not None:
                ids += tail[0]
                tail = tail[1]
            done.append((g, tuple(ids)))
            if len(done) == n or not waiting:
                return done
            _, _, j, g, tail = waiting.pop(0)

    def first(self, unit: str) -> tuple[bytes, float, float]:
        """The first goal of :meth:`search` (ids as int32, score), and by how much the best hypothesis then waiting scores less."""
        best, back = self.lattice(unit)
        out, j, loss = [], len(unit), math.inf
        while j:
            edges = back[j]
            top = edges[0]
            if len(edges) > 1:
                other = -math.inf
                for e in edges[1:]:
                    if e[0] > top[0]:
                        other, top = top[0], e
                    elif e[0] > other:
                        other = e[0]
                if top[0] - other < loss:
                    loss = top[0] - other
            j = top[1]
            out.append(top[2][0])
        ids = [i for p in reversed(out) for i in p]
        return struct.pack(f"<{len(ids)}i", *ids), best[-1], loss

    def firsts(self, units: list[str]) -> list[tuple[bytes, float, float]]:
        """:meth:`first` of many units of one length."""
        size, m = len(units[0]), len(units)
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(m, size).astype(np.uint64) + np.uint64(1)
        most = min(size, self.longest)
        found, score, h = [], [], np.zeros((m, size + 1), np.uint64)
        for n in range(1, most + 1):
            h = h[:, :-1] * _STEP + chars[:, n - 1 :]
            k = self.slots.find(h)
            if n == 1:
                k = np.where((k < 0) & (chars <= 128), len(self.pieces) - 1 + chars.astype(np.int64), k)
            found.append(k)
            score.append(self.slot_scores[k])
        spelled = np.argwhere(found[0] < 0)
        for u, i in spelled.tolist():
            score[0][u, i] = self.spell(units[u][i])[1]
        best, step, gap = np.zeros((m, size + 1)), np.zeros((m, size + 1), np.int64), np.full((m, size + 1), math.inf)
        every = np.arange(m)
        for j in range(1, size + 1):
            lengths = range(min(j, most), 0, -1)  # from the earliest start on, so equal scores go to the longest
            ways = np.stack([best[:, j - n] + score[n - 1][:, j - n] for n in lengths], 1)
            top = ways.argmax(axis=1)
            best[:, j] = ways[every, top]
            step[:, j] = min(j, most) - top
            ways[every, top] = -math.inf
            gap[:, j] = best[:, j] - ways.max(axis=1)
        loss, at, live, ids, took = np.full(m, math.inf), np.full(m, size), every, np.full((m, size), -1, np.int32), np.zeros(m, np.int64)
        odd = np.zeros(m, bool)
        while len(live):
            j = at[live]
            loss[live] = np.minimum(loss[live], gap[live, j])
            n = step[live, j]
            at[live] = i = j - n
            k = np.full(len(live), -1, np.int32)
            for x in np.unique(n).tolist():
                w = np.flatnonzero(n == x)
                k[w] = found[x - 1][live[w], i[w]]
            odd[live[k < 0]] = True
            ids[live, size - 1 - took[live]] = self.slot_ids[k]
            took[live] += 1
            live = live[i > 0]
        raw, ends = ids.astype("<i4").tobytes(), np.arange(1, m + 1) * size * 4
        starts = (ends - took * 4).tolist()
        out = []
        for u, (s, e, b, x, o) in enumerate(zip(starts, ends.tolist(), best[:, size].tolist(), loss.tolist(), odd.tolist(), strict=True)):
            out.append(self.first(units[u]) if o else (raw[s:e], b, x))
        return out

    def names_of(self, raw: bytes) -> bytes:
        names = self.names
        return b"".join([names[i] for i in struct.unpack(f"<{len(raw) // 4}i", raw)])

    def remember(self, u: str, rec: tuple[bytes, float, float]) -> None:
        if len(u) <= SHORT:
            if len(self.cache) >= CACHE:
                self.older, self.cache = self.cache, {}
            self.cache[u] = rec

    def unit(self, u: str) -> tuple[bytes, float, float]:
        """(ids as int32, best score, loss of the second best) of a unit."""
        rec = self.older.get(u)
        if rec is None:
            rec = self.first(u)
        self.remember(u, rec)
        return rec

    def prepare(self, texts: list[list[str]]) -> None:
        """Remembers the units of some texts, many of a length at once."""
        new = set().union(*texts) - self.cache.keys()
        by_length: dict[int, list[str]] = {}
        for u in new:
            rec = self.older.get(u)
            if rec is not None:
                self.remember(u, rec)
            elif len(u) <= SHORT:
                by_length.setdefault(len(u), []).append(u)
        for us in by_length.values():
            for s in range(0, len(us), 4096):
                part = us[s : s + 4096]
                if len(part) >= TOGETHER:
                    for u, rec in zip(part, self.firsts(part), strict=True):
                        self.remember(u, rec)

    def units(self, text: str) -> list[str]:
        """Pieces may not cross from one unit to the next."""
        s = SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)
        return [s] if self.whole else re.findall(f"{SPACE}+[^{SPACE}]*", s)

    def nbest(self, text: str, units: list[str] | None = None) -> tuple[list[np.ndarray], list[float], bool]:
        """Ids and scores of the N best segmentations, best first, fewer if the text has no more; and whether each decodes to the text."""
        if not text:
            return [np.empty(0, np.int32)], [0.0], True
        get, slow = self.cache.get, self.unit
        units = self.units(text) if units is None else units
        recs = [get(u) or slow(u) for u in units]
        raw, best, loss = zip(*recs, strict=True)
        top: list[tuple[float, tuple]] = [(sum(best), ())]  # score, and (unit, ids) where it leaves the best
        # only the units that lose least can differ from the best in one of the N best
        if self.n > 1:
            losses = np.array(loss)
            few = np.argpartition(losses, self.n - 2)[: self.n - 1] if len(losses) >= self.n else np.arange(len(losses))
            for k in sorted(few.tolist(), key=lambda k: (loss[k], k)):
                if loss[k] < math.inf:
                    (first, _), *more = self.search(units[k], self.n)
                    top += [(t - (first - s), (*c, (k, ids))) for t, c in top for s, ids in more]
                    top = heapq.nlargest(self.n, top, key=_first)
        whole = b"".join(raw)
        out = [np.frombuffer(whole, "<i4")]
        same = self.decode(out[0]) == text
        if not same:  # a string outside the vocabulary that has a piece's hash: letter by letter, without hashes
            for u in set(units):
                self.cache[u] = self.first(u)
            whole = b"".join([self.cache[u][0] for u in units])
            return ([np.frombuffer(whole, "<i4")], [sum(self.cache[u][1] for u in units)], False) if whole == b"".join(raw) else self.nbest(text, units)
        for _, changes in top[1:]:
            own = list(raw)
            for k, ids in changes:
                own[k] = struct.pack(f"<{len(ids)}i", *ids)
                same = same and self.names_of(own[k]) == self.names_of(raw[k])  # the rest is the best's
            out.append(np.frombuffer(b"".join(own), "<i4"))
        return out, [t for t, _ in top], same

    def encode(self, text: str) -> tuple[np.ndarray, list[float]]:
        """Ids of the best segmentation, and the scores of the N best."""
        found, top, _ = self.nbest(text)
        return found[0], top

    def decode(self, ids: np.ndarray) -> str:
        """Inverse of :meth:`encode`."""
        names = self.names
        raw = b"".join([names[i] for i in ids.tolist()])
        return raw[1:].decode() if raw[:1] == b" " else raw.decode()


def encode(df: DataFrame, text_col: str = "text", model_path: str = MODEL, n: int = 3) -> DataFrame:
    """All columns with piece_ids (array<int>), n_pieces, scores (the N best, best first), ids_sha256, round_trip, other_ids and other_sha256.

    other_ids and other_sha256: ids of the second best to the N-th, and their digests.
    round_trip: whether decoding the ids, those of all N, gives back the text.  Null and empty texts have no
    pieces, score 0, and come back as empty.  Texts of any length are encoded whole.  Repeated rows each give a row, an empty table none;
    a column with an added name, in any case, gives way.
    """
    added = ["piece_ids", "n_pieces", "scores", "ids_sha256", "round_trip", "other_ids", "other_sha256"]
    df = df.select(*[c for c in df.columns if c.lower() not in added or c == text_col])
    at = df.columns.index(text_col)
    bc = df.sparkSession.sparkContext.broadcast(Codec.load(model_path, n).plain())
    sha = lambda x: hashlib.sha256(x.astype("<i4").tobytes()).hexdigest()

    def lists(ids: list[np.ndarray]) -> pa.ListArray:
        off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*bc.value)
        for b in (whole.slice(s, 512) for whole in batches for s in range(0, whole.num_rows, 512)):
            ids, scores, digests, same, others, per_row, other_digests = [], [], [], [], [], [0], []
            texts = [t or "" for t in b.column(at).to_pylist()]
            split = [codec.units(t) if t else [] for t in texts]
            codec.prepare(split)
            for t, units in zip(texts, split, strict=True):
                (got, *more), top, back = codec.nbest(t, units)
                ids.append(got)
                scores.append(top)
                digests.append(sha(got))
                same.append(back)
                others += more
                per_row.append(len(others))
                other_digests.append([sha(x) for x in more])
            cols = [lists(ids), pa.array([len(x) for x in ids], pa.int64()), pa.array(scores, pa.list_(pa.float64())), pa.array(digests, pa.string()), pa.array(same, pa.bool_())]
            cols += [pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), lists(others)), pa.array(other_digests, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, *added])

    kinds = [T.ArrayType(T.IntegerType()), T.LongType(), T.ArrayType(T.DoubleType()), T.StringType(), T.BooleanType(), T.ArrayType(T.ArrayType(T.IntegerType())), T.ArrayType(T.StringType())]
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(a, k) for a, k in zip(added, kinds, strict=True))]))


def decode(df: DataFrame, ids_col: str = "piece_ids", model_path: str = MODEL) -> DataFrame:
    """All columns with ``decoded``; null ids give a null; a column of that name, in any case, gives way."""
    df = df.select(*[c for c in df.columns if c.lower() != "decoded"])
    at = df.columns.index(ids_col)
    bc = df.sparkSession.sparkContext.broadcast(Codec.load(model_path).plain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*bc.value)
        for b in batches:
            got = [None if x is None else codec.decode(np.array(x, np.int64)) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=[*b.schema.names, "decoded"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())]))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(F.col(id_col).cast("bigint").alias("doc_id"), "n_pieces", F.col("scores")[0].alias("best_score"), F.get("scores", F.lit(1)).alias("second_score"), "ids_sha256", "round_trip", F.array_join("other_sha256", ",").alias("other_sha256"))
