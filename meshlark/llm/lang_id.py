"""Language identification by rank-order profiles.

A language's profile is the ranked list of its most frequent character n-grams
(n = 1, 2, 3, words padded by one space) over all training texts.  A document's
own ranked list is compared to each by the out-of-place distance: the sum over
its n-grams of how far their ranks lie apart, ``profile_size`` for one that the
profile lacks.  The nearest language wins, ties going to the smaller name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import remainder, sliced

PROFILE = 400
#: Code points of a text handled at once.
CHUNK = 1 << 20
#: Distinct n-grams a task holds before it hands counts on.
HOLD = 400_000
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """Code point to itself for letters, else to a space."""
    t = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            t[c] = c
    return t


def gram_codes(text: str, letters: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(n-gram code, count) arrays for each chunk of the text; codes hold 21 bits a character."""
    if not text:
        return []
    cp = letters[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    gap = cp == 32
    keep = np.ones(len(cp), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    cp = cp[keep]
    if not (cp != 32).any():
        return []
    edge = np.array([32], np.uint32)
    cp = np.concatenate([edge[: int(cp[0] != 32)], cp, edge[: int(cp[-1] != 32)]]).astype(np.uint64)
    out = []
    for s in range(0, len(cp), CHUNK):
        a = cp[s : s + CHUNK]
        b, c = cp[s + 1 : s + 1 + len(a)], cp[s + 2 : s + 2 + len(a)]
        two = (a[: len(b)] << np.uint64(21)) | b
        three = (two[: len(c)] << np.uint64(21)) | c
        codes = np.concatenate([a[a != 32], two, three[b[: len(c)] != 32]])
        out.append(np.unique(codes, return_counts=True))
    return out


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    codes, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(inv, np.concatenate([p[1] for p in parts])).astype(np.int64)


def ranked(codes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Codes of the most frequent n-grams, ties by code."""
    if len(codes) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:size]


def profiles(df: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> dict[str, list[int]]:
    """Language to ranked n-gram codes, counted over all rows with a text and a language.

    ``size`` times the number of languages rows reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, held, n = letter_table(), {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, counts = merged(parts)
                yield pa.record_batch([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])

        for b in sliced(batches):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for part in gram_codes(text, letters):
                    held.setdefault(lang, []).append(part)
                    n += len(part[0])
                if n > HOLD:
                    held = {k: [merged(v)] for k, v in held.items()}
                    n = sum(len(v[0][0]) for v in held.values())
                    if n > HOLD // 2:
                        yield from out()
                        held, n = {}, 0
        yield from out()

    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"))
    total = rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= size).orderBy("lang", "rank").collect()
    found: dict[str, list[int]] = {}
    for r in top:
        found.setdefault(r["lang"], []).append(r["gram"])
    return found


def predict(df: DataFrame, learned: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE, keep: bool = False) -> DataFrame:
    """Adds lang_pred and score to the id, or to all columns with ``keep``.

    ``und`` with score 0 for a null text, one without a letter, or no profiles at
    all.  Score: one minus the winner's distance as a part of the largest possible.
    """
    langs = sorted(learned)
    union = np.unique(np.array([g for p in learned.values() for g in p], np.int64))
    ranks = np.full((len(union) + 1, len(langs)), size, np.int64)
    for k, lang in enumerate(langs):
        ranks[np.searchsorted(union, np.array(learned[lang], np.int64)), k] = np.arange(len(learned[lang]))

    def best(text: str | None, letters: np.ndarray) -> tuple[str, float]:
        parts = gram_codes(text or "", letters)
        if not parts or not langs:
            return UNKNOWN, 0.0
        own = ranked(*merged(parts), size).view(np.int64)
        at = np.searchsorted(union, own)
        at[at == len(union)] = 0
        at = np.where(union[at] == own, at, len(union))
        known = at < len(union)
        gone = np.abs(ranks[at] - np.arange(len(own))[:, None])
        gone[~known] = size
        gone[ranks[at] == size] = size
        dist = gone.sum(axis=0)
        k = int(dist.argmin())
        return langs[k], 1.0 - float(dist[k]) / (size * len(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for b in sliced(batches):
            got = [best(t, letters) for t in b.column(at_text).to_pylist()]
            cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            first = list(b.columns) if keep else [b.column(0)]
            names = list(b.schema.names) if keep else ["doc_id"]
            yield pa.RecordBatch.from_arrays(first + cols, names=[*names, "lang_pred", "score"])

    from pyspark.sql import types as T

    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if keep:
        df = df.select(*[c for c in df.columns if c not in {"lang_pred", "score"} - {text_col}])
        at_text = df.columns.index(text_col)
        return df.mapInArrow(run, T.StructType([*df.schema.fields, *more]))
    at_text = 1
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), *more]))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 5, size: int = PROFILE, keep: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    Learns from rows whose crc32(id as text) mod ``folds`` is not 0; a row with a
    null id is neither learned from nor held out.  Repeated rows each count and
    give a row; an empty table gives none.
    """
    learned = profiles(df.where(remainder(id_col, folds) != 0), text_col, lang_col, size)
    out = predict(df, learned, id_col, text_col, size, keep)
    if keep:
        return out
    return out.select("doc_id", F.coalesce(remainder("doc_id", folds) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
