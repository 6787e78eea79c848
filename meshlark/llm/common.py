"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and 0x09-0x0D.
WS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine (tests) takes a folder of its own; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="meshlark-ck-"))
    return sc.getCheckpointDir()


def persist(df: DataFrame) -> DataFrame:
    """Cut lineage by a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with the columns of these names (in any case) called otherwise, and what gives a result its old columns back, in order."""
    taken, clash = {c.lower() for c in df.columns}, {n.lower() for n in names}
    now, k = {}, 0
    for c in df.columns:
        now[c] = c
        while c.lower() in clash and now[c].lower() in taken | clash:
            now[c], k = f"__aside_{k}", k + 1
    clear = df.select(*[F.col(f"`{c}`").alias(now[c]) for c in df.columns])
    return clear, lambda out: out.select(*[F.col(f"`{now[c]}`").alias(c) for c in df.columns])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(col: str | object, mod: int):
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(c.cast("string").cast("binary")) % F.lit(mod)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that a worker has Python objects for few rows at once."""
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)


def blobs(col: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    if pa.types.is_large_string(col.type):
        return col.cast(pa.large_binary()).to_pylist()
    if pa.types.is_string(col.type):
        return col.cast(pa.binary()).to_pylist()
    return [None] * len(col)


def byte_table(keep_high: bool = True) -> bytes:
    """Lower-cases A-Z and turns every ASCII byte that is not a-z or 0-9 into a space."""
    t = bytearray(range(256))
    for i in range(128):
        c = chr(i).lower()
        t[i] = ord(c) if c.isalnum() else 32
    return bytes(t)


def alnum_words(b: bytes | None, tab: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text."""
    return b.translate(tab).split() if b else []
