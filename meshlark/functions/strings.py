"""Packed properties, id lists, file-name substitution and tag literals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def unpack(packed: Column) -> Column:
    """Strings packed with NUL between them."""
    return F.filter(F.split(packed, "\x00"), lambda s: s != "")


def append(packed: Column, value: Column) -> Column:
    """Adds a string to a packed one, once."""
    have = F.array_contains(unpack(F.coalesce(packed, F.lit(""))), value)
    return F.when(have, packed).otherwise(F.concat_ws("\x00", F.nullif(packed, F.lit("")), value))


def group_properties(name: Column, keywords: list[str], sep: str = "_") -> Column:
    """map<keyword, value> of a group name: a keyword's value runs up to the next keyword."""
    words = "|".join(map(re.escape, keywords))
    value = lambda k: F.regexp_extract(F.concat(name, F.lit(sep)), rf"(?:^|{sep}){re.escape(k)}(?:{sep}(.*?))?(?={sep}(?:{words})(?:{sep}|$)|{sep}$)", 1)
    has = lambda k: F.regexp_like(name, F.lit(rf"(?:^|{sep}){re.escape(k)}(?:{sep}|$)"))
    pairs = F.array(*[F.when(has(k), F.struct(F.lit(k).alias("k"), value(k).alias("v"))) for k in keywords])
    return F.map_from_entries(F.filter(pairs, lambda p: p.isNotNull()))


def id_list(text: str) -> list[int]:
    """"1-3,7" as numbers; ValueError for anything else."""
    out: list[int] = []
    for part in text.split(","):
        m = re.fullmatch(r"\s*(\d+)(?:\s*-\s*(\d+))?\s*", part)
        if not m or (m[2] and int(m[2]) < int(m[1])):
            raise ValueError(f"not an id list: {text!r}")
        out += range(int(m[1]), int(m[2] or m[1]) + 1)
    return out


def percent(name: str, rank: int) -> str:
    """% becomes the number, %% a percent sign."""
    return re.sub("%%|%", lambda m: "%" if m[0] == "%%" else str(rank), name)


def literal(text: str, kind: str) -> object:
    """A tag value as written on a command line."""
    if kind == "opaque":
        return bytes.fromhex(text[2:]) if text.startswith("0x") else text.encode()
    if kind == "bit":
        return int(text, 2) if re.fullmatch("[01]+", text) else int(text, 0)
    number = float if kind == "double" else lambda s: int(s, 0)
    parts = [number(p) for p in re.split(r"[,\s]+", text.strip())]
    return parts[0] if len(parts) == 1 else parts
