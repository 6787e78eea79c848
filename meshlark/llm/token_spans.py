"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole; each token's byte span comes from the
lengths of the tokens before it, and its character span from those: all characters that it has a
byte of.  The character spans are interval-joined to the document's sections, which are its lines, or the
fields that it was put together from; both lists are in order, so the join is a merge.  A token across a boundary goes
to one section by an explicit rule:

- ``most`` (default): the section that holds most of its characters, the earlier on a tie;
- ``first``: the section that holds its first character.

So the sections' counts always add up to the document's.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Fixed value: the characters that the pattern's \\s stands for.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Runs of white space from this length on don't go through the pattern, whose matcher would run out of stack.
LONG = 5000
_LONG_RUN = re.compile(f"[{SPACES}]{{{LONG},}}")


def token_ids(enc, text: str) -> list[int]:  # noqa: ANN001
    """Ids of the whole text, as the vocabulary's pattern cuts it.

    Of a run of white space the pattern takes all but the last character as one chunk, or all at the end of the text: long runs are cut so here.
    """
    out, at = [], 0
    for m in _LONG_RUN.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += enc.encode_ordinary(text[at : m.start()])
        out += enc._encode_single_piece(text[m.start() : end].encode())  # noqa: SLF001
        at = end
    return out + enc.encode_ordinary(text[at:]) if at else enc.encode_ordinary(text)


def character_spans(text: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end) in characters of tokens of these byte lengths, and the character of every byte."""
    char = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1
    stop = np.cumsum(lengths)
    return char[stop - lengths], char[stop - 1] + 1, char


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def line_starts(text: bytes) -> np.ndarray:
    """Byte starts of the sections: lines, each with its \\n."""
    at = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.concatenate([[0], at[at < len(text)]]).astype(np.int64)


def attribute(begin: np.ndarray, end: np.ndarray, starts: np.ndarray, total: int, rule: str = "most") -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many cross a boundary.

    ``begin``, ``end``: character spans of the tokens, rising; ``starts``: section starts from 0, rising, sections
    without a character having the start of the next; ``total``: characters.  A token that spans several boundaries weighs all its parts.
    """
    counts = np.zeros(len(starts), np.int64)
    if not len(begin):
        return counts, 0
    first = np.searchsorted(starts, begin, "right") - 1
    last = np.searchsorted(starts, end - 1, "right") - 1
    home = first.copy()
    cross = np.flatnonzero(first != last)
    if rule == "most":
        stop = np.concatenate([starts[1:], [total]])
        for k in cross.tolist():
            s = np.arange(first[k], last[k] + 1)
            part = np.minimum(stop[s], end[k]) - np.maximum(starts[s], begin[k])
            home[k] = s[int(part.argmax())]
    elif rule != "first":
        raise ValueError(f"no such rule: {rule}")
    np.add.at(counts, home, 1)
    return counts, len(cross)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str = RANKS, rule: str = "most", fields: Sequence[str] | None = None) -> DataFrame:
    """doc_id, n_tokens, n_bytes, n_sections, n_crossing, section_tokens and section_starts (in characters, in order) of every row.

    Sections are the lines of ``text_col``, each with its newline.  With ``fields`` the document is these columns, joined by one newline that
    belongs to the field before it, and each field is a section (a null one is empty).  A null or empty text has no sections and no tokens.
    Texts and runs of any character of any length are encoded whole.  Repeated rows each give a row; an empty table none; other columns, whatever their
    names, are ignored.  The vocabulary file is read on the driver and broadcast.
    """
    bc = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        enc, size = None, None
        for b in batches:
            if enc is None:
                ranks = bc.value
                enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
                size = np.zeros(max(ranks.values()) + 1, np.int64)
                for tok, r in ranks.items():
                    size[r] = len(tok)
            rows = []
            for parts in zip(*(blobs(b.column(k)) for k in range(1, b.num_columns)), strict=True):
                t = b"\n".join([p or b"" for p in parts])
                if not t:
                    rows.append((0, 0, [], 0, []))
                    continue
                lengths = size[np.array(token_ids(enc, t.decode()), np.int64)]
                begin, end, char = character_spans(t, lengths)
                at = line_starts(t) if fields is None else np.concatenate([[0], np.cumsum([len(p or b"") + 1 for p in parts[:-1]])]).astype(np.int64)
                total = int(char[-1]) + 1
                starts = np.append(char, total)[np.minimum(at, len(t))]
                counts, cross = attribute(begin, end, starts, total, rule)
                rows.append((len(lengths), len(t), counts, cross, starts))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([len(r[2]) for r in rows], pa.int64()),
                    pa.array([r[3] for r in rows], pa.int64()),
                    pa.array([list(r[2]) for r in rows], pa.list_(pa.int64())),
                    pa.array([list(r[4]) for r in rows], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_tokens", "n_bytes", "n_sections", "n_crossing", "section_tokens", "section_starts"],
            )

    schema = "doc_id bigint, n_tokens bigint, n_bytes bigint, n_sections bigint, n_crossing bigint, section_tokens array<bigint>, section_starts array<bigint>"
    texts = [F.col(c).cast("string").alias(f"t{k}") for k, c in enumerate([text_col] if fields is None else fields)]
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), *texts).mapInArrow(run, schema)
