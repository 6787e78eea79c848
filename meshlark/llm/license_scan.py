"""License scans by template-markup matching.

A template is wording with ``<<opt>> ... <</opt>>`` regions, which may be left out,
and ``<<var:N>>`` fields, which stand for up to N words of any kind.  Fields end, as they do in published template lists:
one without an end would take in all that lies between two licenses of a text.  A template is compiled
to an automaton over words; a stretch of a text is accepted when it runs from start to end,
so all mandatory words stand exactly and in order.  Matching starts at
every place of the template's first mandatory words; the state set moves word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, blobs, byte_table

#: Phrases of the base labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates by label; wording of published licenses and notices.
_DISCLAIMER = """this software is provided by <<var:60>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness
      for a particular purpose are disclaimed in no event shall <<var:60>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to
      procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort
      including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""
_SOURCE = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
      <<opt>>1<</opt>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
      <<opt>>2<</opt>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""
TEMPLATES = {
    "mit": """<<opt>>the mit license mit<</opt>> <<opt>>copyright <<opt>>c<</opt>> <<var:100>><</opt>> permission is hereby granted free of charge to any person obtaining a copy
      of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy
      modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
      the above copyright notice and this permission notice <<opt>>including the next paragraph<</opt>> shall be included in all copies or substantial portions of the software
      the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
      in no event shall <<var:60>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
    "isc": """<<opt>>isc license<</opt>> <<opt>>copyright <<opt>>c<</opt>> <<var:100>><</opt>> permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without fee is hereby granted
      provided that the above copyright notice and this permission notice appear in all copies
      <<opt>>the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
      in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract
      negligence or other tortious action arising out of or in connection with the use or performance of this software<</opt>>""",
    "0bsd": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
      the software is provided as is and the author disclaims all warranties with regard to this software""",
    "bsd": _SOURCE,
    "bsd-2-clause": f"{_SOURCE} {_DISCLAIMER}",
    "bsd-3-clause": f"""{_SOURCE} <<opt>>3<</opt>> neither the name of <<var:40>> nor the names of its contributors may be used to endorse or promote products derived from this software
      without specific prior written permission {_DISCLAIMER}""",
    "zlib": """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
      permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions
      <<opt>>1<</opt>> the origin of this software must not be misrepresented you must not claim that you wrote the original software
      if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required
      <<opt>>2<</opt>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software
      <<opt>>3<</opt>> this notice may not be removed or altered from any source distribution""",
    "bsl-1.0": """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software
      to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so""",
    "unlicense": """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form
      or as a compiled binary for any purpose commercial or non commercial and by any means""",
    "wtfpl": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "apache-2.0": """<<opt>>this <<opt>>work<</opt>> <<opt>>file<</opt>> <<opt>>software<</opt>> is<</opt>> licensed under the apache license version 2 <<opt>>0<</opt>>
      <<opt>>the license you may not use this file except in compliance with the license<</opt>>""",
    "apache-2.0-notice": """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<var:12>>
      unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
      see the license for the specific language governing permissions and limitations under the license""",
    "gpl-3.0": "<<opt>>this <<var:3>> is<</opt>> licensed under the <<opt>>terms of the<</opt>> gnu general public license <<opt>>gpl<</opt>> version 3 <<opt>>or <<opt>>at your option<</opt>> any later version<</opt>>",
    "gpl-2.0": "<<opt>>this <<var:3>> is<</opt>> licensed under the <<opt>>terms of the<</opt>> gnu general public license <<opt>>gpl<</opt>> version 2 <<opt>>or <<opt>>at your option<</opt>> any later version<</opt>>",
    "gpl-notice": "is free software you can redistribute it and or modify it under the terms of the gnu <<opt>>lesser<</opt>> <<opt>>affero<</opt>> general public license as published by the free software foundation",
    "lgpl-notice": "under the terms of the gnu lesser general public license as published by the free software foundation either version <<var:2>> of the license or at your option any later version",
    "agpl-notice": "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 <<opt>>if a copy of the mpl was not distributed with this file you can obtain one at <<var:8>><</opt>>",
    "epl-2.0": "this program and the accompanying materials are made available under the terms of the eclipse public license <<opt>>v<</opt>> 2 0",
    "cc0-1.0": "to the extent possible under law <<var:30>> has waived all copyright and related or neighboring rights to",
    "cc-by-nc": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> cc by nc <<opt>>sa<</opt>> <<opt>>nd<</opt>> <<opt>><<var:2>><</opt>>",
    "cc-by-sa": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> cc by sa <<opt>><<var:2>><</opt>>",
    "cc-by-any": "licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> creative commons attribution <<opt>>noncommercial<</opt>> <<opt>>sharealike<</opt>> <<opt>>noderivatives<</opt>> <<opt>>international<</opt>> license",
    "public-domain": "this is free and unencumbered software released into the public domain",
    "copyright": "copyright <<opt>>c<</opt>> <<var:100>> all rights reserved",
}


@dataclass
class Automaton:
    """States with word arcs, one any-word arc at most, and empty arcs, closed beforehand."""

    label: str
    anchor: bytes
    mandatory: int
    arcs: list[dict[bytes, int]] = field(default_factory=list)
    wild: list[int] = field(default_factory=list)
    closed: list[frozenset[int]] = field(default_factory=list)

    @property
    def final(self) -> int:
        return len(self.arcs) - 1


def compile_template(label: str, text: str) -> Automaton:
    """Raises ValueError for regions that don't match up or no mandatory word."""
    tokens = text.replace("<<", " <<").replace(">>", ">> ").split()
    arcs, wild, empty, open_at, depth_words = [{}], [-1], [set()], [], []

    def state() -> int:
        arcs.append({})
        wild.append(-1)
        empty.append(set())
        return len(arcs) - 1

    for tok in tokens:
        here = len(arcs) - 1
        if tok == "<<opt>>":
            open_at.append(here)
            state()
            empty[here].add(here + 1)
        elif tok == "<</opt>>":
            if not open_at:
                raise ValueError(f"{label}: a region is closed that isn't open")
            end = state()
            empty[here].add(end)
            empty[open_at.pop()].add(end)
        elif tok.startswith("<<var:"):
            fields = [here, *(state() for _ in range(int(tok[6:-2])))]
            end = state()
            for k, s in enumerate(fields):
                empty[s].add(end)
                if k + 1 < len(fields):
                    wild[s] = fields[k + 1]
        else:
            nxt = state()
            arcs[here][tok.encode()] = nxt
            depth_words.append((len(open_at), tok.encode()))
    if open_at:
        raise ValueError(f"{label}: a region isn't closed")
    closed = []
    for s in range(len(arcs)):
        seen, todo = set(), [s]
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo.extend(empty[x])
        closed.append(frozenset(seen))
    must = [w for d, w in depth_words if d == 0]
    if not must:
        raise ValueError(f"{label}: no mandatory word")
    # the longest run of mandatory words: a text without it can't be accepted
    best: list[bytes] = []
    run: list[bytes] = []
    depth = 0
    for tok in [*tokens, "<<opt>>"]:
        if tok.startswith("<<"):
            depth += (tok == "<<opt>>") - (tok == "<</opt>>")
            best, run = max(best, run, key=len), []
        elif depth == 0:
            run.append(tok.encode())
    return Automaton(label, b" " + b" ".join(best) + b" ", len(must), arcs, wild, closed)


def as_pattern(text: str) -> str:
    """A template as a regular expression over the space-framed words ``' a b '``: for SQL, which has no automata."""
    out = []
    for tok in text.replace("<<", " <<").replace(">>", ">> ").split():
        if tok == "<<opt>>":
            out.append("(?:")
        elif tok == "<</opt>>":
            out.append(")?")
        elif tok.startswith("<<var:"):
            out.append(f" (?:[^ ]+ ){{0,{int(tok[6:-2])}}}".replace(" (?:", "(?: ", 1).replace("[^ ]+ )", "[^ ]+)", 1))
        else:
            out.append(f" {tok}")
    return "".join(out) + " "


def accepts(a: Automaton, words: list[bytes], start: int) -> int:
    """End (exclusive) of the longest accepted stretch from ``start``; -1 for none."""
    states, end = a.closed[0], -1
    for k in range(start, len(words)):
        w, nxt = words[k], set()
        for s in states:
            if (t := a.arcs[s].get(w, -1)) >= 0:
                nxt |= a.closed[t]
            if a.wild[s] >= 0:
                nxt |= a.closed[a.wild[s]]
        if not nxt:
            break
        states = nxt
        if a.final in states:
            end = k + 1
    return end


def stretches(a: Automaton, words: list[bytes], joined: bytes) -> list[tuple[int, int]]:
    """Accepted stretches, leftmost and longest, none overlapping."""
    if a.anchor not in joined:
        return []
    first = {w for s in a.closed[0] for w in a.arcs[s]}
    any_first = any(a.wild[s] >= 0 for s in a.closed[0])
    out, k = [], 0
    while k < len(words):
        if any_first or words[k] in first:
            if (e := accepts(a, words, k)) > k:
                out.append((k, e))
                k = e
                continue
        k += 1
    return out


def base_places(joined: bytes, phrase: bytes) -> list[int]:
    """Word positions at which the phrase's words stand; ``joined`` is space-framed."""
    out, at, word, last = [], joined.find(phrase), 0, 0
    while at >= 0:
        word += joined.count(b" ", last, at)
        last = at
        out.append(word)
        at = joined.find(phrase, at + 1)
    return out


def scan_text(text: bytes | None, autos: list[Automaton], tab: bytes) -> tuple:
    words = alnum_words(text, tab)
    joined = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in PHRASES.items():
        if got := base_places(joined, b" " + phrase.encode() + b" "):
            places += got
            base.add(label)
    found, best = set(base), 0.5 if base else 0.0
    spans = []
    for a in autos:
        if got := stretches(a, words, joined):
            found.add(a.label)
            best = 1.0
            spans += [(a.label, s, e) for s, e in got]
    return len(words), places, sorted(base), sorted(found), best, sorted(spans, key=lambda x: (x[1], x[2], x[0]))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every row.

    ``spans`` has the accepted stretches as label, first word, end word.  Score: 1 for a text with an accepted
    template, 0.5 for one with a base phrase alone, else 0.  Null and empty texts: no words, no labels.  Texts of any length are scanned whole.
    Repeated rows each give a row, an empty table none; other columns, whatever their names, are ignored.
    """
    autos = [compile_template(k, v) for k, v in (TEMPLATES if templates is None else templates).items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tab = byte_table()
        for b in batches:
            got = [scan_text(t, autos, tab) for t in blobs(b.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([g[0] for g in got], pa.int64()),
                    pa.array([len(g[1]) for g in got], pa.int64()),
                    pa.array([min(g[1], default=None) for g in got], pa.int64()),
                    pa.array([max(g[1], default=None) for g in got], pa.int64()),
                    pa.array([",".join(g[2]) for g in got], pa.string()),
                    pa.array([",".join(g[3]) for g in got], pa.string()),
                    pa.array([g[4] for g in got], pa.float64()),
                    pa.array([[{"label": k, "s": s, "e": e} for k, s, e in g[5]] for g in got], pa.list_(pa.struct([("label", pa.string()), ("s", pa.int64()), ("e", pa.int64())]))),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,s:bigint,e:bigint>>"
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)
