"""Plain versions of the operators' contracts, one document at a time."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from math import log10

import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rem(i):
    return zlib.crc32(str(i).encode()) % 5


def fingerprint(text):
    w = WORDS.findall(low(text))
    if not w:
        return 0
    sh = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def simhash_components(rows):
    """rows: (id, text) -> list of (id, hex, component)."""
    fps = [fingerprint(t) for _, t in rows]
    seen = sorted(set(fps))
    parent = {f: f for f in seen}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(seen):
        for b in seen[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return [(i, f"{f:016x}", least.get(root(f))) for (i, _), f in zip(rows, fps)]


def shingles(text, size=5):
    w = WORDS.findall(low(text))
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) or frozenset([tuple(w)])


def similar_groups(texts, size=5, similarity=0.8):
    """text -> group, for distinct texts (null as empty)."""
    texts = sorted({t or "" for t in texts})
    sets, parent, holders = [shingles(t, size) for t in texts], list(range(len(texts))), {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in enumerate(sets):
        common = Counter(j for x in s for j in holders.get(x, ()))
        for j, n in common.items():
            if n >= similarity * (len(s) + len(sets[j]) - n):
                parent[root(k)] = root(j)
        for x in s:
            holders.setdefault(x, []).append(k)
    return {t: root(k) for k, t in enumerate(texts)}


def stay(rows):
    """(id, text) that stay: of each group the smallest id, then the smallest MD5."""
    group, best = similar_groups([t for _, t in rows]), {}
    for i, t in rows:
        key = (i is None, i or 0, hashlib.md5((t or "").encode()).hexdigest())
        g = group[t or ""]
        best[g] = min(best.get(g, key), key)
    return sorted(((k[1] if not k[0] else None), k[2]) for k in best.values())


def contamination(rows, items, window=10):
    wins = {}
    for i, t in items:
        w = ALNUM.findall(low(t))
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add("" if i is None else str(i))
    sizes = {len(k) for k in wins}
    out = []
    for i, t in rows:
        w = ALNUM.findall(low(t))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[p]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def license_base(text):
    w = ALNUM.findall(low(text))
    at, labels = [], set()
    for p, label in PHRASES.items():
        q = p.split()
        got = [k for k in range(len(w)) if w[k : k + len(q)] == q]
        at += got
        if got:
            labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def quality_base(text):
    text = text or ""
    w = WORDS.findall(text)
    win = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    rep = {j for k in range(len(w) - 2) if win[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(rep) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep), failed


ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secret_base(text):
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ["assign", "access", "hex"]
    found.sort(key=lambda x: (x[1], order.index(x[0])))
    n = Counter(k for k, _, _ in found)
    said = ",".join(f"{k}:{s}:{e}" for k, s, e in found)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(said.encode()).hexdigest(), [f"{k}:{s}:{e}" for k, s, e in found]


def unigram(rows):
    """rows: (id, text) -> (N, [(id, held, n, known, base)])."""
    c = Counter()
    toks = [[*WORDS.findall(low(t)), None] for _, t in rows]
    for (i, _), t in zip(rows, toks):
        if i is not None and rem(i) != 1:
            c.update(t)
    n, v = sum(c.values()), len(c)
    out = []
    for (i, _), t in zip(rows, toks):
        out.append((i, i is not None and rem(i) == 1, len(t), sum(c[x] > 0 for x in t), sum(log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t) if n else 0.0))
    return n, out


# --- randomness battery ----------------------------------------------------

CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{20,}")


def _tail(z):
    return 1 / (1 + math.exp(max(-700.0, min(700.0, 1.5976 * z + 0.070566 * z**3))))


def _chi(x, k):
    return _tail(((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k)))


def battery(token):
    """The joint p-value of a token, character by character."""
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", token):
        e = 16
    elif re.fullmatch("[0-9a-z]+|[0-9A-Z]+", token):
        e = 36
    else:
        e = 64
    wide = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    low = "0123456789abcdefghijklmnopqrstuvwxyz"
    v = [low.index(c.lower()) if e < 64 else wide.index(c) if c in wide else 62 if c in "+-" else 63 for c in token]
    n = len(v)
    b = 16 if n >= 40 else 8
    cells = Counter(int(x / (e / b)) for x in v)
    chi = sum((cells[k] - n / b) ** 2 / (n / b) for k in range(b))
    p1 = _chi(max(chi, 1e-9), b - 1)
    high = sum(x >= e / 2 for x in v)
    runs = 1 + sum((a >= e / 2) != (b >= e / 2) for a, b in zip(v, v[1:]))
    mean = 2 * high * (n - high) / n + 1
    var = (mean - 1) * (mean - 2) / max(n - 1, 1)
    p2 = 1e-6 if var <= 0 else 2 * _tail(abs(runs - mean) / math.sqrt(max(var, 1e-9)))
    mid = sum(v) / n
    ss = sum((x - mid) ** 2 for x in v)
    lag = sum((a - mid) * (b - mid) for a, b in zip(v, v[1:]))
    p3 = 1e-6 if ss <= 0 else 2 * _tail(abs(lag / max(ss, 1e-9) + 1 / n) * math.sqrt(n))
    return _chi(max(-2 * sum(math.log(min(1, max(p, 1e-12))) for p in (p1, p2, p3)), 1e-9), 6)


def random_spans(texts, bands, cuts, share, alpha):
    """Per text the added spans; ``share(band, cut number)`` is the decoys' part that reaches a cut."""
    found = []
    for t in texts:
        base = [tuple(map(int, x.split(":")[1:])) for x in secret_base(t)[4]]
        own = []
        for m in CANDIDATE.finditer(t or ""):
            s, e = m.span()
            if re.search("[A-Za-z]", m[0]) and not any(a < e and s < b for a, b in base):
                own.append((s, e, battery(m[0]), sum(e - s >= x for x in bands)))
        found.append(own)
    least = {}
    for band in {x[3] for own in found for x in own}:
        p = [x[2] for own in found for x in own if x[3] == band]
        for k, c in enumerate(cuts):
            hits = sum(x >= c for x in p)
            if hits and share(band, k) * len(p) <= alpha * hits:
                least[band] = c
                break
    return [[(s, e) for s, e, p, band in own if p >= least.get(band, 2)] for own in found]


def class_scores(rows, classes, count_of, smooth=5.0, n_classes=48):
    """rows: (id, text); classes: word -> class of the head words (others: 1, the end: 0) -> log10 probability of each text."""
    toks = [WORDS.findall(low(t)) for _, t in rows]
    c, pairs = Counter(), Counter()
    for (i, _), w in zip(rows, toks):
        if i is not None and rem(i) != 1:
            c.update(w)
            c[None] += 1
            k = [0, *(classes.get(x, 1) for x in w), 0]
            pairs.update(zip(k, k[1:]))
    past = sum(n + 0.5 for w, n in c.items() if w is not None and w not in classes) + 0.5
    mass = Counter({0: c[None], 1: past})
    for w, k in classes.items():
        mass[k] += c[w]
    whole, before = sum(mass.values()), Counter()
    for (a, _), n in pairs.items():
        before[a] += n
    out = []
    for w in toks:
        k = [0, *(classes.get(x, 1) for x in w), 0]
        total = 0.0
        for a, b in zip(k, k[1:]):
            total += log10((pairs[a, b] + smooth * mass[b] / whole) / (before[a] + smooth))
        for x in w:
            total += log10(c[x] / mass[classes[x]]) if x in classes else log10((c[x] + 0.5) / past)
        out.append(total)
    return out
