"""Secret scans by a randomness test battery, in DataFrame expressions only.

Base kinds are fixed patterns.  The method adds spans: runs of at least
``MIN_LENGTH`` key characters are candidates; the narrowest of the hex, base-36
and base-64 alphabets that holds a candidate is its encoding.  Three tests ask
whether its characters look drawn at random from that alphabet:

- chi-squared uniformity over the alphabet's equal-sized blocks (16 from ``FINE`` characters on, else 8),
- Wald-Wolfowitz runs about the alphabet's middle,
- lag-1 serial correlation of the characters' values.

Fisher's method joins the three p-values into the probability that a random string looks no
better.  What is to be refuted is that a candidate is made of words, so its p-value is the share of
decoys that look as random.  Decoys are made here, ``DECOYS`` for each length band: words of a fixed
list, joined in the ways of identifiers, paths and prose.  Beyond the ``TAIL`` most random decoys of
a band an exponential in the logarithm carries their share on.  This calibration doesn't depend on the table.

Within a length band the candidates of the whole table then go by Benjamini and Hochberg's rule at ``ALPHA``:
the smallest cut counts at which (p-value of the cut) x (candidates) <= ``ALPHA`` x (candidates that reach it).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, fresh

# Patterns of the base kinds.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"

MIN_LENGTH = 20
CANDIDATE = r"[A-Za-z0-9+/_\-]{20,}"
#: Characters of a candidate, and names of the blocks of an alphabet.
KEY_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
BLOCKS = "ABCDEFGHIJKLMNOP"
#: Cuts of the joint p-value; a fixed grid, so that band counts stay small.
CUTS = [round(0.02 * k, 2) for k in range(1, 50)]
BANDS = [24, 32, 40, 64, 128]
#: Length from which uniformity is tested in 16 blocks.
FINE = 40
#: Longest decoy of the last band; longer candidates are told apart at least as well.
LONGEST = 144
ALPHA = 0.05
DECOYS, TAIL = 1000, 20
#: Words of the decoys.
WORDS = """the of and to in is that for it as was with on are by this be at from or have an they which one you were all her she there would their we him been
has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even
most made after also did many before must through back years where much your way well down should because each just those people how too little state good very make world still see own work
long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three
get set user name data index value file path list item type key map node text page view model config server client request response error test main util string array object number
information international understanding administration responsibility communication development representation organization university
der die und das ist nicht ein eine auch werden haben einer durch noch sind einem wird aber heit keit ung lich schaft
les des une est pour dans que qui sur pas avec tion ment eur eux aux elle ation el los las una por con para como ente idad cion""".split()


def spans_of(text: Column, pattern: str) -> Column:
    """array<struct<s,e,m>> of leftmost non-overlapping matches; code points, end exclusive.

    The gaps come from splitting at the pattern, so matches and gaps alternate.
    """
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # a match at the very start leaves a leading empty gap, as every pattern has width
    pairs = F.arrays_zip(gaps.alias("g"), found.alias("m"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        s = a["at"] + F.char_length(p["g"])
        e = s + F.char_length(p["m"])
        return F.when(p["m"].isNull(), a).otherwise(F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e"), p["m"].alias("m")))).alias("out")))

    return F.when(F.regexp_like(text, F.lit(pattern)), F.aggregate(pairs, zero, step, lambda a: a["out"])).otherwise(F.array().cast("array<struct<s:int,e:int,m:string>>"))


def normal_tail(z: Column) -> Column:
    """P(Z > z), by a logistic form that is within 0.0002."""
    return 1 / (1 + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), 1.5976 * z + 0.070566 * z * z * z))))


def chi2_tail(x: Column, k: Column) -> Column:
    """P(chi-squared with k degrees > x), Wilson-Hilferty."""
    return normal_tail((F.pow(x / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k)))


def worth(char: str, size: int) -> int:
    """Value of a key character in the alphabet of 16, 36 or 64."""
    o = ord(char)
    if size < 64:
        return o - (48 if o < 58 else 87 if o >= 97 else 55)
    return o - 65 if 65 <= o <= 90 else o - 71 if 97 <= o <= 122 else o + 4 if 48 <= o <= 57 else 62 if char in "+-" else 63


def spelled(token: Column, enc: Column, letter) -> Column:  # noqa: ANN001
    """The token with ``letter(value, size)`` for each character, by whole-string translation."""
    def by(size: int) -> Column:
        own = [c for c in KEY_CHARS if size == 64 or worth(c, size) < size and c.isalnum()]
        return F.translate(token, "".join(own), "".join(letter(worth(c, size), size) for c in own))

    return F.when(enc == 16, by(16)).when(enc == 36, by(36)).otherwise(by(64))


def battery(token: Column) -> Column:
    """struct<encoding, p> of a candidate; each array is bound once through a one-element transform.

    Blocks and runs are counted on translated strings; only the mean, the variance and the lag take a step a character.
    """
    enc = F.when(F.regexp_like(token, F.lit("^([0-9a-f]+|[0-9A-F]+)$")), F.lit(16)).when(F.regexp_like(token, F.lit("^([0-9a-z]+|[0-9A-Z]+)$")), F.lit(36)).otherwise(F.lit(64))
    block = lambda n: lambda x, size: BLOCKS[int(x // (size / n))]

    def value(c: Column, e: Column) -> Column:
        o = F.ascii(c)
        low = F.when(o < 58, o - 48).when(o >= 97, o - 87).otherwise(o - 55)
        wide = F.when((o >= 65) & (o <= 90), o - 65).when((o >= 97) & (o <= 122), o - 71).when((o >= 48) & (o <= 57), o + 4).when(o == 43, F.lit(62)).when(o == 45, F.lit(62)).otherwise(F.lit(63))
        return F.when(e < 64, low).otherwise(wide).cast("double")

    def times(s: Column, part: Column) -> Column:
        """Characters of ``s`` that occurrences of ``part`` take."""
        return (F.length(s) - F.length(F.replace(s, part, F.lit("")))).cast("double")

    def joint(y: Column) -> Column:
        v, mid, blocks, halves = y["v"], y["mid"], y["blocks"], y["halves"]
        n = F.size(v).cast("double")
        k = F.when(n >= FINE, F.lit(16.0)).otherwise(F.lit(8.0))
        cells = F.transform(F.sequence(F.lit(1), k.cast("int")), lambda j: times(blocks, F.substring(F.lit(BLOCKS), j, F.lit(1))))
        chi = F.aggregate(cells, F.lit(0.0), lambda a, c: a + F.pow(c - n / k, F.lit(2)) / (n / k))
        p1 = chi2_tail(F.greatest(chi, F.lit(1e-9)), k - 1)
        runs = 1.0 + times(halves, F.lit("HL")) / 2 + times(halves, F.lit("LH")) / 2
        high = times(halves, F.lit("H"))
        mean = 2 * high * (n - high) / n + 1
        var = (mean - 1) * (mean - 2) / F.greatest(n - 1, F.lit(1.0))
        p2 = F.when(var <= 0, F.lit(1e-6)).otherwise(2 * normal_tail(F.abs(runs - mean) / F.sqrt(F.greatest(var, F.lit(1e-9)))))
        ss = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.pow(x - mid, F.lit(2)))
        first = F.struct(F.lit(0.0).alias("r"), v[0].alias("last"))
        lag = F.aggregate(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), first, lambda a, x: F.struct((a["r"] + (x - mid) * (a["last"] - mid)).alias("r"), x.alias("last")), lambda a: a["r"])
        p3 = F.when(ss <= 0, F.lit(1e-6)).otherwise(2 * normal_tail(F.abs(lag / F.greatest(ss, F.lit(1e-9)) + 1 / n) * F.sqrt(n)))
        logs = [F.log(F.least(F.lit(1.0), F.greatest(p, F.lit(1e-12)))) for p in (p1, p2, p3)]
        return chi2_tail(F.greatest(-2 * (logs[0] + logs[1] + logs[2]), F.lit(1e-9)), F.lit(6.0))

    def looked(x: Column) -> Column:
        t, e = x["t"], x["e"]
        blocks = F.when(F.length(t) >= FINE, spelled(t, e, block(16))).otherwise(spelled(t, e, block(8)))
        halves = spelled(t, e, lambda x, size: "H" if x >= size / 2 else "L")
        v = F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: value(c, e))
        return F.struct(e.alias("e"), v.alias("v"), blocks.alias("blocks"), halves.alias("halves"))

    seen = F.transform(F.array(F.struct(token.alias("t"), enc.alias("e"))), looked)
    sums = F.transform(seen, lambda x: F.struct(x["e"].alias("e"), x["v"].alias("v"), x["blocks"].alias("blocks"), x["halves"].alias("halves"), (F.aggregate(x["v"], F.lit(0.0), lambda a, c: a + c) / F.size(x["v"])).alias("mid")))
    return F.transform(sums, lambda y: F.struct(y["e"].alias("encoding"), joint(y).alias("p")))[0]


def band_of(n: Column) -> Column:
    band = F.lit(len(BANDS))
    for k in range(len(BANDS) - 1, -1, -1):
        band = F.when(n < BANDS[k], F.lit(k)).otherwise(band)
    return band


def candidates(text: Column, base: Column) -> Column:
    """array<struct<s,e,p,band>> of a text's candidates: runs with a letter that overlap no base span."""
    def judge(x: Column) -> Column:
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), battery(x["m"])["p"].alias("p"), band_of(x["e"] - x["s"]).alias("band"))

    free = lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
    return F.transform(F.filter(spans_of(text, CANDIDATE), lambda x: F.regexp_like(x["m"], F.lit("[A-Za-z]")) & free(x)), judge)


def base_spans(text: Column) -> Column:
    """array<struct<s,k,e>> of the base kinds' matches, by start, then kind."""
    assign = F.filter(spans_of(text, ASSIGN), lambda x: F.char_length(F.regexp_replace(x["m"], F.lit(ASSIGN_HEAD), F.lit(""))) >= 8)
    access = F.filter(spans_of(text, ACCESS), lambda x: x["e"] - x["s"] >= 16)
    return F.array_sort(F.concat(_own(assign, 0), _own(access, 1), _own(spans_of(text, HEX), 2)))


def _own(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))


def decoys(spark: SparkSession) -> DataFrame:
    """(band, token): made-up strings of words, the same everywhere."""
    draw = lambda *keys: F.xxhash64(*[k if isinstance(k, Column) else F.lit(k) for k in keys])
    pick = lambda n, *keys: F.pmod(draw(*keys), F.lit(n)).cast("int")
    lows, highs = [MIN_LENGTH, *BANDS], [b - 1 for b in BANDS] + [LONGEST]
    rows = spark.range(DECOYS * len(lows)).select(F.pmod("id", F.lit(len(lows))).cast("int").alias("band"), F.col("id").alias("i"))
    low, high = F.array(*map(F.lit, lows)), F.array(*map(F.lit, highs))
    rows = rows.withColumn("n", F.element_at(low, F.col("band") + 1) + F.pmod(draw("i"), F.element_at(high, F.col("band") + 1) - F.element_at(low, F.col("band") + 1) + 1).cast("int"))
    rows = rows.withColumn("style", pick(8, F.col("i"), "style"))
    words = F.array(*map(F.lit, WORDS))

    def word(j: Column) -> Column:
        w = F.element_at(words, pick(len(WORDS), F.col("i"), j) + 1)
        number = pick(2100, F.col("i"), j, "number").cast("string")
        style = F.col("style")
        w = F.when(style.isin(3, 6), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 99))).when(style == 4, F.upper(w)).otherwise(w)
        return F.when((style >= 5) & (pick(4, F.col("i"), j, "often") == 0), number).otherwise(w)

    parts = F.transform(F.sequence(F.lit(0), F.floor(F.col("n") / 2).cast("int")), word)
    joint = F.when(F.col("style").isin(1, 4), F.lit("_")).when(F.col("style") == 2, F.lit("-")).when(F.col("style") == 7, F.lit("/")).otherwise(F.lit(""))
    token = F.expr("concat_ws(glue, parts)")
    return rows.select("band", "n", joint.alias("glue"), parts.alias("parts")).select("band", F.substring(token, F.lit(1), F.col("n")).alias("token"))


_calibrated: dict[tuple, dict] = {}


def calibration(spark: SparkSession) -> dict[int, tuple[list[int], float, float]]:
    """Band to (decoys that reach each cut, logarithm of p that ``TAIL`` decoys reach, mean excess over it); once for each driver process."""
    key = (DECOYS, TAIL, tuple(CUTS), tuple(BANDS))
    if key not in _calibrated:
        p = F.greatest(battery(F.col("token"))["p"], F.lit(1e-300))
        top = F.slice(F.sort_array(F.collect_list("x"), asc=False), 1, TAIL)
        reach = [F.count(F.when(F.col("p") >= c, 1)) for c in CUTS]
        rows = decoys(spark).where(F.regexp_like("token", F.lit("[A-Za-z]"))).select("band", p.alias("p")).withColumn("x", F.log("p"))
        got = rows.groupBy("band").agg(F.array(*reach).alias("reach"), top.alias("top")).collect()
        _calibrated[key] = {r["band"]: (list(r["reach"]), r["top"][-1], max(0.05, sum(x - r["top"][-1] for x in r["top"]) / len(r["top"]))) for r in got}
    return _calibrated[key]


def false_share(band: tuple[list[int], float, float], k: int) -> float:
    """Share of the decoys of a band that reach cut ``k``."""
    reach, least, excess = band
    x = math.log(CUTS[k])
    if x <= least:
        return (reach[k] + 1) / (DECOYS + 1)
    return TAIL / DECOYS * math.exp(-(x - least) / excess)


def cuts(cands: DataFrame) -> dict[int, float]:
    """Length band to the smallest admissible cut, from band counts over all candidates (bands x cuts rows at most)."""
    rows = cands.select(F.explode(F.col(cands.columns[0])).alias("c")).select("c.*")
    step = F.floor(F.col("p") * 50).cast("int")
    got = rows.groupBy("band", F.least(step, F.lit(49)).alias("k")).count().collect()
    known, found = calibration(cands.sparkSession) if got else {}, {}
    for band in range(len(BANDS) + 1):
        own = [(r["k"], r["count"]) for r in got if r["band"] == band]
        every = sum(n for _, n in own)
        for k, cut in enumerate(CUTS):
            hits = sum(n for j, n in own if j > k)
            if hits and false_share(known[band], k) * every <= ALPHA * hits:
                found[band] = cut
                break
    return found


def scan(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns with base (array<struct<kind,s,e>> by start, then kind) and spans (base and added, likewise).

    Null and empty texts: no spans.  A candidate that overlaps a base span adds none.  Texts of any length are scanned whole.  Repeated
    rows each give a row; an empty table gives none.  A column with one of the added names, in any case, gives way.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [c for c in df.columns if c.lower() not in {"base", "spans"} or c == text_col]
    base_col, cand_col, text_name = fresh(df, "__base"), fresh(df, "__cand"), fresh(df, "__plain")
    some = df.where(F.regexp_like(text, F.lit(CANDIDATE))).select(text.alias(text_name)).select(text_name, base_spans(F.col(text_name)).alias(base_col))
    cut = cuts(some.select(candidates(F.col(text_name), F.col(base_col)).alias(cand_col)))
    marked = df.select(*kept, text.alias(text_name), base_spans(text).alias(base_col))
    if cut:
        table = F.create_map(*[x for band, c in cut.items() for x in (F.lit(band), F.lit(c))])
        marked = marked.withColumn(cand_col, candidates(F.col(text_name), F.col(base_col)))
        added = _own(F.filter(cand_col, lambda x: x["p"] >= F.coalesce(table[x["band"]], F.lit(2.0))), 3)
    else:
        added = F.array().cast("array<struct<s:int,k:int,e:int>>")
    named = lambda arr: F.transform(arr, lambda x: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    return marked.select(*kept, named(F.col(base_col)).alias("base"), named(F.array_sort(F.concat(base_col, added))).alias("spans"))


def mask(df: DataFrame, text_col: str = "text", chars_col: str = "n_chars", by: str = "<secret>") -> DataFrame:
    """Same rows and columns; every span of :func:`scan` gives way to ``by``, and ``chars_col``, if there, counts anew where the text changed.

    Overlapping spans are masked as one.  Null and empty texts stay as they are, as do all other columns, whatever their names.
    Repeated rows all stay; an empty table stays empty.
    """
    clear, back = aside(df, ["base", "spans"])
    found = scan(clear, text_col)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    old = F.col(text_col)

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(old, a["at"] + 1, F.greatest(x["s"] - a["at"], F.lit(0)))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(x["s"] >= a["at"], F.concat(a["out"], gap, F.lit(by))).otherwise(a["out"]).alias("out"))

    masked = F.aggregate("spans", zero, step, lambda a: F.concat(a["out"], F.substring(old, a["at"] + 1, F.char_length(old))))
    changed = F.size("spans") > 0
    done = fresh(found, "__masked")
    found = found.withColumn(done, F.when(changed, masked).otherwise(old))
    out = {text_col: F.col(done)}
    if chars_col in df.columns:
        out[chars_col] = F.when(changed, F.char_length(done).cast(df.schema[chars_col].dataType)).otherwise(F.col(chars_col))
    return back(found.select(*[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in clear.columns]))


#: Kinds as listed; ``random`` are the added ones.
KINDS = ["assign", "access", "hex", "random"]


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from those of :func:`scan`."""
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    said = lambda arr: F.array_join(F.transform(arr, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")
    return found.select(F.col(id_col).cast("bigint").alias("doc_id"), n("assign"), n("access"), n("hex"), F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))
