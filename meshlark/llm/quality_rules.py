"""Quality rules as a learned decision list, in DataFrame expressions only.

Statistics are counted over every whole text.  Sequential covering on labelled
rows grows a conjunction of thresholds condition by condition (FOIL gain on a growing
set), prunes it backwards on a pruning set, takes the rows it covers away,
and goes on until a rule no longer pays.  The list becomes one ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS

#: Labelled rows that the driver fits on; its choice depends on ids alone.
FIT_ROWS = 20_000
#: A rule must be this precise on the pruning set.
PRECISION = 0.9
MIN_COVER = 5
MAX_RULES = 16
MAX_TERMS = 4


def repeats(words: Column) -> Column:
    """Words that stand in a 3-word window found twice or more in the text.

    Windows are compared by XXH64 of their words and sorted, so equal ones are neighbours.
    Every array is bound once through a one-element transform.
    """
    def windows(w: Column) -> Column:
        at = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
        return F.sort_array(F.transform(at, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        marked = F.transform(s, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def covered(d: Column) -> Column:
        gaps = F.transform(d, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(d, j + 1) - i, F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)

    bound = F.transform(F.array(words), windows)
    bound = F.transform(bound, twice)
    return F.transform(bound, covered)[0]


def statistics(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and the statistics of every row; a null text counts as an empty one."""
    keep = [] if keep is None else keep
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    first = df.select(*keep, text.alias("__t"), F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("__w"))
    t = F.col("__t")
    without = lambda chars: F.char_length(F.translate(t, chars, ""))
    size = F.char_length(t)
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.char_length(F.translate(x, WS, "")) > 0)
    dups = F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0]
    big = lambda c: c.cast("bigint")
    return first.select(
        *keep,
        big(F.size("__w")).alias("n_words"),
        big(without(WS)).alias("word_chars"),
        big(size - without("#*$%&|<>")).alias("n_symbols"),
        big(dups).alias("n_dup_lines"),
        repeats(F.col("__w")).alias("n_repeat_words"),
        big(size - without("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_upper"),
        big(size - without("!?")).alias("n_marks"),
        big(size - without("0123456789")).alias("n_digits"),
        big(size - without(".,;:")).alias("n_stops"),
    )


#: Features of the rules: name to (numerator, denominator) of statistics.
FEATURES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "word_chars"),
    "upper": ("n_upper", "word_chars"),
    "marks": ("n_marks", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "stops": ("n_stops", "n_words"),
    "dup_lines": ("n_dup_lines", "n_words"),
    "repeats": ("n_repeat_words", "n_words"),
}


def feature(name: str) -> Column:
    top, bottom = FEATURES[name]
    return F.col(top).cast("double") if bottom is None else F.col(top) / F.greatest(F.col(bottom), F.lit(1))


@dataclass(frozen=True)
class Term:
    name: str
    above: bool
    cut: float

    def column(self) -> Column:
        return feature(self.name) >= self.cut if self.above else feature(self.name) < self.cut

    def holds(self, row: dict[str, float]) -> bool:
        return (row[self.name] >= self.cut) == self.above


def _counts(rows: list[tuple[dict[str, float], bool]]) -> tuple[int, int]:
    bad = sum(y for _, y in rows)
    return bad, len(rows) - bad


def _grow(rows: list[tuple[dict[str, float], bool]]) -> list[Term]:
    rule: list[Term] = []
    while len(rule) < MAX_TERMS:
        p0, n0 = _counts(rows)
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        base = math.log2(p0 / (p0 + n0))
        for name in FEATURES:
            ranked = sorted((r[name], y) for r, y in rows)
            low_p = low_n = 0
            for k in range(1, len(ranked)):
                low_p, low_n = low_p + ranked[k - 1][1], low_n + (not ranked[k - 1][1])
                if ranked[k][0] == ranked[k - 1][0]:
                    continue
                cut = (ranked[k][0] + ranked[k - 1][0]) / 2
                for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                    if p + n >= MIN_COVER and p and (g := p * (math.log2(p / (p + n)) - base)) > gain:
                        best, gain = Term(name, above, cut), g
        if best is None:
            break
        rule.append(best)
        rows = [x for x in rows if best.holds(x[0])]
    return rule


def _worth(rule: list[Term], rows: list[tuple[dict[str, float], bool]]) -> float:
    p, n = _counts([x for x in rows if all(t.holds(x[0]) for t in rule)])
    return (p - n) / (p + n) if p + n else -1.0


def learn(rows: list[tuple[dict[str, float], bool]]) -> list[list[Term]]:
    """Rules for bad rows, in order.  ``rows``: features and whether the row is bad."""
    rules: list[list[Term]] = []
    while len(rules) < MAX_RULES:
        grow = [x for k, x in enumerate(rows) if k % 3]
        prune = [x for k, x in enumerate(rows) if not k % 3]
        rule = _grow(grow)
        while len(rule) > 1 and _worth(rule[:-1], prune) >= _worth(rule, prune):
            rule = rule[:-1]
        hit = [x for x in rows if all(t.holds(x[0]) for t in rule)]
        p, n = _counts([x for x in prune if all(t.holds(x[0]) for t in rule)])
        if not rule or len(hit) < MIN_COVER or not p or p < PRECISION * (p + n) or _counts(hit)[0] < PRECISION * len(hit):
            break
        rules.append(rule)
        rows = [x for x in rows if not all(t.holds(x[0]) for t in rule)]
    return rules


def verdict(rules: list[list[Term]]) -> Column:
    """The ordered conditional: false at the first rule that holds, else true."""
    case = None
    for rule in rules:
        cond = rule[0].column()
        for t in rule[1:]:
            cond = cond & t.column()
        case = F.when(cond, F.lit(False)) if case is None else case.when(cond, F.lit(False))
    return F.lit(True) if case is None else case.otherwise(F.lit(True))


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> list[list[Term]]:
    """Rules from at most ``fit_rows`` labelled ids, the first by XXH64 of the id.

    Rows without id or label teach nothing; of several labels of an id the smallest counts, of several texts of an id the one whose
    statistics come first in order, so equal tables give equal rules in whatever order their rows come.  A null text counts as an empty one;
    no labels or no documents give no rules.
    """
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("__id")).agg(F.min(label_col).alias("__y"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    some = df.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id")
    stats = statistics(some, "__text", ["__id", "__y"]).select("__id", "__y", F.struct(*[feature(n).cast("double").alias(n) for n in FEATURES]).alias("f"))
    seen = stats.groupBy("__id").agg(F.min("__y").alias("y"), F.min("f").alias("f")).collect()
    return learn([({n: r["f"][n] for n in FEATURES}, r["y"] == 0) for r in sorted(seen, key=lambda r: r["__id"])])


def judge(df: DataFrame, rules: list[list[Term]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, statistics, base_failed and kept of every row.

    A null or empty text has no words and so fails the base.  Texts of any length are counted whole.  Repeated rows each give a row, an empty
    table none; other columns, whatever their names, are ignored.
    """
    s = statistics(df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("__text")), "__text", ["doc_id"])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return s.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))
