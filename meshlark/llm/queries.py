"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown_lm, fm_decontam, html_blocks, lang_id, license_scan, piece_codec, quality_rules, secret_battery, simhash, token_spans
from .common import table


def op1_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return d.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op3_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(table(spark, sf_dir, "documents"))


def op4_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fm_decontam.hits(docs, table(spark, sf_dir, "benchmark"))
    return fm_decontam.digest(found)


def op5_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


def op6_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digest(piece_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op7_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op8_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_battery.digest(secret_battery.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_offset_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = token_spans.count_tokens(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_tokens", "n_bytes", "n_sections", "n_crossing", F.array_join(F.transform("section_tokens", lambda n: n.cast("string")), ",").alias("section_tokens"))


def op10_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_pivots, op2_html_blocks, op3_brown_classes, op4_fm_decontamination, op5_license_templates, op6_piece_nbest, op7_decision_list, op8_randomness_battery, op9_offset_tokens, op10_rank_order)}


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "list_filter(regexp_split_to_array(" + _LOW + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

DECONTAMINATION = f"""
WITH doc AS (SELECT row_number() OVER () AS k, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
item AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
cut AS (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, w[s:s + 9] AS p, len(w[s:s + 9]) AS n FROM cut),
size AS (SELECT DISTINCT n FROM win),
place AS (SELECT k, n, unnest(range(1, len(w) - n + 2)) AS s, w FROM doc, size WHERE len(w) >= n),
hit AS (SELECT a.k, a.s, a.n, win.item_id FROM (SELECT k, s, n, w[s:s + n - 1] AS p FROM place) a JOIN win ON a.p = win.p),
words AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT k, unnest(range(s, s + n)) AS j FROM hit) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS said FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (k) LEFT JOIN items USING (k)
"""



def _license_sql() -> str:
    """Templates as regular expressions over the joined words, base phrases place by place."""
    words = _WORDS.format("text")
    place = " UNION ALL ".join(
        f"SELECT k, '{label}' AS label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(p.split()) - 1}] = {p.split()!r})) AS place FROM doc" for p, label in license_scan.PHRASES.items()
    )
    template = " UNION ALL ".join(f"SELECT k, '{label}' AS label FROM doc WHERE regexp_matches(joined, '{license_scan.as_pattern(text)}')" for label, text in license_scan.TEMPLATES.items())
    return f"""
WITH plain AS (SELECT row_number() OVER () AS k, doc_id, coalesce({words}, []) AS w FROM documents),
doc AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS joined FROM plain),
place AS ({place}),
base AS (SELECT k, count(*) AS n, min(place) - 1 AS first, max(place) - 1 AS last FROM place GROUP BY k),
own AS (SELECT DISTINCT k, label FROM place),
own_list AS (SELECT k, string_agg(label, ',' ORDER BY label) AS said FROM own GROUP BY k),
template AS ({template}),
every AS (SELECT k, string_agg(label, ',' ORDER BY label) AS said FROM (SELECT k, label FROM own UNION SELECT k, label FROM template) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(first AS BIGINT) AS first_word, CAST(last AS BIGINT) AS last_word,
       coalesce(own_list.said, '') AS base_labels, coalesce(every.said, '') AS labels,
       CAST(CASE WHEN k IN (SELECT k FROM template) THEN 1.0 WHEN n > 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score
FROM doc LEFT JOIN base USING (k) LEFT JOIN own_list USING (k) LEFT JOIN every USING (k)
"""


#: crc32 of an id as text, bit by bit: a byte goes in, then eight shifts (-1).
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({}::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
       lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END))"""

#: Ranked n-grams of one to three characters over letters with single spaces between and around, and their places' distance.
LANGUAGE = f"""
WITH doc AS (SELECT row_number() OVER () AS k, doc_id, lang, {_CRC.format("doc_id")} % 5 AS fold, text IS NOT NULL AS has,
             ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', ' ', 'g')) || ' ' AS t FROM documents),
pos AS (SELECT k, unnest(list_zip(c, c[2:], c[3:])) AS p FROM (SELECT k, string_split(t, '') AS c FROM doc WHERE t <> '  ')),
cut AS (SELECT k, p[1] AS g FROM pos UNION ALL SELECT k, p[1] || p[2] FROM pos WHERE p[2] IS NOT NULL UNION ALL SELECT k, p[1] || p[2] || p[3] FROM pos WHERE p[2] <> ' ' AND p[3] IS NOT NULL),
gram AS (SELECT k, g, count(*) AS n FROM cut WHERE g <> ' ' AND g <> '' GROUP BY k, g),
size AS (SELECT k, g, n, length(g) AS l FROM gram),
own AS (SELECT k, g, row_number() OVER (PARTITION BY k ORDER BY n DESC, l, g) - 1 AS r FROM size QUALIFY r < 400),
learnt AS (SELECT lang, g, sum(n) AS n FROM size JOIN doc USING (k) WHERE fold <> 0 AND lang IS NOT NULL AND doc.has GROUP BY lang, g),
profile AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(g), g) - 1 AS r FROM learnt QUALIFY r < 400),
far AS (SELECT k, langs.lang, count(*) AS m, sum(coalesce(abs(profile.r - own.r), 400)) AS d
        FROM own CROSS JOIN (SELECT DISTINCT lang FROM profile) langs LEFT JOIN profile ON profile.lang = langs.lang AND profile.g = own.g GROUP BY k, langs.lang),
best AS (SELECT k, lang, 1.0::DOUBLE - d::DOUBLE / (400 * m)::DOUBLE AS score FROM far QUALIFY row_number() OVER (PARTITION BY k ORDER BY d, lang) = 1)
SELECT doc_id, coalesce(fold = 0, false) AS held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(score, 0.0::DOUBLE) AS score FROM doc LEFT JOIN best USING (k)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_fm_decontamination": DECONTAMINATION, "op5_license_templates": _license_sql(), "op10_rank_order": LANGUAGE}
