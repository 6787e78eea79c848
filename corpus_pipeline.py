"""A corpus pipeline of five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlark.llm import fm_decontam, lang_id, piece_codec, secret_battery, simhash
from meshlark.llm.common import aside, remainder, shared_folder, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which no language is recognised: null text, no letter, or nothing to learn from.

    Learns as the operator's query does, here from the rows of ``docs``.  Texts of any length are read whole; repeated
    rows all stay or go; an empty table stays empty; every column keeps its values, whatever its name.
    """
    learned = lang_id.profiles(docs.where(remainder("doc_id", 5) != 0))
    clear, back = aside(docs, ["lang_pred", "score"])
    return back(lang_id.predict(clear, learned, keep=True).where(F.col("lang_pred") != lang_id.UNKNOWN))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of 0.8 over five-word shingles, the document with the smallest id stays.

    Null and word-less texts are one group; of repeated rows one stays; ids that two unlike texts share are told apart by the text.
    Columns keep their values, whatever their names; an empty table stays empty.
    """
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark window.

    Null, empty and word-less texts hold none and stay, as do repeated rows; an empty table stays empty; columns keep their values, whatever their names.
    """
    clear, back = aside(docs, fm_decontam.ADDED)
    return back(fm_decontam.hits(clear, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret span; all documents stay, and n_chars follows the text.

    A null text stays null; repeated rows all stay; an empty table stays empty; other columns keep their values, whatever their names.
    """
    return secret_battery.mask(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as piece ids, with the other N best and all scores, and whether decoding gives the text back.

    Null and empty texts have no pieces; every row gives one, repeated ones too; other columns than doc_id, lang and source are left out.
    """
    d = piece_codec.encode(docs)
    return d.select("doc_id", "lang", "source", "n_pieces", "piece_ids", F.col("scores")[0].alias("best_score"), "ids_sha256", "round_trip", "scores", "other_ids")


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("pieces", pieces)]

#: SQL can't express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage has read is deleted once the next is written."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")  # noqa: SLF001
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)  # noqa: SLF001
    return docs
