"""Corpus pipeline: language ID, near-dedup, PII, source mix, BPE encoding.

Each stage is one operator of ``colsense.llm`` over all that the stage before
kept.  All but the last give the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsense.llm import bpe, langid, minhash, mixing, pii
from colsense.llm.common import read_table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled rows, label every text; texts without a language
    (null, or no letter) go.  ``lang`` becomes the language found."""
    found = langid.predict(docs, langid.fit(docs), keep=COLUMNS)
    return found.where(F.col("lang_pred") != langid.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays: that with the group's
    id, the first of its rows."""
    return minhash.deduplicate(docs).select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in ``text`` becomes its kind in brackets; all rows stay."""
    masked = pii.redacted(pii.find(docs, keep=COLUMNS).drop("fixed"))
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix has it: not at all, once or twice."""
    mixed = mixing.mix(docs, keep=COLUMNS).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked against the text they give back."""
    out = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                            keep=("doc_id", "lang", "source", "text"))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                      F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("language ID", identify_language),
    ("near-dedup", drop_near_duplicates),
    ("PII", mask_personal_data),
    ("source mix", mix_sources),
    ("BPE", encode),
]

#: SQL has neither the profiles, the signatures nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
