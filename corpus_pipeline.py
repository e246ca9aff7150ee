"""Corpus pipeline: language, exact copies, near copies, mix, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from brindle.llm import exact_dedup, language_id, near_dedup, sentencepiece_bpe, source_mix
from brindle.llm.runtime import materialize

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, and those far from every language.

    Null and empty texts have no letter; repeated rows are judged each for
    itself; an empty table stays empty, one without labels keeps all letters.
    """
    return language_id.keep_identified(spark, docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, one row stays.

    The longest, then the smallest doc_id (null last), then the first of fully
    equal rows; null and empty texts are equal; an empty table stays empty.
    """
    return exact_dedup.keep_one(spark, docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest doc_id stays.

    Texts without words are copies of nothing and stay; null doc_ids come last;
    of equal rows one stays; an empty table stays empty.
    """
    return near_dedup.keep_one(spark, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them, the same in every run.

    Rows without words are not taken; a null source is a source; equal rows are
    taken each for itself; an empty table stays empty.
    """
    return source_mix.mixed_rows(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, as digests and counts.

    Null and empty texts have none; repeated rows repeat; an empty table gives
    an empty one.
    """
    return sentencepiece_bpe.encode_digests(spark, docs, PIECE_MODEL)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("encode", encode)]

#: No stage but the exact one can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
