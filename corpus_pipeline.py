"""From raw documents to packed training sequences: quality, language, near copies, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import langid, neardup, packing, quality
from tidemill.llm.common import Scratch, keep, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.accepted(docs)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents too far from every language that the labelled ones teach go."""
    return langid.accepted(docs, langid.fit(docs))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return neardup.distinct_documents(docs, k=5, threshold=0.8)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", keep_quality), ("language", keep_language), ("near_dedup", keep_distinct), ("packing", pack_sequences)]

#: Language identification is fitted by k-means, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, the only folder that stays; what a stage wrote goes when the next one has read it."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as stages:
        for name, stage in STAGES:
            with Scratch(spark, collect=True):
                made = (keep if (name, stage) == STAGES[-1] else stages.cut)(stage(spark, docs, sf_dir), name)
            stages.drop(docs)
            docs = made
    return docs
