"""One query for each operator, over whole tables, with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe, collocations, fingerprints, langid, licenses, neardup, packing, quality, shards, tokenfiles, urlgraph, variants, warc
from tidemill.llm.common import new_folder, table

URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
SHARD_BYTES = 64 << 20


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = new_folder(spark, "shards")
    shards.write(docs, path, SHARD_BYTES)
    return shards.read(spark, path, docs.schema)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_next(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    got = langid.predict(docs, langid.fit(docs, ~held_out))
    return got.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlgraph.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=3, threshold=0.85)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages")), payload=False).drop("url", "payload")


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.read(spark, tokenfiles.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"), most_words=3, least=10, best=2000, share=50)


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(variants.words(table(spark, sf_dir, "documents"), least_signs=6, least_count=5, spoil=199), times=5)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_shards, op3_fingerprints, op4_licenses, op5_langid, op6_packing, op7_urls, op8_neardup, op9_quality, op10_warc, op11_tokens, op12_collocations, op13_variants)}
