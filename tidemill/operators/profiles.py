"""Profiles of tables, of a folder of tables and of a log of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_profile(df: DataFrame) -> DataFrame:
    """(name, type, nullable, position, n_rows, n_null, least, most) of every column, in one pass; columns without an order have no least and most."""
    facts = []
    for k, f in enumerate(df.schema, 1):
        c, ordered = F.col(f"`{f.name}`"), f.dataType.typeName() not in ("map", "variant")
        ends = [(F.min(c) if n == "least" else F.max(c)).cast("string").alias(n) if ordered else F.lit(None).cast("string").alias(n) for n in ("least", "most")]
        facts.append(F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(f.nullable).alias("nullable"), F.lit(k).alias("position"), F.count(F.lit(1)).alias("n_rows"), F.count_if(c.isNull()).alias("n_null"), *ends))
    return df.agg(F.array(*facts).alias("x")).select(F.inline("x"))


def database_profile(spark: SparkSession, tables: dict[str, str]) -> DataFrame:
    """(name, n_rows, n_files, n_bytes) of Parquet tables by their paths: rows from the files' footers, bytes from their sizes."""

    def one(name: str, path: str) -> DataFrame:
        files = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s")).groupBy("p").agg(F.first("s").alias("s"), F.count(F.lit(1)).alias("n"))
        return files.agg(F.lit(name).alias("name"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("s"), F.lit(0)).alias("n_bytes"))

    return reduce(DataFrame.unionByName, [one(n, p) for n, p in tables.items()])


def database_totals(profile: DataFrame) -> DataFrame:
    """(n_tables, n_rows, n_bytes, megabytes) over database_profile."""
    return profile.agg(F.count(F.lit(1)).alias("n_tables"), F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"), F.round(F.sum("n_bytes") / (1 << 20), 2).alias("megabytes"))


def query_profile(log: DataFrame, query: str, start: str, end: str, exact: bool = False) -> DataFrame:
    """(query, runs, first_start, last_end, mean_s, max_s, p50_s, p95_s) of a log of runs with their start and end in seconds.

    Percentiles are estimates with bounded memory (to one in 10,000 of the ranks), or exact ones.
    """
    seconds = F.col(end) - F.col(start)
    at = F.percentile if exact else lambda c, p: F.percentile_approx(c, p, 10_000)
    return log.groupBy(F.col(query).alias("query")).agg(
        F.count(F.lit(1)).alias("runs"), F.min(start).alias("first_start"), F.max(end).alias("last_end"), F.round(F.avg(seconds), 4).alias("mean_s"), F.max(seconds).alias("max_s"),
        at(seconds, F.lit(0.5)).alias("p50_s"), at(seconds, F.lit(0.95)).alias("p95_s"),
    )
