"""Tables of a data folder, and folders that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession, what: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; a temporary one only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemill-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write df there and read it back: lineage ends, and the work is done once."""
    path = work_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def named(spark: SparkSession, tables: dict[str, DataFrame]) -> Iterator[None]:
    """The tables by their names in SQL, for statements that are analysed meanwhile; views of these names that were there before are there again afterwards."""
    before = {n: spark.table(n) for n in tables if spark.catalog.tableExists(n)}
    kept = {n: df for n, df in before.items() if spark.catalog.dropTempView(n)}
    try:
        for n, df in tables.items():
            df.createOrReplaceTempView(n)
        yield
    finally:
        for n in tables:
            spark.catalog.dropTempView(n)
        for n, df in kept.items():
            df.createOrReplaceTempView(n)
