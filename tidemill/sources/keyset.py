"""Database tables by key, through Python's database interface: batch reads in key ranges, streams that go on from a key.

A page is `WHERE key > last ORDER BY key LIMIT n`, so the database walks its index once and skips nothing, which OFFSET would. The ranges of a batch read
hold about as many rows each: their bounds are keys of the table. A stream's offset is the last key of each address, so what was read
before is not read again, in the same run or after a restart. The table may be spread over several addresses.
"""

from __future__ import annotations

import importlib
import os
import re
import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Rows of a page; rows of a range, about.
PAGE, RANGE = 5000, 100_000


class Keys(InputPartition):
    """The rows of an address with low < key <= high; None is no bound."""

    def __init__(self, address: str, low, high):
        self.address, self.low, self.high = address, low, high


class Table:
    """The statements about one table; key must be unique and not null, and grow where streams read."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.module, self.name, self.key = options.get("module", "sqlite3"), options["table"], options["key"]
        self.addresses = [a for a in options["address"].split(",") if a]
        self.page, self.range = int(options.get("page", PAGE)), int(options.get("range", RANGE))
        self.columns = schema.names
        if bad := [n for n in (self.name, self.key, *self.columns) if not re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)*", n)]:
            raise ValueError(f"no plain name: {bad[0]}")

    def ask(self, address: str, sql: str, values: tuple = ()) -> list[tuple]:
        module = importlib.import_module(self.module)
        with closing(module.connect(address)) as c, closing(c.cursor()) as rows:
            rows.execute(sql.replace("?", "?" if module.paramstyle == "qmark" else "%s"), values)
            return rows.fetchall()

    def last(self, address: str):
        return self.ask(address, f"SELECT max({self.key}) FROM {self.name}")[0][0]

    def within(self, low, high) -> tuple[str, tuple]:
        bounds = [(f"{self.key} > ?", low)] * (low is not None) + [(f"{self.key} <= ?", high)] * (high is not None)
        return " AND ".join(b for b, _ in bounds) or "1 = 1", tuple(v for _, v in bounds)

    def ranges(self, address: str, low, high) -> list[Keys]:
        """Bounds that the table's own keys give, every so many rows; the last range is open as far as high is."""
        where, values = self.within(low, high)
        ends = self.ask(address, f"SELECT k FROM (SELECT {self.key} AS k, row_number() OVER (ORDER BY {self.key}) AS r FROM {self.name} WHERE {where}) x WHERE r % {self.range} = 0 ORDER BY k", values)
        bounds = [low, *(e[0] for e in ends if e[0] != high), high]
        return [Keys(address, a, b) for a, b in zip(bounds, bounds[1:], strict=False)]

    def rows(self, part: Keys) -> Iterator[tuple]:
        low = part.low
        while True:
            where, values = self.within(low, part.high)
            found = self.ask(part.address, f"SELECT {self.key}, {', '.join(self.columns)} FROM {self.name} WHERE {where} ORDER BY {self.key} LIMIT {self.page}", values)
            for _, *row in found:
                yield tuple(row)
            if len(found) < self.page:
                return
            low = found[-1][0]


class Reader(DataSourceReader):
    def __init__(self, table: Table):
        self.table = table

    def partitions(self) -> list[Keys]:
        return [r for a in self.table.addresses for r in self.table.ranges(a, None, None)]

    def read(self, partition: Keys) -> Iterator[tuple]:
        return self.table.rows(partition)


class StreamReader(DataSourceStreamReader):
    """An offset has the last key of each address, null before the first row."""

    def __init__(self, table: Table):
        self.table = table

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.table.addresses)

    def latestOffset(self) -> dict:
        return {a: self.table.last(a) for a in self.table.addresses}

    def partitions(self, start: dict, end: dict) -> list[Keys]:
        return [r for a, high in end.items() if high is not None and high != start.get(a) for r in self.table.ranges(a, start.get(a), high)]

    def read(self, partition: Keys) -> Iterator[tuple]:
        return self.table.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class KeysetSource(DataSource):
    """spark.read or spark.readStream.format("keyset") with options module (of the database interface), address (several between commas),
    table, key, page and range, and a schema."""

    @classmethod
    def name(cls) -> str:
        return "keyset"

    def schema(self) -> str:
        raise ValueError("a schema must be given")

    def reader(self, schema: StructType) -> Reader:
        return Reader(Table(self.options, schema))

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(Table(self.options, schema))


def _loaded(builder, schema: str, address: str, table: str, key: str, options: dict[str, str]) -> DataFrame:
    return builder.format("keyset").schema(schema).options(address=address, table=table, key=key, **options).load()


def read(spark: SparkSession, schema: str, address: str, table: str, key: str, **options: str) -> DataFrame:
    spark.dataSource.register(KeysetSource)
    return _loaded(spark.read, schema, address, table, key, options)


def stream(spark: SparkSession, schema: str, address: str, table: str, key: str, **options: str) -> DataFrame:
    spark.dataSource.register(KeysetSource)
    return _loaded(spark.readStream, schema, address, table, key, options)


def write_shards(df: DataFrame, folder: str, table: str, key: str) -> str:
    """Write df to SQLite databases in a folder that driver and executors have mounted, one a task; their addresses between commas.

    A database appears by a rename, so a task that runs again replaces it. Columns are numbers or texts.
    """
    path = folder.removeprefix("file://")
    if "://" in path:
        raise ValueError("SQLite needs a mounted folder")
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        context = TaskContext.get()
        os.makedirs(path, exist_ok=True)
        hidden, shown = (f"{path}/{x}{context.partitionId():06d}.db" for x in (f".{context.taskAttemptId()}-", "shard-"))
        with closing(sqlite3.connect(hidden)) as c:
            c.execute(f"CREATE TABLE {table} ({', '.join(n + (' PRIMARY KEY' if n == key else '') for n in names)})")
            for b in batches:
                c.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(names))})", b.astype(object).where(b.notna(), None).values.tolist())
            c.commit()
        os.replace(hidden, shown)
        yield pd.DataFrame({"address": [shown]})

    return ",".join(sorted(r["address"] for r in df.mapInPandas(run, "address string").collect()))  # one a task
