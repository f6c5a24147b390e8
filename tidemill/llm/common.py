"""What the corpus operators share: table access, the shared folder, cutting lineage, joins on hot keys, components."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot beyond this share of all rows (one in so many), so there are at most so many hot keys, whatever the input.
HOT_KEYS = 100_000
#: Keys of this many rows or fewer are never hot.
COLD_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only a session of one machine may do without; it gets a temporary folder, which goes when the process ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemill-shared-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Scratches that collect what operators cut without one of their own; the last counts.
_collecting: list[Scratch] = []


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, work is done once, lost executors lose nothing.

    The folder stays, unless a collecting Scratch is open.
    """
    return _collecting[-1].cut(df, what) if _collecting else keep(df, what)


def keep(df: DataFrame, what: str = "kept") -> DataFrame:
    """As cut, and the folder stays."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Scratch:
    """Cuts that go together: with Scratch(spark) as s, all folders of s.cut are removed at the end; with collect=True also what
    operators cut meanwhile without a Scratch of their own, which their results are read from."""

    def __init__(self, spark: SparkSession, collect: bool = False):
        self.spark, self.paths, self.collect = spark, {}, collect

    def __enter__(self) -> Scratch:
        if self.collect:
            _collecting.append(self)
        return self

    def cut(self, df: DataFrame, what: str = "cut") -> DataFrame:
        path = new_folder(self.spark, what)
        df.write.parquet(path)
        made = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(made)] = path, made
        return made

    def drop(self, *made: DataFrame) -> None:
        """Remove folders of cuts that nothing reads any more."""
        for df in made:
            path, _ = self.paths.pop(id(df), (None, None))
            if path:
                remove(self.spark, path)

    def __exit__(self, *_) -> None:
        if self.collect:
            _collecting.remove(self)
        for path, _df in self.paths.values():
            remove(self.spark, path)


_remembered: dict[str, Callable[[], object]] = {}


def remember(what: str, forget: Callable[[], object]) -> None:
    """Register what an operator remembers in a Python worker, with the function that lets it go."""
    _remembered[what] = forget


_c: list[ctypes.CDLL] = []
#: What mallopt() calls the size from which memory is taken from the machine by itself, and the number of arenas.
MMAP_THRESHOLD, ARENA_MAX = -3, -8


def release() -> None:
    """Give memory that is free in this Python worker back to the machine; a worker otherwise keeps the most that it ever had.

    The first call also has batches and texts go back as soon as they are free, where the C library is glibc.
    """
    if not _c:
        _c.append(ctypes.CDLL(None))
        pa.set_memory_pool(pa.system_memory_pool())
        if hasattr(_c[0], "mallopt"):
            _c[0].mallopt(MMAP_THRESHOLD, 1 << 16)
            _c[0].mallopt(ARENA_MAX, 1)
    pa.default_memory_pool().release_unused()
    if hasattr(_c[0], "malloc_trim"):
        _c[0].malloc_trim(0)


def only(what: str) -> None:
    """At the start of an operator's task: a worker goes on from one operator to the next, so what others remember is let go."""
    for name, forget in _remembered.items():
        if name != what:
            forget()
    release()


@contextmanager
def short_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Rows go to Python workers in batches of so many at most: texts of 10,000 rows would stand in memory several times over."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def join_groups(rows: DataFrame, groups: DataFrame, key: str, member: str, total: int, n: str = "n") -> DataFrame:
    """rows joined with groups (one row a key, with the number n of its rows) on key, whatever share of all rows one key has.

    Keys with more than total / HOT_KEYS rows are hot: there are at most HOT_KEYS of them, so their table may be sent out. Rows
    of a hot key are dealt by a hash of member over so many parts that each is as small, and its group is repeated for each part.
    """
    most = max(COLD_ROWS, total // HOT_KEYS)
    hot = F.broadcast(groups.where(F.col(n) > most).select(key, F.ceil(F.col(n) / most).alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    left = rows.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(F.col(member), F.lit(17)), parts)).drop("_parts")
    right = groups.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return left.join(right, [key, "_part"]).drop("_part")


def numbered(df: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """(df with its ids replaced by numbers in the same order, the ids by number): for ids that are no whole numbers.

    Ids are sorted over ranges, so nothing meets in one task; a null id stays null.
    """
    ids = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id")).distinct().orderBy("_id")
    ids = cut(ids.withColumn("_n", F.monotonically_increasing_id()), "ids")
    named = df.join(ids, F.col(id_col) == F.col("_id"), "left")
    return named.select(*[F.col("_n").alias(c) if c == id_col else F.col(f"`{c}`") for c in df.columns]), ids


def whole_numbers(df: DataFrame, id_col: str) -> bool:
    return df.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Connected components of edges(a, b): rows (node, label), label the smallest node reached.

    Contraction: each node points to its smallest neighbour (or itself). Pointers only lead down, so they form trees; by
    pointing to where the pointer's end points (log2 of a tree's depth times) every node finds its root at once, and
    edges go on between roots. At least half of the nodes that still have edges go each time, so a chain of n nodes
    takes about log2 n steps in all. Null ends and loops are ignored; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    pairs = edges.where("a != b").select("a", "b")
    with Scratch(spark) as s:
        live = s.cut(pairs.union(pairs.select("b", "a")).distinct(), "edges")
        labels = s.cut(live.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
        while not live.isEmpty():
            down = live.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).withColumnRenamed("a", "from")
            while True:
                # only pointers that do not end at a root yet lead on
                on = down.where("`from` != `to`").select(F.col("from").alias("_at"), F.col("to").alias("_next"))
                further = s.cut(down.join(on, F.col("to") == F.col("_at"), "left").select("from", F.coalesce("_next", "to").alias("to"), F.col("_at").isNotNull().alias("moved")), "down")
                s.drop(down)
                moved, down = not further.where("moved").isEmpty(), further
                if not moved:
                    break
            to = down.select("from", "to")
            below = s.cut(labels.join(to, F.col("label") == F.col("from"), "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
            one = live.join(to, F.col("a") == F.col("from")).select(F.col("to").alias("a"), "b")
            two = one.join(to, F.col("b") == F.col("from")).select("a", F.col("to").alias("b"))
            rest = s.cut(two.where("a != b").distinct(), "edges")
            s.drop(live, labels, down)
            live, labels = rest, below
        return (scratch.cut if scratch else cut)(labels, "components")
