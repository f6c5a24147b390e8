"""Sharding by extendible hashing.

Documents hash to 60 bits. The directory starts as one bucket; a bucket over the byte limit is split
on its next hash bit, others stay as they are. All splits come from sums of bytes over hash
prefixes: one grouped pass gives the sums for a window of bits, and only what is still too large at
the end of the window goes on to the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemill.llm.common import cut, join_groups, tasks

BITS = 60  # of the hash
WINDOW = 12  # bits that one pass looks at
SEND = 1_000_000  # shards whose directory is sent to all tasks at most, some 40 bytes each


def hash60(key: Column) -> Column:
    """The first 60 bits of the key's MD5; a null key hashes as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def prefix(h: Column, depth: Column) -> Column:
    """The first depth bits of a hash."""
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row: those of its texts, eight for each other value; null texts have none."""
    long = lambda f: f.dataType.simpleString() in ("string", "binary")
    return sum((F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)).cast("long") if long(f) else F.lit(8).cast("long") for f in df.schema), F.lit(0).cast("long"))


def directory(rows: DataFrame, limit_bytes: int) -> DataFrame:
    """(depth, p, shard_bytes, n) of every shard for rows(_h, _n): the first depth bits of the hashes, bytes, rows."""
    by_hash, start, leaves = rows, 0, None
    while start < BITS:
        end = min(start + WINDOW, BITS)
        # sums at the last depth of the window first; the sums above it come from these few rows
        fine = by_hash.groupBy(prefix(F.col("_h"), F.lit(end)).alias("p")).agg(F.sum("_n").alias("bytes"), F.count(F.lit(1)).alias("n"))
        levels = F.sequence(F.lit(start), F.lit(end))
        sums = (
            fine.select(F.explode(levels).alias("depth"), "p", "bytes", "n")
            .select("depth", F.call_function("shiftright", "p", F.lit(end) - F.col("depth")).alias("p"), "bytes", "n")
            .groupBy("depth", "p").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        )
        sums = cut(sums, "directory")
        # a bucket is a shard where its sum fits and that of the bucket it came from did not
        parents = sums.where(F.col("bytes") > limit_bytes).select((F.col("depth") + 1).alias("depth"), F.col("p").alias("_up"), F.lit(True).alias("_split"))
        made = sums.withColumn("_up", F.call_function("shiftright", "p", F.lit(1))).join(parents, ["depth", "_up"], "left")
        fits = (F.col("bytes") <= limit_bytes) | (F.col("depth") == BITS)
        found = made.where(fits & (F.col("_split") | (F.col("depth") == 0)) if start == 0 else fits & F.col("_split")).select("depth", "p", F.col("bytes").alias("shard_bytes"), "n")
        leaves = found if leaves is None else leaves.unionByName(found)
        large = sums.where((F.col("depth") == end) & (F.col("bytes") > limit_bytes)).select(F.col("p").alias("_big"))
        if end == BITS or large.isEmpty():
            break
        by_hash = by_hash.join(large, prefix(F.col("_h"), F.lit(end)) == F.col("_big"), "left_semi")
        start = end
    return cut(leaves, "shards")


def located(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """rows (with _h) and their shard's _at (depth, p) and shard_bytes.

    Shards are looked up by the bits that all of them have, the least depth in use: what begins so is a short list in order of the first
    hashes, and a row's shard is the last that begins at or before its own. A directory of up to SEND shards is sent out, so rows do not
    move; a larger one is joined, with the lists that many rows need dealt in parts.
    """
    least = leaves.agg(F.coalesce(F.min("depth"), F.lit(0)).cast("int")).first()[0]
    begins = F.call_function("shiftleft", "p", (F.lit(BITS) - F.col("depth")).cast("int"))
    one = F.struct(begins.alias("begins"), F.col("depth").cast("int").alias("depth"), "p", "shard_bytes")
    # hashes are even, so depths differ by little but for single documents or ids over the limit, which add 60 shards at most
    lists = leaves.select(prefix(begins, F.lit(least)).alias("_bits"), one.alias("_one"), "n").groupBy("_bits").agg(F.sort_array(F.collect_list("_one")).alias("_own"), F.sum("n").alias("n"))
    keyed = rows.withColumn("_bits", prefix(F.col("_h"), F.lit(least)))
    met = keyed.join(F.broadcast(lists.drop("n")), "_bits") if leaves.count() <= SEND else join_groups(keyed, lists, "_bits", "_h", rows.count()).drop("n")
    mine = met.withColumn("_mine", F.element_at(F.filter("_own", lambda x: x["begins"] <= F.col("_h")), -1))
    return mine.select(*rows.columns, F.struct("_mine.depth", "_mine.p").alias("_at"), F.col("_mine.shard_bytes").alias("shard_bytes"))


def name(at: Column) -> Column:
    """A shard's name: the prefix as a bit string of its depth."""
    bits = F.lpad(F.bin(at["p"]), F.lit(BITS), F.lit("0"))
    return F.when(at["depth"] == 0, F.lit("")).otherwise(F.right(bits, at["depth"]))


def assign(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, depth, shard, shard_bytes): shard is the bucket's hash prefix as a bit string of length depth.

    Every shard has at most limit_bytes bytes (row_bytes of whole rows), but for a bucket that no hash bit can split: one
    document over the limit, or rows that repeat one id; such a bucket ends at the depth of all bits. Null ids share
    one bucket. Further columns count by their bytes. The empty table gives no rows.
    """
    rows = cut(docs.select(F.col(id_col).alias("_id"), hash60(F.col(id_col)).alias("_h"), row_bytes(docs).alias("_n")), "sizes")
    placed = located(rows, directory(rows, limit_bytes))
    return placed.select(F.col("_id").alias(id_col), F.col("_n").alias("n_bytes"), F.col("_at.depth").alias("depth"), name(F.col("_at")).alias("shard"), "shard_bytes")


def write(docs: DataFrame, path: str, limit_bytes: int, id_col: str = "doc_id") -> None:
    """Write the documents as Parquet, one folder shard=b<prefix> a shard, one file in it. Columns stay as they are, but one named
    shard is replaced. Documents move once; no task has more than shards of limit_bytes one after another."""
    kept = docs.drop("shard")
    sizes = kept.select(hash60(F.col(id_col)).alias("_h"), row_bytes(kept).alias("_n"))
    leaves = directory(cut(sizes, "sizes"), limit_bytes)
    whole = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("_row"), hash60(F.col(id_col)).alias("_h"))
    out = located(whole, leaves).select("_row.*", F.concat(F.lit("b"), name(F.col("_at"))).alias("shard"))
    out.repartition(tasks(docs.sparkSession), "shard").write.partitionBy("shard").parquet(path)


def read(spark: SparkSession, path: str, schema: StructType | str, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, depth, shard, shard_bytes) of the documents that the shards under path hold, from the files."""
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    names = [f.name for f in schema if f.name != "shard"]
    rows = spark.read.schema(StructType([f for f in schema if f.name != "shard"]).add("shard", "string")).parquet(path)
    rows = rows.select(F.col(id_col), row_bytes(rows.select(*[f"`{n}`" for n in names])).alias("n_bytes"), F.substring("shard", 2, BITS).alias("shard"))
    sums = rows.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("n"))
    return join_groups(rows, cut(sums, "read"), "shard", id_col, rows.count()).select(id_col, "n_bytes", F.length("shard").alias("depth"), "shard", "shard_bytes")
