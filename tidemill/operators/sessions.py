"""Sessions, prompts, link expansion and batches of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.storage import cut


def read_through(hot: DataFrame, durable: DataFrame, key: str) -> DataFrame:
    """Whole rows: the hot copy of a key where there is one, else the durable copy."""
    row = F.struct(*hot.columns)
    both = hot.select(key, row.alias("_a")).join(durable.select(*hot.columns).select(key, row.alias("_b")), key, "full")
    return both.select(F.coalesce("_a", "_b").alias("_r")).select("_r.*")


#: Edges of a node that one part of it has.
HUB = 10_000
#: Starts whose numbers are given in one place, about.
TOGETHER = 1 << 16


def expand(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """(start, node, depth): what edges(a, b) reach from each of start(node) in at most so many steps, with the fewest steps; depth 0 is the start.

    Starts go together in sets of 64, a bit each: a step follows (set, node, bits) over the edges and brings together what comes to a
    node, so a node that many starts reach at once is one row for 64 of them. Only bits that are new there go on. The edges of a hub
    are dealt in parts. Null ends and starts lead nowhere; repeated ones count once.
    """
    clean = edges.where("a is not null and b is not null").select("a", "b").distinct()
    clean = cut(clean, "edges")
    hubs = cut(clean.groupBy("a").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HUB).select("a", F.ceil(F.col("_n") / HUB).alias("_parts")), "hubs")
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    dealt = cut(clean.join(hubs, "a", "left").select("a", F.pmod(F.xxhash64("b"), parts).alias("_part"), "b"), "dealt")
    names = start.where("node is not null").select(F.col("node").alias("start")).distinct()
    places = -(-names.count() // TOGETHER)
    at = F.row_number().over(Window.partitionBy("_place").orderBy("start")) - 1
    names = names.withColumn("_place", F.pmod(F.xxhash64("start"), F.lit(max(places, 1)))).withColumn("_at", at)
    names = cut(names.select("start", F.struct("_place", F.floor(F.col("_at") / 64).alias("_k")).alias("set"), (F.col("_at") % 64).cast("int").alias("bit")), "starts")
    one = lambda bit: F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    front = cut(names.groupBy("set", F.col("start").alias("node")).agg(F.bit_or(one(F.col("bit"))).alias("bits")), "front")
    layers, seen = [front.withColumn("depth", F.lit(0))], front
    for depth in range(1, most + 1):
        spread = front.join(hubs.withColumnRenamed("a", "node"), "node", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        came = spread.join(dealt.withColumnRenamed("a", "node"), ["node", "_part"]).groupBy("set", F.col("b").alias("node")).agg(F.bit_or("bits").alias("bits"))
        both = came.join(seen.withColumnRenamed("bits", "_seen"), ["set", "node"], "left")
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_seen", F.lit(0).cast("long"))))
        front = cut(both.select("set", "node", fresh.alias("bits")).where("bits != 0"), "front")
        if front.isEmpty():
            break
        layers.append(front.withColumn("depth", F.lit(depth)))
        if depth < most:
            seen = cut(seen.unionByName(front).groupBy("set", "node").agg(F.bit_or("bits").alias("bits")), "seen")
    every = reduce(DataFrame.unionByName, layers)
    on = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", F.col("bits"), i).bitwiseAND(F.lit(1)) == 1)
    return every.select("set", "node", "depth", F.explode(on).alias("bit")).join(names, ["set", "bit"]).select("start", "node", "depth")


def zip_lists(df: DataFrame, ids: str, texts: str) -> DataFrame:
    """One row for each pair of two parallel arrays; a row whose arrays differ in length fails the job."""
    same = F.size(ids) == F.size(texts)
    zipped = F.when(same, F.arrays_zip(ids, texts)).otherwise(F.raise_error(F.lit("lists of unequal length")))
    return df.select(*[c for c in df.columns if c not in (ids, texts)], F.inline(zipped))


def assemble(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, messages): each session's messages in order of turn."""
    return turns.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def render(template: str, values: dict[str, Column]) -> Column:
    """The template with each {name} replaced; unknown names stay as they are."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def placeholders(template: Column) -> Column:
    return F.regexp_extract_all(template, F.lit(r"\{([^}]+)\}"), F.lit(1))


def apply_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn over Arrow batches of rows; an error in it fails the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)

    return df.mapInPandas(run, schema)
