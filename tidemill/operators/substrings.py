"""Keyword search over an index of parts of words that is written once and searched by any number of query tables.

A query's word has no white space, so it occurs in a text if and only if it occurs in one of the text's words. The index has the
different words of all texts by their runs of three characters, and for each word the ids of the texts that have it; runs of one
and two characters have the ids of their texts too. A search looks each of its words up by the rarest of the word's runs, checks
the words found there, and reads the ids of those alone. Texts are dealt into shards of bounded size by their ids, so the scores of a
shard are made in one task and only its k best of each query leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.retrieve import TEXTS_AT_ONCE, Best, by_blocks, top
from tidemill.storage import cut, work_folder
from tidemill.workers import pieces

#: Folders of each table; texts of a shard, about; shards of a part: a word has so many rows of postings at most in a part.
FOLDERS, SHARD_TEXTS, PART_SHARDS = 32, 1024, 4096
#: Rows of runs in a file, about.
FILE_RUNS = 4_000_000
#: Characters of the runs by which words are found; shorter words of a query are runs themselves.
RUN = 3
#: Shards whose texts a task of the build sorts, about; keys whose lists are made at once.
SHARDS_AT_ONCE, KEYS = 8, 4096
#: Pairs of text and word that a task gathers before repeated ones go; terms whose queries are counted at once.
GATHERED, COUNTED = 4_000_000, 2048


class Index(NamedTuple):
    """An index in a folder."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        """postings: the texts of a shard that have a word, or (short) a run of one or two characters; parts: where a word or run has
        postings; runs: words by their runs of three characters; sizes: how many words have a run."""
        schema = {
            "postings": "key string, short boolean, part long, shard long, ids array<long>, _folder long", "parts": "key string, short boolean, part long, _folder long",
            "runs": "run string, word string, _folder long", "sizes": "run string, n long, _folder long",
        }[name]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")


def _folder(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FOLDERS)).alias("_folder")


class Shard:
    """The words of a shard's texts, each with the texts that have it as bits of a number."""

    def __init__(self, shard: int):
        self.shard, self.places, self.words = shard, {}, {}

    def add(self, id_: int, text: str) -> None:
        bit = 1 << self.places.setdefault(id_, len(self.places))
        words = self.words
        for w in set(text.encode().split()):  # at ASCII white space
            words[w] = words.get(w, 0) | bit

    def batches(self) -> Iterator[pa.RecordBatch]:
        ids, size = np.fromiter(self.places, np.int64, len(self.places)), -(-len(self.places) // 8)
        short: dict[str, int] = {}
        for word, bits in self.words.items():
            w = word.decode()
            for run in {w[i : i + n] for n in range(1, RUN) for i in range(len(w) - n + 1)}:
                short[run] = short.get(run, 0) | bits
        for is_short, found in ((False, self.words), (True, short)):
            keys = list(found)
            for at in range(0, len(keys), KEYS):
                some = keys[at : at + KEYS]
                bits = np.frombuffer(b"".join([found[k].to_bytes(size, "little") for k in some]), np.uint8).reshape(len(some), size)
                key, byte = np.nonzero(bits)  # most words are in few texts
                at_byte, bit = np.nonzero(np.unpackbits(bits[key, byte][:, None], axis=1, bitorder="little"))
                key, place = key[at_byte], byte[at_byte] * 8 + bit
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(key, np.arange(len(some) + 1)), pa.int32()), pa.array(ids[place]))
                columns = [pa.array([k if is_short else k.decode() for k in some], pa.string()), pa.array(np.full(len(some), is_short)), pa.array(np.full(len(some), self.shard)), lists]
                yield pa.record_batch(columns, ["key", "short", "shard", "ids"])


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, short, shard, ids) of rows (shard, id, text) that come shard by shard."""
    now: Shard | None = None
    for piece in pieces(batches):
        for shard, id_, text in zip(*(c.to_pylist() for c in piece.columns), strict=True):
            if now is None or now.shard != shard:
                if now:
                    yield from now.batches()
                now = Shard(shard)
            now.add(id_, text)
    if now:
        yield from now.batches()


def build(texts: DataFrame, path: str | None = None) -> Index:
    """Write the index of texts(id, text). Null texts are none; rows that share an id are one text."""
    spark = texts.sparkSession
    path = path or work_folder(spark, "substrings")
    written = Index(spark, path)
    rows = texts.where("text is not null and id is not null").select(F.col("id").cast("long"), F.lower("text").alias("text"))
    shards = max(1, rows.count() // SHARD_TEXTS)
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    # a shard is gathered by one task, and a task sorts the texts of about SHARDS_AT_ONCE shards
    dealt = dealt.repartition(max(spark.sparkContext.defaultParallelism, -(-shards // SHARDS_AT_ONCE)), "shard").sortWithinPartitions("shard")
    lists = dealt.select("shard", "id", "text").mapInArrow(gather, "key string, short boolean, shard long, ids array<long>")
    placed = lists.select("key", "short", F.floor(F.col("shard") / PART_SHARDS).alias("part"), "shard", "ids", _folder("key"))
    placed.repartition("_folder", "part").sortWithinPartitions("_folder", "key", "shard").write.partitionBy("_folder").parquet(f"{path}/postings")
    parts = written.table("postings").select("key", "short", "part", "_folder").distinct()
    parts.repartition("_folder").sortWithinPartitions("_folder", "key").write.partitionBy("_folder").parquet(f"{path}/parts")
    words = written.table("parts").where(~F.col("short") & (F.length("key") >= RUN)).select("key").distinct()
    runs_of = F.array_distinct(F.regexp_extract_all("key", F.lit(rf"(?=(\S{{{RUN}}}))"), F.lit(1)))
    by_run = words.select(F.explode(runs_of).alias("run"), F.col("key").alias("word")).select("run", "word", _folder("run"))
    files = 1 + written.table("parts").count() // FILE_RUNS
    by_run.repartition("_folder", F.pmod(F.xxhash64("word"), F.lit(files))).sortWithinPartitions("_folder", "run", "word").write.partitionBy("_folder").parquet(f"{path}/runs")
    sizes = written.table("runs").groupBy("run", "_folder").agg(F.count(F.lit(1)).alias("n")).select("run", "n", "_folder")
    sizes.repartition("_folder").sortWithinPartitions("_folder", "run").write.partitionBy("_folder").parquet(f"{path}/sizes")
    return written


def _of(index: Index, name: str, wanted: DataFrame, column: str) -> DataFrame:
    """The index's table in the folders alone that wanted's column leads to."""
    folders = [r[0] for r in wanted.select(_folder(column)).distinct().collect()]  # FOLDERS at most
    return index.table(name).where(F.col("_folder").isin(folders)).drop("_folder")


def matches(terms: DataFrame, index: Index) -> DataFrame:
    """(t, key, short): the words and short runs of the index that have the term, for terms(t, term), which are sent to every task."""
    long = terms.where(F.length("term") >= RUN)
    runs = cut(long.select("t", "term", F.explode(F.array_distinct(F.regexp_extract_all("term", F.lit(rf"(?=(\S{{{RUN}}}))"), F.lit(1)))).alias("run")), "runs")
    counted = runs.join(_of(index, "sizes", runs, "run"), "run", "left")
    # a run that no word has leads to nothing
    rarest = cut(counted.groupBy("t", "term").agg(F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "run")).alias("_r")).select("t", "term", "_r.run"), "rarest")
    words = _of(index, "runs", rarest, "run").join(F.broadcast(rarest), "run").where(F.contains("word", "term")).select("t", F.col("word").alias("key"), F.lit(False).alias("short"))
    return words.unionByName(terms.where(F.length("term") < RUN).select("t", F.col("term").alias("key"), F.lit(True).alias("short")))


def search(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, id, score, rank) as retrieve.keyword gives: the share of a query's words (repeats count) that occur in the text, as parts of
    words too; ties by id. Queries without a word have no hits."""
    q = queries.select(F.col("query_id").cast("long"), F.filter(F.split(F.lower("query"), r"\s+"), lambda x: x != "").alias("_terms")).where("size(_terms) > 0")

    def answer(block: DataFrame) -> DataFrame:
        asked = block.collect()  # at most about TEXTS_AT_ONCE rows
        terms = sorted({t for r in asked for t in r["_terms"]})
        place = {t: i for i, t in enumerate(terms)}
        names, total = np.array([r["query_id"] for r in asked], np.int64), np.array([len(r["_terms"]) for r in asked], float)
        pairs = np.array([(place[t], j) for j, r in enumerate(asked) for t in r["_terms"]], np.int64).reshape(-1, 2)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        starts = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1))  # the queries of a term, each as often as it has it
        sent = index.spark.sparkContext.broadcast((pairs[:, 1].copy(), starts, total))
        listed = index.spark.createDataFrame(pa.table({"t": pa.array(range(len(terms)), pa.int64()), "term": pa.array(terms, pa.string())}))
        wanted = cut(matches(listed, index), "wanted")
        placed = cut(_of(index, "parts", wanted, "key").join(wanted, ["key", "short"]).select("key", "short", "part", "t"), "placed")
        hits = _of(index, "postings", placed, "key").join(placed, ["key", "short", "part"]).select("shard", "t", "ids")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            who, start, of = sent.value
            best, held, size, current = Best(len(names), k), [], 0, None

            def distinct() -> np.ndarray:
                found = np.concatenate(held)
                ids, doc = np.unique(found[:, 0], return_inverse=True)
                both = np.unique(doc * (len(start) - 1) + found[:, 1])
                return np.stack([ids[both // (len(start) - 1)], both % (len(start) - 1)], axis=1)

            def close() -> None:
                if not held:
                    return
                found = np.concatenate(held)
                ids, doc = np.unique(found[:, 0], return_inverse=True)
                order = np.argsort(found[:, 1], kind="stable")
                doc, t = doc[order], found[order, 1]
                terms = np.flatnonzero(np.bincount(t, minlength=len(start) - 1))  # of the shard
                edges = np.searchsorted(t, np.append(terms, len(start)))
                counts = np.zeros((len(ids), len(names)))
                for at in range(0, len(terms), COUNTED):
                    some = terms[at : at + COUNTED]
                    has = np.zeros((len(ids), len(some)), np.float32)
                    here = slice(edges[at], edges[at + len(some)])
                    has[doc[here], np.searchsorted(some, t[here])] = 1
                    n = start[some + 1] - start[some]
                    each = np.repeat(start[some] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    asks = np.bincount(np.repeat(np.arange(len(some)), n) * len(names) + who[each], minlength=len(some) * len(names))
                    counts += has @ asks.reshape(len(some), len(names)).astype(np.float32)
                best.add(ids, np.round(counts / of, 6), np.nextafter(0, 1))
                held.clear()

            for batch in batches:
                shard, t, lists = (batch.column(i) for i in range(3))
                shard, t, lengths = shard.to_numpy(), t.to_numpy(), np.diff(lists.offsets.to_numpy())
                edges = np.concatenate([[0], np.cumsum(lengths)])
                flat = np.stack([lists.flatten().to_numpy(), np.repeat(t, lengths)], axis=1)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]]) if len(shard) else []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if shard[a] != current:
                        close()
                        current, size = shard[a], 0
                    held.append(flat[edges[a] : edges[b]])
                    size += len(held[-1])
                    if size > GATHERED:
                        held[:] = [distinct()]
                        size = len(held[0]) // 2  # what cannot go may double before it is looked at again
            close()
            yield best.batch(names)

        by_shard = hits.repartition("shard").sortWithinPartitions("shard")
        return top(by_shard.mapInArrow(run, "query_id long, id long, score double"), "query_id", k)

    return by_blocks(q, answer, TEXTS_AT_ONCE)
