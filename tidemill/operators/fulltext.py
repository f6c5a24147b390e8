"""Full-text search by BM25 over an index that is written once and searched by any number of query tables.

The index has postings in folders by a hash of the token, sorted by token, and documents dealt into blocks by their ids. A search
counts the postings of its words, deals them out by block, and scores a block by matrix products: first the most that each query
can give to a document of the block, then the documents for those queries alone that this is enough for. Tasks get a bounded number of
postings in both, so larger inputs have more tasks, not larger ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import index
from tidemill.operators.retrieve import TEXTS_AT_ONCE, Best, by_blocks, top
from tidemill.storage import cut, work_folder

#: Folders of postings; documents of a block, about; blocks of a task that are scored for all queries before its k-th best rule any out.
FOLDERS, BLOCK_DOCS, FIRST = 32, 256, 4
#: Postings that a task of the build sorts, and one of a search, about; terms whose weights are made at once.
POSTINGS, HITS, COUNTED = 1_000_000, 1_000_000, 2048
#: More than rounding may make of a sum of scores.
SLACK = 1e-4


class Index(NamedTuple):
    """An index in a folder; id_type is the type of its doc_id."""

    spark: SparkSession
    path: str
    id_type: str = "bigint"

    def table(self, name: str) -> DataFrame:
        schema = {"totals": "n long, mean double", "postings": f"token string, doc_id {self.id_type}, block long, gain double, _folder long"}[name]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")


def build(docs: DataFrame, path: str | None = None, k1: float = 1.2, b: float = 0.75) -> Index:
    """Write the index of docs(doc_id, text). Rows that share an id are documents each; null and empty texts are none.

    postings(token, doc_id, block, gain, _folder), totals(n, mean). gain is BM25's part of a posting but for the token's own weight.
    """
    spark = docs.sparkSession
    path = path or work_folder(spark, "fulltext")
    raw = cut(index.postings(docs, lengths=True), "postings")
    totals = raw.where("first").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"))
    totals.coalesce(1).write.parquet(f"{path}/totals")
    written = Index(spark, path, docs.schema["doc_id"].dataType.simpleString())
    n, mean = written.table("totals").first()
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(mean or 1.0)))
    block, folder = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // BLOCK_DOCS))), F.pmod(F.xxhash64("token"), F.lit(FOLDERS))
    # a token that most documents have is dealt by its blocks too; what follows from the rest is made after the shuffle
    dealt = raw.select("token", "doc_id", "tf", "dl").repartitionByRange(max(spark.sparkContext.defaultParallelism, -(-raw.count() // POSTINGS)), folder, "token", block)
    rows = dealt.select("token", "doc_id", block.alias("block"), gain.alias("gain"), folder.alias("_folder"))
    rows.sortWithinPartitions("_folder", "token", "block").write.partitionBy("_folder").parquet(f"{path}/postings")
    return written


def search(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, id, score, rank): the k best documents of queries(query_id, query) by BM25, ties by id. A query's repeated tokens count once; documents without an id are no hits."""
    asked = queries.select(F.col("query_id").cast("long"), "query").where("query_id is not null")
    token = F.array_distinct(F.filter(F.split(F.lower("query"), r"[^\p{L}\p{N}_]+"), lambda t: (F.length(t) >= 2) & (F.length(t) <= 15)))
    n, _ = index.table("totals").first()
    kind = index.table("postings").select("doc_id").limit(0).toArrow().schema.field(0).type

    def answer(block: DataFrame) -> DataFrame:
        found = sorted({(r["token"], r["query_id"]) for r in block.select("query_id", F.explode(token).alias("token")).collect()})  # the words of about TEXTS_AT_ONCE texts
        terms, names = sorted({t for t, _ in found}), np.array(sorted({q for _, q in found}), np.int64)
        place = {t: i for i, t in enumerate(terms)}
        listed = index.spark.createDataFrame(pa.table({"token": pa.array(terms, pa.string()), "t": pa.array(range(len(terms)), pa.int64())}))
        folders = [r[0] for r in listed.select(F.pmod(F.xxhash64("token"), F.lit(FOLDERS))).distinct().collect()]  # FOLDERS at most
        mine = index.table("postings").where(F.col("_folder").isin(folders)).join(F.broadcast(listed), "token")
        df = np.zeros(len(terms), np.int64)
        for t, count in mine.groupBy("t").count().collect():  # a row for each of the words
            df[t] = count
        # the queries of a term are who[start[t] : start[t + 1]]
        who, start = np.searchsorted(names, np.array([q for _, q in found], np.int64)), np.searchsorted(np.array([place[t] for t, _ in found], np.int64), np.arange(len(terms) + 1))
        sent = index.spark.sparkContext.broadcast((who, start, np.log(1 + (n - df + 0.5) / (df + 0.5))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            who, start, idf = sent.value
            best, held, current, closed = Best(len(names), k), [], None, 0

            def weights(some: np.ndarray) -> np.ndarray:
                """What each query, a column, gives for each of the terms."""
                size = start[some + 1] - start[some]
                row = np.repeat(np.arange(len(some)), size)
                out = np.zeros((len(some), len(names)))
                out[row, who[(start[some] - np.cumsum(size) + size)[row] + np.arange(len(row))]] = idf[some][row]
                return out

            def close() -> None:
                nonlocal closed
                if not held:
                    return
                ids, t, gain = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                ids, doc = np.unique(ids, return_inverse=True)
                here, term = np.unique(t, return_inverse=True)
                cell, at = np.unique(term * len(ids) + doc, return_inverse=True)  # rows that share an id
                gain, term, doc = np.bincount(at, gain), cell // len(ids), cell % len(ids)
                edges, most, pieces = np.searchsorted(term, np.arange(len(here) + 1)), np.zeros(len(names)), range(0, len(here), COUNTED)
                tops = np.maximum.reduceat(gain, edges[:-1])
                for a in pieces:
                    most += tops[a : a + COUNTED] @ weights(here[a : a + COUNTED])
                open_ = np.flatnonzero(most + SLACK >= best.kth)
                sums = np.zeros((len(ids), len(open_)))
                for a in pieces if len(open_) else ():
                    some = slice(edges[a], edges[min(a + COUNTED, len(here))])
                    gains = np.zeros((len(ids), len(here[a : a + COUNTED])))
                    gains[doc[some], term[some] - a] = gain[some]
                    sums += gains @ weights(here[a : a + COUNTED])[:, open_]
                scores = np.full((len(ids), len(names)), -np.inf)
                scores[:, open_] = np.where(sums > 0, sums, -np.inf)
                best.add(ids, scores, 0.0, 5)
                closed += 1
                if closed == FIRST:
                    best.settle()

            for batch in batches:
                block, ids, t, gain = batch.columns
                block, t, gain = block.to_numpy(), t.to_numpy(), gain.to_numpy()
                ids = ids.to_numpy() if pa.types.is_integer(ids.type) else np.array(ids.to_pylist())
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]]) if len(block) else []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if block[a] != current:
                        close()
                        current = block[a]
                    held.append((ids[a:b], t[a:b], gain[a:b]))
            close()
            yield best.batch(names, kind)

        hits = mine.where("doc_id is not null").select("block", "doc_id", "t", "gain")
        by_block = hits.repartition(max(index.spark.sparkContext.defaultParallelism, -(-int(df.sum()) // HITS)), "block").sortWithinPartitions("block")
        return top(by_block.mapInArrow(run, f"query_id long, id {index.id_type}, score double"), "query_id", k)

    return by_blocks(asked, answer, TEXTS_AT_ONCE)
