"""The most similar others of every vector: a similarity join over trained cells.

Cells are spherical k-means centres, fitted on a bounded sample, about twice the root of the rows in number; a vector belongs to the cell
of its nearest centre. How many cells a vector has to be compared in is measured, not set: for some vectors the true
neighbours are found by a scan of all, and the search goes as deep as it must to meet the wanted share of them. Each vector is
first compared in its own cell; of the other cells those are left out whose every vector, by the angle to the centre and the cell's
radius, is less like it than what it has already. Equal vectors are one, so copies cost nothing. Where neighbours are
spread so widely that most cells would have to be searched, all vectors are scanned instead, which moves less.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.operators.retrieve import SCORES, semantic, top
from tidemill.storage import cut
from tidemill.workers import pieces

#: Vectors that centres are fitted on, about, and the least of them for each cell.
SAMPLE, EACH = 65_536, 8
#: Rounds of k-means.
ROUNDS = 6
#: Vectors whose true neighbours set the depth of the search, about.
ASKED = 256
#: Beyond this share of all cells a scan of everything costs less.
SCAN = 0.3
#: Vectors of one side of a comparison.
BLOCK = 1024
#: Parts that copies of one vector are ranked in first.
SPREAD = 64


def matrix(data: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors of packed ones."""
    x = np.frombuffer(b"".join(data), kind).reshape(len(data), -1).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres(sample: np.ndarray, cells: int, seed: int = 3) -> np.ndarray:
    """Spherical k-means from a random start, so where vectors are dense there are many centres."""
    c = sample[np.random.default_rng(seed).choice(len(sample), cells, replace=False)].astype(np.float32)
    x = sample.astype(np.float32)
    for _ in range(ROUNDS):
        own = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        order = np.argsort(own, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(own[order]) > 0])
        sums = np.add.reduceat(x[order], first)
        c[own[order][first]] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c.astype(float)


class Search(NamedTuple):
    """What a search goes by: packed distinct vectors with their cells, the centres and how many cells each vector looks into."""

    homes: DataFrame  # id, vector, cell, near (cosine to the centre)
    centres: np.ndarray
    depth: int
    kind: str


def _packed(vectors: DataFrame) -> tuple[DataFrame, str]:
    """(id, vector as bytes), without rows that have no direction."""
    kind = "<f4" if vectors.schema["vector"].dataType.simpleString() == "array<float>" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1024):
            data = [None if v is None or not any(v) else np.array(v, kind).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(data, pa.binary())], ["id", "vector"])

    rows = vectors.select(F.col("id").cast("long"), "vector").mapInArrow(run, "id long, vector binary")
    return rows.where("id is not null and vector is not null"), kind


def fit(distinct: DataFrame, kind: str, k: int, threshold: float, recall: float) -> Search:
    n = distinct.count()
    seldom = lambda rows, salt: distinct.where(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(max(1, n // rows))) == 0)
    sample = seldom(SAMPLE, 1).select("vector").toArrow()["vector"].to_pylist()  # SAMPLE rows or twice that
    cells = max(1, min(2 * int(n**0.5), len(sample) // EACH))
    c = centres(matrix(sample, kind), cells) if sample else np.zeros((1, 1))

    step = max(1, SCORES // cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, SCORES):
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                near = matrix(part.column(1).to_pylist(), kind) @ c.T
                cell = near.argmax(1)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(cell), pa.array(near[np.arange(len(cell)), cell])], ["id", "vector", "cell", "near"])

    homes = cut(distinct.mapInArrow(run, "id long, vector binary, cell long, near double"), "homes")
    asked = seldom(ASKED, 2).toArrow()
    if not asked.num_rows:
        return Search(homes, c, 1, kind)
    truth = semantic(seldom(ASKED, 2).withColumnRenamed("id", "query_id"), distinct, k + 1, threshold, kind).where("id != query_id")
    where = truth.join(homes.select("id", "cell"), "id").select("query_id", "cell").toArrow()  # (k + 1) times ASKED rows or twice that
    order = np.argsort(-(matrix(asked["vector"].to_pylist(), kind) @ c.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(cells)[None, :].repeat(len(order), 0), 1)
    row = {q: i for i, q in enumerate(asked["id"].to_pylist())}
    ranks = np.sort([place[row[q], cell] for q, cell in zip(where["query_id"].to_pylist(), where["cell"].to_pylist(), strict=True)])
    depth = int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1 if len(ranks) else 1
    return Search(homes, c, depth, kind)


def visits(s: Search, found: DataFrame | None, k: int, threshold: float) -> DataFrame:
    """(id, vector, cell): the cells that each vector is still to be compared in. found: the k best of each so far."""
    sizes = s.homes.groupBy("cell").agg(F.min("near").alias("far")).toArrow()  # a row a cell
    radius = np.zeros(len(s.centres))
    radius[sizes["cell"].to_numpy()] = np.arccos(np.clip(sizes["far"].to_numpy(), -1, 1))
    least = found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_kth"))
    rows = s.homes.join(least, "id", "left").select("id", "vector", "cell", F.when(F.col("_n") >= k, F.greatest(F.col("_kth"), F.lit(threshold))).otherwise(F.lit(float(threshold))).alias("least"))
    c, depth, kind = s.centres, s.depth, s.kind
    step = max(1, SCORES // len(c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, SCORES):
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                near = matrix(part.column(1).to_pylist(), kind) @ c.T
                own, least = part.column(2).to_numpy(), part.column(3).to_numpy()
                # the best that a cell can have: its centre's angle less its radius
                top_of = np.cos(np.maximum(np.arccos(np.clip(near, -1, 1)) - radius[None, :], 0)) + 1e-6
                rank = np.partition(near, len(c) - depth, axis=1)[:, len(c) - depth] if depth < len(c) else np.full(len(near), -2.0)
                goes = (near >= rank[:, None]) & (top_of >= least[:, None])
                goes[np.arange(len(own)), own] = False
                i, cell = np.nonzero(goes)
                take = pa.array(i)
                yield pa.record_batch([part.column(0).take(take), part.column(1).take(take), pa.array(cell)], ["id", "vector", "cell"])

    return rows.mapInArrow(run, "id long, vector binary, cell long")


def compare(asking: DataFrame, homes: DataFrame, k: int, threshold: float, kind: str) -> DataFrame:
    """(query_id, id, score): the k best of each row of asking(id, vector, cell) among those at home in its cell, block by block."""
    count = lambda df, n: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(n))
    blocks = F.broadcast(count(asking, "qs").join(count(homes, "hs"), "cell"))  # a row a cell
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    q = asking.select("id", "vector", "cell").join(blocks, "cell").select("cell", own("qs").alias("i"), upto("hs").alias("j"), F.lit(True).alias("asks"), "id", "vector")
    h = homes.select("id", "vector", "cell").join(blocks, "cell").select("cell", upto("qs").alias("i"), own("hs").alias("j"), F.lit(False).alias("asks"), "id", "vector")

    def best(g: pd.DataFrame) -> pd.DataFrame:
        asks = g["asks"].to_numpy()
        a, b = g[asks], g[~asks]
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        s = np.round(matrix(a["vector"].tolist(), kind) @ matrix(b["vector"].tolist(), kind).T, 6)
        one, two = a["id"].to_numpy(), b["id"].to_numpy()
        s[one[:, None] == two[None, :]] = -2
        # the k-th best and all that are as good, so that ties go by id over all blocks
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if k < s.shape[1] else np.full(len(s), -2.0)
        i, j = np.nonzero(s >= np.maximum(kth, threshold)[:, None])
        order = np.lexsort((two[j], -s[i, j], i))
        i, j = i[order], j[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        return pd.DataFrame({"query_id": one[i[first]], "id": two[j[first]], "score": s[i[first], j[first]]})

    return q.unionByName(h).groupBy("cell", "i", "j").applyInPandas(best, "query_id long, id long, score double")


def _search(distinct: DataFrame, kind: str, k: int, threshold: float, recall: float) -> DataFrame:
    s = fit(distinct, kind, k, threshold, recall)
    if s.depth > SCAN * len(s.centres):
        every = s.homes.select("id", "vector")
        hits = semantic(every.withColumnRenamed("id", "query_id"), every, k + 1, threshold, kind)
        return top(hits.where("id != query_id").drop("rank"), "query_id", k)
    at_home = cut(top(compare(s.homes, s.homes, k, threshold, kind), "query_id", k).drop("rank"), "at_home")
    further = compare(cut(visits(s, at_home, k, threshold), "visits"), s.homes, k, threshold, kind)
    return top(at_home.unionByName(further), "query_id", k)


def similar_all(vectors: DataFrame, k: int, threshold: float, recall: float = 0.95) -> DataFrame:
    """(query_id, id, score, rank): for each of vectors(id, vector) its k most similar others by cosine, at least threshold; ties by id.

    recall is the share of true neighbours that the search has to meet, measured on about ASKED vectors. Rows without an id or a
    vector, and vectors of length 0, are like nothing. Copies of a vector find each other first, those of the smallest ids.
    """
    rows, kind = _packed(vectors)
    rows = cut(rows, "vectors")
    # each distinct vector goes by its smallest id; k + 1 ids stand for all its copies, ranked in parts first
    part = F.pmod(F.xxhash64("id"), F.lit(SPREAD))
    some = rows.withColumn("_r", F.row_number().over(Window.partitionBy("vector", part).orderBy("id"))).where(F.col("_r") <= k + 1)
    copies = some.groupBy("vector").agg(F.min("id").alias("rep"), F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"))  # SPREAD (k + 1) at most
    copies = cut(copies, "distinct")
    found = _search(copies.select(F.col("rep").alias("id"), "vector"), kind, k, threshold, recall)
    same = copies.where(F.size("ids") > 1).select(F.col("rep").alias("query_id"), F.col("rep").alias("id"), F.lit(1.0).alias("score"))
    ids = copies.select(F.col("rep").alias("id"), "ids")
    best = found.drop("rank").unionByName(same).join(ids, "id").select("query_id", "score", F.explode("ids").alias("id"))
    best = top(best, "query_id", k + 1).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("best"))
    # a vector's own copies stand among the k + 1 best, and it is taken out of them
    each = rows.join(copies.select("vector", F.col("rep").alias("_rep")), "vector").select(F.col("id").alias("query_id"), "_rep")
    mine = each.join(best.withColumnRenamed("query_id", "_rep"), "_rep").withColumn("best", F.slice(F.filter("best", lambda b: b["id"] != F.col("query_id")), 1, k))
    out = mine.select("query_id", F.posexplode("best").alias("at", "b")).where(F.col("b.score") >= threshold)
    return out.select("query_id", "b.id", "b.score", (F.col("at") + 1).alias("rank"))
