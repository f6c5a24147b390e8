"""Batch retrieval: a table of queries against a table of chunks or vectors.

Queries are taken in blocks of bounded size, which are sent to every task; a task goes over its rows once and only keeps the k best
rows of each query, so neither pairs of queries and rows nor all scores of a query ever meet anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.storage import cut
from tidemill.workers import pieces

#: Rows of a queries table, about, that are sent to every task at once; longer tables go block by block.
QUERIES_AT_ONCE = 4096
#: Queries by words whose word counts are sent to every task at once.
TEXTS_AT_ONCE = 512
#: Scores of rows and queries that a task makes at once.
SCORES = 1_000_000
#: Different words of texts that a task remembers at most, and the length up to which it does.
REMEMBERED, LONGEST = 200_000, 60
#: Bounds of a search request.
METHODS, MOST_HITS = ("semantic", "keyword", "hybrid"), 100


def by_blocks(queries: DataFrame, answer: Callable[[DataFrame], DataFrame], at_once: int | None = None) -> DataFrame:
    """answer(queries), whose argument is small enough to be sent to every task.

    More than at_once rows are dealt into blocks by query_id and answered one after another; rows of a
    query stay together, so each block's answers are whole.
    """
    blocks = -(-queries.count() // (at_once or QUERIES_AT_ONCE))
    if blocks <= 1:
        return answer(queries)
    dealt = cut(queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "queries")
    return reduce(DataFrame.unionByName, [cut(answer(dealt.where(F.col("_block") == i).drop("_block")), "answers") for i in range(blocks)])


def top(df: DataFrame, key: str, k: Column | int, score: str = "score", tie: str = "id") -> DataFrame:
    """The k best rows of each key, ties by id, with their rank. Each task keeps its own k best before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.desc(score), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Best:
    """The k best (score, id) of each of n queries so far; ties by id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.q, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        # the k-th best score of each query when it was last looked at; rows found since then
        self.kth, self.held, self.size = np.full(n, -np.inf), [], 0

    def add(self, ids: np.ndarray, scores: np.ndarray, least: float, digits: int | None = None) -> None:
        """scores: a row for each id, a column for each query; those below least do not count, nan never. With digits, scores are rounded where they may count."""
        rounded = (lambda x: x) if digits is None else (lambda x: np.round(x, digits))
        bar = np.maximum(least, self.kth)
        if len(ids) > self.k and len(open_ := np.flatnonzero(np.isneginf(self.kth))):
            kth = rounded(np.partition(scores[:, open_], len(ids) - self.k, axis=0)[len(ids) - self.k])
            bar[open_] = np.maximum(bar[open_], np.where(np.isnan(kth), -np.inf, kth))
        row, q = np.nonzero(scores >= (bar if digits is None else bar - 10.0**-digits))
        score = rounded(scores[row, q])
        row, q, score = (x[score >= bar[q]] for x in (row, q, score))
        self.held.append((q, ids[row], score))
        self.size += len(q)
        if self.size > self.n * self.k:
            self.settle()

    def settle(self) -> None:
        q, at, score = (np.concatenate(x) for x in zip((self.q, self.id, self.score), *self.held, strict=True))
        order = np.lexsort((at, -score, q))
        q, at, score = q[order], at[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.q, self.id, self.score = (x[place < self.k] for x in (q, at, score))
        self.kth[q[place == self.k - 1]] = score[place == self.k - 1]
        self.held, self.size = [], 0

    def batch(self, names: np.ndarray, kind: pa.DataType | None = None) -> pa.RecordBatch:
        """What is left; kind: the type of the ids, where they are not long."""
        self.settle()
        return pa.record_batch([pa.array(names[self.q], pa.int64()), pa.array(self.id.tolist(), kind or pa.int64()), pa.array(self.score, pa.float64())], ["query_id", "id", "score"])


def _scan(rows: DataFrame, names: np.ndarray, k: int, score: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], least: float, digits: int | None = None) -> DataFrame:
    """The k best of each query over all rows: each task's best first, then those of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(names), k)
        for batch in pieces(batches, max(1, SCORES // len(names))):
            for ids, scores in score(batch):
                best.add(ids, scores, least, digits)
        yield best.batch(names)

    return top(rows.mapInArrow(run, "query_id long, id long, score double"), "query_id", k)


def _unit(vectors: pa.Array, kind: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(which of vectors, lists or packed, have a direction, these scaled to length 1)."""
    x = np.frombuffer(b"".join(vectors.to_pylist()), kind).reshape(len(vectors), -1).astype(float) if kind else np.array(vectors.to_pylist(), float)
    n = np.linalg.norm(x, axis=1) if len(x) else np.zeros(0)
    has = np.flatnonzero(n > 0)
    return has, x[has] / n[has, None]


def semantic(queries: DataFrame, vectors: DataFrame, k: int, threshold: float = 0.0, kind: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): cosine of queries(query_id, vector) and vectors(id, vector), at least threshold.

    Rows without a vector, and vectors of length 0, are like nothing. kind: the numbers of vectors that are packed as bytes.
    """
    q = queries.where("vector is not null").select(F.col("query_id").cast("long"), "vector")
    v = vectors.where("vector is not null").select(F.col("id").cast("long"), "vector")

    def answer(block: DataFrame) -> DataFrame:
        asked = block.toArrow()  # at most about QUERIES_AT_ONCE rows
        has, matrix = _unit(asked["vector"].combine_chunks(), kind) if asked.num_rows else (np.zeros(0, int), None)
        if not len(has):
            return top(v.limit(0).select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score")), "query_id", k)
        names, sent = asked["query_id"].to_numpy()[has], v.sparkSession.sparkContext.broadcast(matrix)

        def score(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            has, rows = _unit(batch.column(1), kind)
            if len(has):
                yield batch.column(0).to_numpy()[has], rows @ sent.value.T

        return _scan(v, names, k, score, threshold, 6)

    return by_blocks(q, answer)


class Finder:
    """Which of the terms are in a text. A term has no white space, so it lies within a word; what a word has is remembered."""

    def __init__(self, terms: list[str]):
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.known: dict[bytes, list[int]] = {}

    def within(self, word: bytes) -> list[int]:
        return sorted({i for _, i in self.automaton.iter(word.decode())})

    def __call__(self, text: str) -> np.ndarray:
        found: set[int] = set()
        for word in set(text.encode().split()):  # at ASCII white space, as the terms are
            if (at := self.known.get(word)) is None:
                at = self.within(word)
                if len(word) <= LONGEST:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    self.known[word] = at
            found.update(at)
        return np.fromiter(found, np.int64, len(found))


def keyword(queries: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): the share of a query's words (repeats count) that occur in the text, as parts of words too.

    Each text is searched once for the words of all queries of a block. Queries without a word have no hits, null texts neither.
    """
    q = queries.select(F.col("query_id").cast("long"), F.filter(F.split(F.lower("query"), r"\s+"), lambda x: x != "").alias("_terms")).where("size(_terms) > 0")
    rows = texts.where("text is not null").select(F.col("id").cast("long"), F.lower("text").alias("text"))

    def answer(block: DataFrame) -> DataFrame:
        asked = block.collect()  # at most about TEXTS_AT_ONCE rows
        terms = sorted({t for r in asked for t in r["_terms"]})
        place = {t: i for i, t in enumerate(terms)}
        names, counts = np.array([r["query_id"] for r in asked], np.int64), np.zeros((len(terms), len(asked)), np.float32)
        for j, r in enumerate(asked):
            np.add.at(counts[:, j], [place[t] for t in r["_terms"]], 1)
        sent = rows.sparkSession.sparkContext.broadcast((terms, counts, counts.sum(0).astype(float)))
        finders: list[Finder] = []  # one a task

        def score(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            words, of, total = sent.value
            if not finders:
                finders.append(Finder(words))
            hits = np.stack([of[finders[0](t.as_py())].sum(0, dtype=float) for t in batch.column(1)])
            yield batch.column(0).to_numpy(), np.round(hits / total, 6)

        return _scan(rows, names, k, score, np.nextafter(0, 1))

    return by_blocks(q, answer, TEXTS_AT_ONCE)


def checked(requests: DataFrame) -> DataFrame:
    """Adds error: what is wrong with a search request (method, limit, threshold, alpha), else null; the first fault counts.

    A limit is from 1 to MOST_HITS, threshold and alpha are from 0 to 1; null is no valid value.
    """
    within = lambda c, low, high: F.coalesce(F.col(c).between(low, high), F.lit(False))
    return requests.withColumn(
        "error",
        F.when(~F.coalesce(F.col("method").isin(*METHODS), F.lit(False)), "unknown method").when(~within("limit", 1, MOST_HITS), f"limit is not from 1 to {MOST_HITS}")
        .when(~within("threshold", 0, 1), "threshold is not from 0 to 1").when(~within("alpha", 0, 1), "alpha is not from 0 to 1"),
    )


def search(requests: DataFrame, vectors: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, method, id, score, rank, error): each of requests(query_id, vector, query, method, limit, threshold, alpha) by its own method.

    A request with a fault is one row with its error; one without hits is one row without id. Hybrid search blends the MOST_HITS best of
    either side. The threshold holds for the final score.
    """
    asked = cut(checked(requests), "requests")
    good = asked.where("error is null")
    of = lambda *names: good.where(F.col("method").isin(*names))
    s = cut(semantic(of("semantic", "hybrid"), vectors, MOST_HITS), "semantic")
    w = cut(keyword(of("keyword", "hybrid"), texts, MOST_HITS), "keyword")
    mode = good.select("query_id", "method", "alpha")
    parts = s.select("query_id", "id", "score", F.lit("semantic").alias("_side")).unionByName(w.select("query_id", "id", "score", F.lit("keyword").alias("_side")))
    share = F.when(F.col("method") != "hybrid", 1.0).when(F.col("_side") == "semantic", F.col("alpha")).otherwise(1 - F.col("alpha"))
    blended = parts.join(mode, "query_id").groupBy("query_id", "id").agg(F.round(F.sum(F.col("score") * share), 9).alias("score"))
    limits = good.select("query_id", "limit", "threshold")
    hits = top(blended.join(limits, "query_id").where("score >= threshold"), "query_id", F.col("limit")).select("query_id", "id", "score", "rank")
    return asked.select("query_id", "method", "error").join(hits, "query_id", "left").select("query_id", "method", "id", "score", "rank", "error")


def hybrid(semantic_hits: DataFrame, keyword_hits: DataFrame, k: int, alpha: float = 0.7) -> DataFrame:
    """alpha of the semantic score and the rest of the keyword score, a missing side as 0; one shuffle for both."""
    both = semantic_hits.select("query_id", "id", (F.col("score") * alpha).alias("s")).unionByName(keyword_hits.select("query_id", "id", (F.col("score") * (1 - alpha)).alias("s")))
    return top(both.groupBy("query_id", "id").agg(F.round(F.sum("s"), 9).alias("score")), "query_id", k)


def rerank(hits: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Texts of 100 to 1000 characters gain a tenth, those under 50 lose one; then the k best."""
    n = F.length("text")
    factor = F.when((n >= 100) & (n <= 1000), 1.1).when(n < 50, 0.9).otherwise(1.0)
    joined = hits.drop("rank").join(texts.select("id", "text"), "id").withColumn("score", F.round(F.col("score") * factor, 10)).drop("text")
    return top(joined, "query_id", k)
