"""Queries: indexing, retrieval, places."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import fulltext, geo, index, neighbours, retrieve, substrings
from tidemill.storage import cut, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')"
_CHUNKS = f"""w AS (SELECT doc_id, {_WORDS} AS ws FROM documents), c AS (SELECT doc_id, k::INT AS chunk_id, array_to_string(ws[k * 412 + 1 : k * 412 + 512], ' ') AS text
 FROM (SELECT doc_id, ws, unnest(range(0, greatest(1, CAST(ceil((len(ws) - 100) / 412.0) AS BIGINT)))) AS k FROM w WHERE len(ws) > 0))"""


@query(f"WITH {_CHUNKS} SELECT * FROM c")
def chunk_windows(spark, sf_dir):
    return index.windows(table(spark, sf_dir, "documents"))


@query()
def chunk_sentences(spark, sf_dir):
    return index.sentences(table(spark, sf_dir, "documents"))


@query()
def chunk_tokens(spark, sf_dir):
    """Sentences in chunks of 512 tokens at most."""
    return index.token_sentences(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def embed_hash(spark, sf_dir):
    return index.embed(index.sentences(table(spark, sf_dir, "documents")), index.hash_embedder())


@query(f"WITH {_CHUNKS} SELECT doc_id, chunk_id, sha256(doc_id || '#' || chunk_id) AS id FROM c")
def build_points(spark, sf_dir):
    return index.points(index.windows(table(spark, sf_dir, "documents"))).select("doc_id", "chunk_id", "id")


@query(f"WITH {_CHUNKS} SELECT (SELECT count(*) FROM documents)::BIGINT AS documents_processed, count(*)::BIGINT AS points_created, count(DISTINCT doc_id)::BIGINT AS documents_indexed, true AS success FROM c")
def index_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    p = cut(index.points(index.windows(d)).select("id", "doc_id"), "points")
    return p.agg(F.count(F.lit(1)).alias("points_created"), F.count_distinct("doc_id").alias("documents_indexed")).join(F.broadcast(d.agg(F.count(F.lit(1)).alias("documents_processed")))).withColumn("success", F.lit(True))


_TOKENS = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) BETWEEN 2 AND 15)"


@query(f"SELECT token, doc_id, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS token FROM documents) GROUP BY ALL")
def inverted_index(spark, sf_dir):
    return index.postings(table(spark, sf_dir, "documents"))


def _questions(spark, sf_dir) -> DataFrame:
    """The benchmark's items, whole, as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), F.col("text").alias("query"))


_Q = "q AS (SELECT item_id::BIGINT AS query_id, text AS query FROM benchmark)"
_V = "v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS vector FROM embeddings), qv AS (SELECT id AS query_id, vector FROM v WHERE id % 50 = 0)"
_COS = "round(list_cosine_similarity(qv.vector, v.vector), 6)"


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every vector, and each fiftieth as a query."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return v, v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector")


@query(f"WITH {_V} SELECT * FROM (SELECT query_id, id, {_COS} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_COS} DESC, id)::INT AS rank FROM v, qv WHERE {_COS} >= 0.1) WHERE rank <= 20")
def semantic_search(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return retrieve.semantic(q, v, 20, 0.1)


_KW = """kt AS (SELECT query_id, list_filter(string_split_regex(lower(query), '\\s+'), lambda x: x <> '') AS ts FROM q), ks AS (SELECT query_id, doc_id AS id, round(len(list_filter(ts, lambda t: contains(lower(text), t))) / len(ts), 6) AS score FROM kt, documents WHERE len(ts) > 0),
kr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM ks WHERE score > 0)"""


@query(f"WITH {_Q}, {_KW} SELECT * FROM kr WHERE rank <= 10")
def keyword_search(spark, sf_dir):
    return retrieve.keyword(_questions(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), 10)


@query(f"WITH {_Q}, {_KW} SELECT * FROM kr WHERE rank <= 10")
def keyword_index(spark, sf_dir):
    """As keyword_search, over an index of parts of words."""
    built = substrings.build(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return substrings.search(_questions(spark, sf_dir), built, 10)


# every question, with one of the query vectors
_PAIRS = "pairs AS (SELECT query_id AS item, query_id % (SELECT count(*) FROM qv) * 50 AS vec FROM q)"
_SR = f"sr AS (SELECT * FROM (SELECT item AS query_id, id, {_COS} AS score, row_number() OVER (PARTITION BY item ORDER BY {_COS} DESC, id) AS rank FROM v, qv JOIN pairs ON vec = qv.query_id WHERE {_COS} >= 0) WHERE rank <= {{}})"
_HY = f"""{_Q}, {_V}, {_KW}, {_PAIRS}, {_SR.format(20)},
kq AS (SELECT query_id, id, score FROM kr WHERE rank <= 10),
hs AS (SELECT query_id, id, round(sum(s), 9) AS score FROM (SELECT query_id, id, score * 0.7 AS s FROM sr UNION ALL SELECT query_id, id, score * (1 - 0.7::DOUBLE) FROM kq) GROUP BY ALL),
hr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hs) WHERE rank <= 10),
re AS (SELECT query_id, id, round(score * CASE WHEN length(text) BETWEEN 100 AND 1000 THEN 1.1::DOUBLE WHEN length(text) < 50 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END, 10) AS score FROM hr JOIN documents ON doc_id = id)"""


def _asked(spark, sf_dir, q: DataFrame) -> DataFrame:
    """(query_id, query, vector): every question with one of the query vectors, whose ids are multiples of 50."""
    n = q.agg(F.count(F.lit(1)).alias("_n"))
    items = _questions(spark, sf_dir).join(F.broadcast(n)).select("query_id", "query", (F.col("query_id") % F.col("_n") * 50).alias("_vec"))
    return items.join(q.withColumnRenamed("query_id", "_vec"), "_vec").drop("_vec")


def _hybrid(spark, sf_dir) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = _asked(spark, sf_dir, q)
    return retrieve.hybrid(retrieve.semantic(asked.select("query_id", "vector"), v, 20), retrieve.keyword(asked.select("query_id", "query"), texts, 10), 10), texts


@query(f"WITH {_HY} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM re")
def hybrid_search(spark, sf_dir):
    hits, texts = _hybrid(spark, sf_dir)
    return retrieve.rerank(hits, texts, 10)


@query(f"""WITH {_Q}, {_KW}, re AS (SELECT query_id, id, round(score * CASE WHEN length(text) BETWEEN 100 AND 1000 THEN 1.1::DOUBLE WHEN length(text) < 50 THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END, 10) AS score FROM kr JOIN documents ON doc_id = id WHERE rank <= 20)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM re) WHERE rank <= 10""")
def rerank(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieve.rerank(retrieve.keyword(_questions(spark, sf_dir), texts, 20), texts, 10)


@query(f"WITH {_V} SELECT * FROM (SELECT query_id, id, {_COS} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_COS} DESC, id)::INT AS rank FROM v, qv WHERE id <> query_id AND {_COS} >= 0.1) WHERE rank <= 5")
def similar_documents(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    hits = retrieve.semantic(q, v, 20, 0.1).where("id <> query_id").drop("rank")
    return retrieve.top(hits, "query_id", 5)


@query()
def similar_all_lsh(spark, sf_dir):
    v, _ = _vectors(spark, sf_dir)
    return neighbours.similar_all(v, 5, 0.1)


@query(f"""WITH {_Q}, p AS (SELECT token, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS token FROM documents) GROUP BY ALL),
t AS (SELECT DISTINCT query_id, unnest({_TOKENS.format('query')}) AS token FROM q), l AS (SELECT doc_id, sum(tf) AS dl FROM p GROUP BY 1), n AS (SELECT count(*) AS n, avg(dl) AS mean FROM l), df AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT query_id, doc_id AS id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))), 5) AS score FROM t JOIN p USING (token) JOIN df USING (token) JOIN l USING (doc_id), n GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM s) WHERE rank <= 10""")
def text_search_bm25(spark, sf_dir):
    return fulltext.search(_questions(spark, sf_dir), fulltext.build(table(spark, sf_dir, "documents")), 10)


_REQUESTS = """rq AS (SELECT item AS query_id, CASE item % 4 WHEN 0 THEN 'semantic' WHEN 1 THEN 'keyword' WHEN 2 THEN 'hybrid' ELSE 'other' END AS method, item % 13 * 9 AS lim, item % 7 / 10.0 AS threshold, item % 11 / 8.0 AS alpha FROM pairs),
rc AS (SELECT *, CASE WHEN method = 'other' THEN 'unknown method' WHEN lim NOT BETWEEN 1 AND 100 THEN 'limit is not from 1 to 100' WHEN threshold > 1 THEN 'threshold is not from 0 to 1' WHEN alpha > 1 THEN 'alpha is not from 0 to 1' END AS error FROM rq)"""


@query(f"""WITH {_Q}, {_V}, {_KW}, {_PAIRS}, {_REQUESTS}, {_SR.format(100)},
sides AS (SELECT query_id, id, score, 'semantic' AS side FROM sr UNION ALL SELECT query_id, id, score, 'keyword' FROM kr WHERE rank <= 100),
bl AS (SELECT rc.query_id, id, lim, threshold, round(sum(score * CASE WHEN method <> 'hybrid' THEN 1.0::DOUBLE WHEN side = 'semantic' THEN alpha::DOUBLE ELSE 1 - alpha::DOUBLE END), 9) AS score FROM sides JOIN rc ON rc.query_id = sides.query_id AND error IS NULL AND (method = 'hybrid' OR side = method) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM bl WHERE score >= threshold)
SELECT rc.query_id, method, rk.id, rk.score, rk.rank, error FROM rc LEFT JOIN rk ON rk.query_id = rc.query_id AND rank <= rk.lim""")
def search_batch(spark, sf_dir):
    """Each question by its own method, limit, threshold and weight; a request with a fault becomes an error row."""
    v, q = _vectors(spark, sf_dir)
    k = F.col("query_id")
    method = F.when(k % 4 == 0, "semantic").when(k % 4 == 1, "keyword").when(k % 4 == 2, "hybrid").otherwise("other")
    asked = _asked(spark, sf_dir, q).select("query_id", "vector", "query", method.alias("method"), (k % 13 * 9).alias("limit"), (k % 7 / 10.0).alias("threshold"), (k % 11 / 8.0).alias("alpha"))
    return retrieve.search(asked, v, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


_LON, _LAT = "(-180 + (({0} * 37) % 360))::DOUBLE", "(-60 + (({0} * 17) % 120))::DOUBLE"
_DIST = "round(2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0, pow(sin((radians({3}) - radians({1})) / 2), 2) + cos(radians({1})) * cos(radians({3})) * pow(sin((radians({2}) - radians({0})) / 2), 2)))), 3)"


def _placed(df: DataFrame, key: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    return df.select(F.col(key), (F.lit(-180) + (F.col(key) * 37) % 360).cast("double").alias(lon), (F.lit(-60) + (F.col(key) * 17) % 120).cast("double").alias(lat))


@query(f"SELECT c_custkey, metres FROM (SELECT c_custkey, {_DIST.format('10.0::DOUBLE', '20.0::DOUBLE', _LON.format('c_custkey'), _LAT.format('c_custkey'))} AS metres FROM customer) WHERE metres <= 3000000 ORDER BY metres, c_custkey LIMIT 25")
def geo_near(spark, sf_dir):
    return geo.near(_placed(table(spark, sf_dir, "customer"), "c_custkey"), 10.0, 20.0, 3_000_000.0, 25, "c_custkey").select("c_custkey", "metres")


@query(f"""WITH s AS (SELECT s_suppkey AS query_id, {_LON.format('s_suppkey')} AS a, {_LAT.format('s_suppkey')} AS b FROM supplier), c AS (SELECT c_custkey AS id, {_LON.format('c_custkey')} AS x, {_LAT.format('c_custkey')} AS y FROM customer)
SELECT * FROM (SELECT query_id, id, -m AS score, row_number() OVER (PARTITION BY query_id ORDER BY m, id)::INT AS rank FROM (SELECT query_id, id, {_DIST.format('a', 'b', 'x', 'y')} AS m FROM s, c) WHERE m <= 1500000) WHERE rank <= 5""")
def geo_join(spark, sf_dir):
    s = _placed(table(spark, sf_dir, "supplier"), "s_suppkey").withColumnRenamed("s_suppkey", "query_id")
    return geo.near_many(s, _placed(table(spark, sf_dir, "customer"), "c_custkey").withColumnRenamed("c_custkey", "id"), 1_500_000.0, 5)


@query(f"""WITH s AS (SELECT s_suppkey AS query_id, {_LON.format('s_suppkey')} AS a, {_LAT.format('s_suppkey')} AS b FROM supplier), c AS (SELECT c_custkey AS id, {_LON.format('c_custkey')} AS x, {_LAT.format('c_custkey')} AS y FROM customer)
SELECT * FROM (SELECT query_id, id, -m AS score, row_number() OVER (PARTITION BY query_id ORDER BY m, id)::INT AS rank FROM (SELECT query_id, id, {_DIST.format('a', 'b', 'x', 'y')} AS m FROM s, c)) WHERE rank <= 20""")
def geo_nearest(spark, sf_dir):
    """The twenty nearest customers of each supplier, however far they are."""
    s = _placed(table(spark, sf_dir, "supplier"), "s_suppkey").withColumnRenamed("s_suppkey", "query_id")
    return geo.near_many(s, _placed(table(spark, sf_dir, "customer"), "c_custkey").withColumnRenamed("c_custkey", "id"), None, 20)
