"""Queries: streams, run until all input is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.storage import table, work_folder
from tidemill.streaming import feeds

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_SCHEMA = "event_id long, user_id long, event_type string, value double, ts timestamp_ntz"


def _events(spark, sf_dir, parts: int = 6):
    """Events dealt to files, so that a stream reads them in several batches."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    path = work_folder(spark, "feed")
    e.repartitionByRange(parts, "event_id").write.parquet(path)
    return feeds.folder_stream(spark, path, _SCHEMA)


@query("SELECT event_id, user_id, c_name FROM events LEFT JOIN customer ON c_custkey = user_id WHERE event_type = 'purchase' AND value > 20")
def stream_watch(spark, sf_dir):
    """Every event comes twice in the feed; it is passed on once."""
    now = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    path, out = work_folder(spark, "feed"), work_folder(spark, "watched")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    e.union(e).repartitionByRange(6, "event_id").write.parquet(path)
    seen = feeds.once(feeds.folder_stream(spark, path, _SCHEMA), ["event_id"], "ts", "365 days")
    feeds.drain(feeds.watch(seen, (F.col("event_type") == "purchase") & (F.col("value") > 20), now, "user_id").select("event_id", "user_id", "c_name"), path=out)
    return spark.read.schema("event_id long, user_id long, c_name string").parquet(out)


@query("SELECT user_id, value FROM (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE event_type <> 'view') WHERE r = 1 AND event_type <> 'error'")
def stream_cdc_apply(spark, sf_dir):
    """Errors delete a user's row, other events write it; views change nothing."""
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "none").otherwise("upsert")
    feed = _events(spark, sf_dir).select("user_id", F.col("event_id").alias("seq"), op.alias("op"), "value")
    return feeds.apply_feed(feed, spark.createDataFrame([], "user_id long, value double"), "user_id")


@query("""WITH a AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 10 <> 3), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 4 THEN -1.0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 10 <> 5)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'insert' WHEN b.o_orderkey IS NULL THEN 'delete' ELSE 'update' END AS op, a.o_totalprice AS was, b.o_totalprice AS is_now FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_totalprice IS DISTINCT FROM b.o_totalprice""")
def table_deltas(spark, sf_dir):
    """What changed between two states of a table."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    last = F.col("o_orderkey") % 10
    old, new = o.where(last != 3), o.where(last != 5).withColumn("o_totalprice", F.when(last == 4, -1.0).otherwise(F.col("o_totalprice")))
    return feeds.deltas(old, new, "o_orderkey").select("o_orderkey", "op", F.col("before.o_totalprice").alias("was"), F.col("after.o_totalprice").alias("is_now"))


@query("SELECT user_id, ts AS last_used, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def stream_session_state(spark, sf_dir):
    return feeds.session_state(_events(spark, sf_dir), "user_id", "ts", ["event_id", "event_type"])


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text || CASE WHEN doc_id % 3 = 0 THEN ' sent again' ELSE '' END, '\\s+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id % 3 = 0 OR doc_id % 3 <> 0),
k AS (SELECT doc_id, ws, unnest(range(0, greatest(1, CAST(ceil((len(ws) - 100) / 412.0) AS BIGINT)))) AS k FROM w WHERE len(ws) > 0)
SELECT sha256(doc_id || '#' || k) AS id, doc_id, k::INT AS chunk_id, sha256(array_to_string(ws[k * 412 + 1 : k * 412 + 512], ' ')) AS text FROM k""")
def stream_index(spark, sf_dir):
    """Documents arrive in batches; every third comes again with another text, which takes the place of the first."""
    path, out = work_folder(spark, "arrivals"), work_folder(spark, "index")
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    again = d.where("doc_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" sent again")))
    for k, part in enumerate((d, again)):
        part.repartition(4).write.parquet(f"{path}/wave={k}")
    state = work_folder(spark, "state")
    for k in range(2):  # the second run goes on with the table of the first
        points = feeds.index_feed(feeds.folder_stream(spark, f"{path}/wave={k}", "doc_id long, text string"), out, f"{state}-{k}", 10 * k)
    return points.select("id", "doc_id", "chunk_id", F.sha2("text", 256).alias("text"))
