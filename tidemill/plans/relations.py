"""Queries: joins, windows, upserts and changes, sessions, metrics by formula."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import formats
from tidemill.operators import changes, documents, metrics, sessions
from tidemill.storage import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- joins


@query("SELECT n_name, coalesce(n, 0)::INT AS n_customers, coalesce(first_name, '') AS first_name FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n, min(c_name) AS first_name FROM customer WHERE c_acctbal > 9000 GROUP BY 1) ON c_nationkey = n_nationkey")
def lookup_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select("c_name", "c_nationkey")
    got = documents.pipeline(table(spark, sf_dir, "nation"), [{"$lookup": {"from": "customer", "localField": "n_nationkey", "foreignField": "c_nationkey", "as": "people"}}], {"customer": c})
    return got.select("n_name", F.size("people").alias("n_customers"), F.coalesce(F.get("people", 0)["c_name"], F.lit("")).alias("first_name"))


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey, c_custkey LIMIT 100")
def left_join_topn(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), table(spark, sf_dir, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", "o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey", "c_custkey").limit(100)


@query("SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'hot' ELSE 'durable' END AS origin, count(*)::BIGINT AS turns FROM conversations GROUP BY 1")
def session_read_through(spark, sf_dir):
    """The hot copy of a session where there is one, else the durable one."""
    s = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    hot, durable = s.where("conv_id % 3 = 0").withColumn("origin", F.lit("hot")), s.where("conv_id % 5 <> 0 or conv_id % 3 <> 0").withColumn("origin", F.lit("durable"))
    return sessions.read_through(hot, durable, "conv_id").select("conv_id", "origin", "turns")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_orderkey % (SELECT max(c_custkey) FROM customer) + 1 AS b FROM orders),
r(start, node, depth) AS (SELECT c_custkey, c_custkey, 0 FROM customer WHERE c_custkey % 50 = 0 UNION SELECT r.start, e.b, r.depth + 1 FROM r JOIN e ON e.a = r.node WHERE r.depth < 3)
SELECT start, node, min(depth)::INT AS depth FROM r GROUP BY start, node""")
def graph_lookup(spark, sf_dir):
    """From each fiftieth customer by itself along all orders, each of which leads to the customer that its key gives among all."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    most = c.agg(F.max("c_custkey").alias("most"))
    edges = o.join(F.broadcast(most)).select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % F.col("most") + 1).alias("b"))
    return sessions.expand(edges, c.where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("node")), 3)


# ---- windows


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark, sf_dir):
    return changes.latest(table(spark, sf_dir, "events"), "user_id", F.struct("ts", "event_id")).select("user_id", "event_id", "event_type")


@query("""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 100 = 7 THEN source || '_' || (doc_id % 11) || '.txt' ELSE source || '.txt' END AS name FROM documents),
r AS (SELECT doc_id, name, row_number() OVER (PARTITION BY name ORDER BY doc_id) - 1 AS n FROM f),
t AS (SELECT DISTINCT regexp_extract(name, '^(.*)_([1-9][0-9]*)(\\.txt)$', 1) || '.txt' AS of_, regexp_extract(name, '_([1-9][0-9]*)\\.txt$', 1)::BIGINT AS m FROM f WHERE regexp_matches(name, '_[1-9][0-9]*\\.txt$')),
u AS (SELECT of_, m - row_number() OVER (PARTITION BY of_ ORDER BY m) AS free FROM t)
SELECT doc_id, CASE WHEN n = 0 THEN name ELSE replace(name, '.txt', '') || '_' || (n + (SELECT count(*) FROM u WHERE of_ = name AND free < n)) || '.txt' END AS name FROM r""")
def dedupe_filenames(spark, sf_dir):
    """Repeated names get _1, _2 and so on in order of arrival, but for names that files brought with them."""
    own = F.when(F.col("doc_id") % 100 == 7, F.concat("source", F.lit("_"), F.col("doc_id") % 11, F.lit(".txt"))).otherwise(F.concat("source", F.lit(".txt")))
    return changes.unique_names(table(spark, sf_dir, "documents").select("doc_id", own.alias("name")), "name", "doc_id").select("doc_id", F.col("unique").alias("name"))


@query("""WITH w AS (SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM documents)
SELECT doc_id, unnest(range(0, greatest(1, CAST(ceil((n - 100) / 412.0) AS BIGINT))))::INT AS chunk_id FROM w WHERE n > 0""")
def chunk_ids(spark, sf_dir):
    from tidemill.operators.index import windows

    return windows(table(spark, sf_dir, "documents")).select("doc_id", "chunk_id")


@query("SELECT 'batch' || (doc_id // 10) AS batch, doc_id, length(text)::INT AS n FROM documents")
def batch_texts(spark, sf_dir):
    """Batches of parallel lists of ids and texts become rows; lists of unequal length are refused."""
    d = table(spark, sf_dir, "documents").groupBy(F.concat(F.lit("batch"), F.floor(F.col("doc_id") / 10).cast("long")).alias("batch")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("x"))
    lists = d.select("batch", F.col("x.doc_id").alias("ids"), F.col("x.text").alias("texts"))
    return sessions.zip_lists(lists, "ids", "texts").select("batch", F.col("ids").alias("doc_id"), F.length("texts").alias("n"))


# ---- changes

_C = ["c_custkey", "c_name", "c_acctbal"]


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(*_C)


def _incoming(spark, sf_dir):
    """Two versions of every third customer, half of them under new keys."""
    c = _customers(spark, sf_dir).where("c_custkey % 3 = 0")
    key = F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") + 10_000_000).otherwise(F.col("c_custkey")).alias("c_custkey")
    one = c.select(key, F.concat("c_name", F.lit(" v1")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(1).alias("seq"))
    return one.unionByName(c.select(key, F.concat("c_name", F.lit(" v2")).alias("c_name"), (F.col("c_acctbal") + 2).alias("c_acctbal"), F.lit(2).alias("seq")))


_IN = "SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 10000000 ELSE c_custkey END AS c_custkey, c_name || ' v{0}' AS c_name, c_acctbal + {0} AS c_acctbal FROM customer WHERE c_custkey % 3 = 0"


@query(f"SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT * FROM ({_IN.format(1)}) WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def insert_ignore(spark, sf_dir):
    return changes.insert_ignore(_customers(spark, sf_dir), _incoming(spark, sf_dir), "c_custkey", "seq")


@query(f"SELECT * FROM ({_IN.format(2)}) UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE NOT (c_custkey % 3 = 0 AND c_custkey % 2 <> 0)")
def upsert_rows(spark, sf_dir):
    return changes.upsert(_customers(spark, sf_dir), _incoming(spark, sf_dir), "c_custkey", "seq")


@query("SELECT conv_id, max(turn)::BIGINT AS last_turn, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1")
def session_upsert(spark, sf_dir):
    """Each turn saves its session anew; the last one stays."""
    t = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("last_turn"), F.col("role").alias("last_role"))
    return changes.upsert(t.where("last_turn = 0"), t.withColumn("seq", F.col("last_turn")), "conv_id", "seq")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'F' ELSE o_orderstatus END AS o_orderstatus, (SELECT count(*) FILTER (WHERE o_totalprice > 200000) FROM orders)::BIGINT AS matched, (SELECT count(*) FILTER (WHERE o_totalprice > 200000 AND o_orderstatus <> 'F') FROM orders)::BIGINT AS modified FROM orders UNION ALL SELECT -1, 'new', 0, 0")
def update_many(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    where, new = F.col("o_totalprice") > 200_000, {"o_orderstatus": F.lit("F")}
    some = changes.update_many(o, where, new).select("o_orderkey", "o_orderstatus").join(F.broadcast(changes.update_counts(o, where, new).drop("upserted")))
    # no order has this key, so the row is added
    none = changes.update_many(o, F.col("o_orderkey") == -1, new, {"o_orderkey": -1, "o_orderstatus": "new"}).where("o_orderkey = -1")
    counts = changes.update_counts(o, F.col("o_orderkey") == -1, new, upsert=True).where("upserted = 1").drop("upserted")
    return some.unionByName(none.select("o_orderkey", "o_orderstatus").join(F.broadcast(counts)))


@query("SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_totalprice < 50000)::BIGINT AS deleted, (SELECT count(*) FROM orders WHERE NOT (o_totalprice < 50000))::BIGINT AS \"left\" FROM orders WHERE NOT (o_totalprice < 50000)")
def delete_many(spark, sf_dir):
    o, where = table(spark, sf_dir, "orders"), F.col("o_totalprice") < 50_000
    return changes.delete_many(o, where).select("o_orderkey").join(F.broadcast(changes.delete_counts(o, where)))


@query("""SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 4 = 3
UNION ALL SELECT c_custkey, c_name || ' u', c_acctbal FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT c_custkey, c_name || ' again', c_acctbal FROM customer WHERE c_custkey % 4 = 2
UNION ALL SELECT c_custkey + 10000000, c_name || ' up', c_acctbal FROM customer WHERE c_custkey % 4 = 3""")
def bulk_apply(spark, sf_dir):
    """Updates, deletes, deletes with an insert after, ignored inserts and updates, upserts."""
    c = _customers(spark, sf_dir)
    return changes.apply_changes(c, _operations(c), "c_custkey")


@query("""SELECT count(*) FILTER (WHERE c_custkey % 4 = 2)::BIGINT AS inserted, count(*) FILTER (WHERE c_custkey % 4 = 0)::BIGINT AS updated, count(*) FILTER (WHERE c_custkey % 4 IN (1, 2))::BIGINT AS deleted, count(*) FILTER (WHERE c_custkey % 4 = 3)::BIGINT AS upserted FROM customer""")
def bulk_counts(spark, sf_dir):
    c = _customers(spark, sf_dir)
    return changes.change_counts(c, _operations(c), "c_custkey")


def _operations(c):
    m = F.col("c_custkey") % 4
    say = lambda cond, seq, op, suffix, shift=0: c.where(cond).select((F.col("c_custkey") + shift).alias("c_custkey"), F.concat("c_name", F.lit(suffix)).alias("c_name"), "c_acctbal", F.lit(seq).alias("seq"), F.lit(op).alias("op"))
    parts = [say(m == 0, 1, "insert", " lost"), say(m == 0, 2, "update", " u"), say(m == 1, 1, "delete", ""), say(m == 1, 2, "update", " lost"), say(m == 2, 1, "delete", ""), say(m == 2, 2, "insert", " again"), say(m == 3, 1, "upsert", " up", 10_000_000)]
    ops = parts[0]
    for p in parts[1:]:
        ops = ops.unionByName(p)
    return ops


# ---- sessions and prompts


@query("SELECT conv_id, array_to_string(list(turn || ' ' || role || ': ' || text ORDER BY turn), chr(10)) AS messages FROM conversations GROUP BY 1")
def assemble_sessions(spark, sf_dir):
    s = sessions.assemble(table(spark, sf_dir, "conversations"))
    return s.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["turn"].cast("string"), F.lit(" "), m["role"], F.lit(": "), m["text"])), "\n").alias("messages"))


@query("SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")
def session_delete(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.join(c.where("role = 'system'").select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", "turn")


@query("SELECT conv_id, turn, 'Use this: ' || coalesce((SELECT array_to_string(list(text ORDER BY turn), chr(10)) FROM conversations k WHERE k.conv_id = q.conv_id AND k.role = 'assistant'), '') || chr(10) || 'Question: ' || text AS prompt FROM conversations q WHERE role = 'user'")
def render_prompts(spark, sf_dir):
    """The assistant's turns of a session are the knowledge for its questions."""
    c = table(spark, sf_dir, "conversations")
    knowledge = c.where("role = 'assistant'").groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("turn", "text")))["text"], "\n").alias("k"))
    return c.where("role = 'user'").join(knowledge, "conv_id", "left").select("conv_id", "turn", sessions.render("Use this: {knowledge}\nQuestion: {user_question}", {"knowledge": F.coalesce("k", F.lit("")), "user_question": F.col("text")}).alias("prompt"))


@query("SELECT p_partkey, array_to_string(regexp_extract_all('{' || p_name || '} is {' || p_brand || '} or {}', '\\{([^}]+)\\}', 1), ',') AS names FROM part")
def placeholders(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit("{"), "p_name", F.lit("} is {"), "p_brand", F.lit("} or {}"))
    return p.select("p_partkey", F.array_join(sessions.placeholders(text), ",").alias("names"))


# ---- metrics

_FORMULA = "CASE c_custkey % 5 WHEN 0 THEN 'SELECT SUM(revenue) FROM sales' WHEN 1 THEN 'SELECT 1' WHEN 2 THEN 'SELECT x FROM nowhere' WHEN 3 THEN 'select count(1) from sales' ELSE '' END"


@query(f"SELECT c_custkey, CASE WHEN f = '' THEN 'empty formula' WHEN NOT regexp_matches(f, '(?i)from\\s') THEN 'no table' WHEN contains(f, 'nowhere') THEN 'unknown table nowhere' WHEN contains(f, 'count') THEN 'no known column of sales' END AS error FROM (SELECT c_custkey, {_FORMULA} AS f FROM customer)")
def kpi_validate(spark, sf_dir):
    k = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_FORMULA).alias("formula"))
    return metrics.validate(k, {"sales": ["revenue", "sale_date", "customer_id"], "users": ["id", "name", "email"]}).select("c_custkey", "error")


@query("SELECT * FROM (SELECT c_mktsegment AS name, 'SELECT count(*) FROM customer WHERE c_nationkey = ' || arg_min(c_nationkey, c_custkey) AS formula, min(c_custkey)::VARCHAR AS created_by, TIMESTAMP '2024-05-06 07:08:09' AS created_at FROM customer GROUP BY 1) WHERE name <> 'BUILDING' UNION ALL SELECT 'BUILDING', 'SELECT 1 FROM customer', 'first', TIMESTAMP '2020-01-01'")
def kpi_register(spark, sf_dir):
    """One metric a name: one is registered already, of the others the first to come stays."""
    known = spark.range(1).select(F.lit("BUILDING").alias("name"), F.lit("SELECT 1 FROM customer").alias("formula"), F.lit("first").alias("created_by"), F.expr("timestamp_ntz'2020-01-01 00:00:00'").alias("created_at"))
    formula = F.concat(F.lit("SELECT count(*) FROM customer WHERE c_nationkey = "), "c_nationkey")
    new = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), formula.alias("formula"), F.col("c_custkey").cast("string").alias("created_by"), F.col("c_custkey").alias("seq"))
    every = metrics.register(known, new, F.expr("timestamp_ntz'2024-05-06 07:08:09'"), "seq")
    one = metrics.by_name(every, "BUILDING")
    return one.unionByName(every.where("name <> 'BUILDING'"))


@query("SELECT page_id, regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '[^/]*$') AS last, lower(regexp_extract(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '[^/]*$') || '.HTML', '\\.[^.]*$')) AS extension FROM pages")
def file_parts(spark, sf_dir):
    name = F.concat(F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), "[^/]*$", 0), F.lit(".HTML"))
    return table(spark, sf_dir, "pages").select("page_id", formats.stem(F.concat(F.lit("x"), name)).substr(F.lit(2), F.lit(1000)).alias("last"), formats.extension(F.concat(F.lit("x"), name)).alias("extension"))


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS doubled FROM lineitem")
def batch_apply(spark, sf_dir):
    """A user's function over batches of rows."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return sessions.apply_batches(rows, lambda b: b.assign(doubled=b.pop("l_quantity") * 2), "l_orderkey long, l_linenumber int, doubled double")


