"""Queries: sources and sinks, profiles, finds, sorts, aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import formats
from tidemill.operators import documents, metrics, profiles
from tidemill.sources import files, jdbc, keyset, statements
from tidemill.storage import table, work_folder

#: Bytes of a text file, about, as each is one row when it is read.
FILE_BYTES = 4 << 20
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- sources and sinks


@query("SELECT * FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderkey LIMIT 5000 OFFSET 1000)")
def chunked_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded slice of a total order."""
    return table(spark, sf_dir, "orders").where("o_totalprice > 1000").select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey").offset(1000).limit(5000)


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 150000 AND o_orderpriority = '1-URGENT' GROUP BY 1")
def param_query(spark, sf_dir):
    """Values are bound, never pasted into the text."""
    text = "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM _orders WHERE o_totalprice > {} AND o_orderpriority = {} GROUP BY 1"
    o, values = {"_orders": table(spark, sf_dir, "orders")}, [150000, "1-URGENT"]
    ways = ((":least", ":priority"), ("%(least)s", "%(priority)s"), ("$1", "$2"), ("?", "?"))
    got = [statements.run(spark, text.format(*w), o, values if w[0][0] in "$?" else {"least": values[0], "priority": values[1]}) for w in ways]
    return got[0].intersect(got[1]).intersect(got[2]).intersect(got[3])


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def bulk_append_roundtrip(spark, sf_dir):
    """Append to a database in batches over four connections, read back by ranges of the key."""
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("the database of this query lives in one process; use sources.jdbc with the address of a server")
    url = f"jdbc:derby:memory:{work_folder(spark, 'db').rsplit('-', 1)[1]};create=true"
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    jdbc.append(rows, url, "customer_copy", connections=4, **driver)
    top = rows.agg(F.max("c_custkey")).first()[0] or 0
    back = jdbc.read(spark, url, "customer_copy", "c_custkey", 0, top + 1, 4, **driver)
    return back.toDF(*[c.lower() for c in back.columns])


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def keyset_read(spark, sf_dir):
    """Orders in a database spread over several addresses, read back in ranges and pages of the key."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice").repartition(4, "o_orderkey")
    at = keyset.write_shards(rows, work_folder(spark, "shards"), "orders", "o_orderkey")
    return keyset.read(spark, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double", at, "orders", "o_orderkey")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS price,
  '{"status":"' || o_orderstatus || '","cust":' || o_custkey || '}' AS info FROM orders""")
def copy_prepare(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return files.copy_ready(o.select("o_orderkey", "o_orderdate", F.col("o_totalprice").cast("decimal(12,2)").alias("price"), F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust")).alias("info")))


@query("SELECT 'csv' AS form, * FROM nation UNION ALL SELECT 'binary', * FROM nation UNION ALL SELECT 'text', * FROM nation")
def export_csv_roundtrip(spark, sf_dir):
    """As CSV, as lines of text with tabs between, and as binary; read back."""
    n, path = table(spark, sf_dir, "nation"), work_folder(spark, "export")
    for form in files.FORMS:
        files.export(n, f"{path}/{form}", form)
    return reduce(DataFrame.unionByName, [files.exported(spark, f"{path}/{form}", form, n.schema).select(F.lit(form).alias("form"), "*") for form in files.FORMS])


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def jsonl_roundtrip(spark, sf_dir):
    return files.by_json(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props"))


@query("SELECT 'd' || (doc_id % 8) AS doc_id, count(*)::BIGINT AS n_docs FROM documents GROUP BY 1")
def text_dir_ingest(spark, sf_dir):
    """Documents written as text files of bounded size in a folder per group, read back with the file's name kept."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id") % 8).alias("doc"), F.regexp_replace("text", r"[\r\n]", " ").alias("value"), "doc_id")
    path = work_folder(spark, "texts")
    files.write_texts(docs, path, "doc", FILE_BYTES, "doc_id")
    good, _ = files.read_texts(spark, f"{path}/doc=*/*")
    named = good.select("text", F.input_file_name().alias("p"))
    lines = named.select(F.regexp_extract("p", "doc=([^/]+)/", 1).alias("doc_id"), (F.size(F.split("text", "\n")) - 1).cast("long").alias("n"))
    return lines.groupBy("doc_id").agg(F.sum("n").alias("n_docs"))


_EXT = "CASE WHEN page_id % 5 = 0 THEN '.txt' WHEN page_id % 5 = 1 THEN '.docx' WHEN page_id % 5 = 2 THEN '.exe' ELSE '.pdf' END"


@query(f"""WITH f AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN '' ELSE 'page' || page_id || {_EXT} END AS name, CASE WHEN page_id % 7 = 0 THEN 0 ELSE strlen(html) END AS size, CASE WHEN page_id % 3 = 0 THEN 'PK' ELSE substr(html, 1, 2) END AS head FROM pages)
SELECT page_id, CASE WHEN name = '' THEN 'no name' WHEN NOT regexp_extract(name, '(\\.[^./]*)$', 1) IN ('.txt', '.docx', '.pdf') THEN 'extension' WHEN size = 0 THEN 'empty' WHEN size > 10000 THEN 'too large' WHEN regexp_extract(name, '(\\.[^./]*)$', 1) = '.docx' AND head <> 'PK' THEN 'not an office file' END AS error FROM f""")
def file_validate(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    m = F.col("page_id") % 5
    ext = F.when(m == 0, ".txt").when(m == 1, ".docx").when(m == 2, ".exe").otherwise(".pdf")
    name = F.when(F.col("page_id") % 11 == 0, "").otherwise(F.concat(F.lit("page"), "page_id", ext))
    size = F.when(F.col("page_id") % 7 == 0, 0).otherwise(F.octet_length("html"))
    head = F.when(F.col("page_id") % 3 == 0, "PK").otherwise(F.substring("html", 1, 2))
    return p.select("page_id", files.intake(name, size, head, [".txt", ".docx", ".pdf"], [".docx"], 10_000).alias("error"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END AS segment, c_name FROM customer")
def csv_ingest_fill(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("segment"), "c_name")
    return files.by_csv(c).na.fill("")


@query("SELECT lang AS collection, count(*)::BIGINT AS n, sum(CASE WHEN lang = 'fr' THEN 2 ELSE 1 END)::BIGINT AS versions FROM documents GROUP BY 1")
def collection_rebuild(spark, sf_dir):
    """Rebuilding one collection leaves the others."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("version"), F.col("lang").alias("collection"))
    path = work_folder(spark, "collections")
    files.rebuild(d, path, "collection")
    files.rebuild(d.where("collection = 'fr'").withColumn("version", F.lit(2)), path, "collection")
    return spark.read.parquet(path).groupBy(F.col("collection").cast("string").alias("collection")).agg(F.count(F.lit(1)).alias("n"), F.sum("version").alias("versions"))


@query("""SELECT vec_id, label + (CASE WHEN vec_id % 3 = 0 THEN 100 ELSE 0 END)::INT AS label, len(embedding)::INT AS dims FROM embeddings""")
def points_upsert(spark, sf_dir):
    from tidemill.operators.changes import upsert

    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    new = e.where("vec_id % 3 = 0").withColumn("label", F.col("label") + 100)
    both = new.withColumn("label", F.lit(-1)).withColumn("seq", F.lit(1)).unionByName(new.withColumn("seq", F.lit(2)))
    return upsert(e, both, "vec_id", "seq").select("vec_id", "label", F.size("embedding").alias("dims"))


@query("SELECT 'doc' || doc_id || '.txt' AS file, text, '# doc' || doc_id || '.txt' || chr(10) || text AS markdown, substr(text, 1, 300) AS text_preview FROM documents")
def parse_output_preview(spark, sf_dir):
    """Text and markdown of each parsed file, written by its full name, with a preview."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), "doc_id", F.lit(".txt")).alias("file"), "text")
    path = work_folder(spark, "parsed")
    files.write_parsed(d.withColumn("markdown", F.concat(F.lit("# "), "file", F.lit("\n"), "text")), path)
    return spark.read.parquet(path)


@query("SELECT event_type, count(*)::BIGINT AS n, sum(event_id)::BIGINT AS ids, min(ts) AS first, round(sum(value), 4) AS total, event_type IN ('click', 'view') AS few FROM events GROUP BY 1")
def compact_table(spark, sf_dir):
    """A table of many files; two of its partitions are compacted in place."""
    path = work_folder(spark, "many")
    table(spark, sf_dir, "events").repartition(16, F.rand(3)).withColumn("_file", F.spark_partition_id()).repartition(16, "_file").drop("_file").write.partitionBy("event_type").parquet(path)
    for kind in ("click", "view"):
        files.compact(spark, path, order=["event_id"], partition={"event_type": kind})
    e = spark.read.parquet(path)
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"), F.min("ts").alias("first"), F.round(F.sum("value"), 4).alias("total"), (F.count_distinct("_metadata.file_path") <= 2).alias("few"))


@query("SELECT strftime(o_orderdate, '%Y%m') AS month, count(*)::BIGINT AS n, min(o_orderkey) AS first_key FROM orders GROUP BY 1")
def monthly_partitioned_write(spark, sf_dir):
    path = work_folder(spark, "months")
    files.write_monthly(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), path, "o_orderdate", ["o_orderdate", "o_orderkey"])
    return spark.read.parquet(path).groupBy(F.col("month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


# ---- profiles


_PROFILED = (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", None), ("o_orderdate", None), ("o_orderpriority", "string"))


def _profile_sql() -> str:
    one = "SELECT '{0}' AS name, {1} AS type, true AS nullable, {2} AS position, count(*)::BIGINT AS n_rows, (count(*) - count({0}))::BIGINT AS n_null, {3} AS least, {4} AS most FROM orders"
    types = {"o_totalprice": "double", "o_orderdate": "timestamp_ntz"}
    # numbers and times are written by each engine in its own way
    shown = {"o_totalprice": ("round(min({0}) * 100)::BIGINT::VARCHAR", "round(max({0}) * 100)::BIGINT::VARCHAR"), "o_orderdate": ("strftime(min({0}), '%Y-%m-%d %H:%M:%S')", "strftime(max({0}), '%Y-%m-%d %H:%M:%S')")}
    parts = []
    for k, (c, t) in enumerate(_PROFILED, 1):
        low, high = (x.format(c) for x in shown.get(c, ("min({0})::VARCHAR", "max({0})::VARCHAR")))
        parts.append(one.format(c, f"'{t or types[c]}'", k, low, high))
    return " UNION ALL ".join(parts)


@query(_profile_sql())
def table_profile(spark, sf_dir):
    """Name, type, nullable, position, rows, nulls, least and most value of each column, in one pass."""
    got = profiles.table_profile(table(spark, sf_dir, "orders").select(*[c for c, _ in _PROFILED]))
    shown = lambda c: F.when(F.col("name") == "o_totalprice", F.round(F.expr(f"try_cast({c} as double)") * 100).cast("long").cast("string")).otherwise(F.col(c))
    return got.withColumn("least", shown("least")).withColumn("most", shown("most"))


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "conversations")


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes) of a table by its folder's listing."""
    return spark.read.format("binaryFile").load(path).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


# SQL sees a table's rows, but not how many files they are in: these and their bytes are held against the listing of the files
@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*)::BIGINT AS n_rows, true AS same_files, true AS same_bytes FROM {t}" for t in _TABLES))
def db_profile(spark, sf_dir):
    """Rows of each table, and whether its files and bytes are those that are listed."""
    paths = {t: f"{sf_dir}/{t}.parquet" for t in _TABLES}
    listed = reduce(DataFrame.unionByName, [_listed(spark, p).withColumn("name", F.lit(t)) for t, p in paths.items()])
    got = profiles.database_profile(spark, paths).join(F.broadcast(listed), "name")
    return got.select("name", "n_rows", (F.col("n_files") == F.col("files")).alias("same_files"), (F.col("n_bytes") == F.col("bytes")).alias("same_bytes"))


@query(f"SELECT {len(_TABLES)}::BIGINT AS n_tables, " + " + ".join(f"(SELECT count(*) FROM {t})" for t in _TABLES) + " AS n_rows, true AS same_bytes")
def db_totals(spark, sf_dir):
    """Tables, rows and megabytes of a database; the bytes are held against those of the files."""
    paths = {t: f"{sf_dir}/{t}.parquet" for t in _TABLES}
    got = profiles.database_totals(profiles.database_profile(spark, paths))
    files_ = reduce(DataFrame.unionByName, [spark.read.format("binaryFile").load(p).select("length") for p in paths.values()]).agg(F.sum("length").alias("bytes"))
    return got.join(F.broadcast(files_)).select("n_tables", "n_rows", ((F.col("n_bytes") == F.col("bytes")) & (F.abs(F.col("megabytes") - F.col("bytes") / (1 << 20)) < 0.01)).alias("same_bytes"))


@query("SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE event_type = 'click')::BIGINT AS clicks, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS errors, count(*) FILTER (WHERE value > 50)::BIGINT AS large FROM events")
def filtered_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 50).alias("large"))


@query("SELECT user_id, round(100.0 * count(*) FILTER (WHERE event_type <> 'error') / count(*), 2) AS ratio FROM events GROUP BY 1")
def hit_ratio(spark, sf_dir):
    good, bad = F.count_if(F.col("event_type") != "error"), F.count_if(F.col("event_type") == "error")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.try_divide(good * F.lit(100.0), good + bad), 2).alias("ratio"))


@query("""SELECT 'customers' AS stat, count(*)::DOUBLE AS value FROM customer UNION ALL SELECT 'segments', count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'mean_balance', round(avg(c_acctbal), 4) FROM customer
UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'largest', max(o_totalprice) FROM orders""")
def stats_batch(spark, sf_dir):
    c = table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).cast("double").alias("customers"), F.count_distinct("c_mktsegment").cast("double").alias("segments"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"))
    o = table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).cast("double").alias("orders"), F.max("o_totalprice").alias("largest"))
    long = lambda df: df.unpivot([], df.columns, "stat", "value")
    return long(c).unionByName(long(o))


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM documents), c AS (SELECT doc_id, unnest(range(0, greatest(1, CAST(ceil((len(ws) - 100) / 412.0) AS BIGINT)))) AS k, ws FROM w)
SELECT count(DISTINCT doc_id)::BIGINT AS n_docs, count(*)::BIGINT AS n_chunks, round(avg(length(array_to_string(ws[k * 412 + 1 : k * 412 + 512], ' '))), 2) AS mean_chars, count(*) > 0 AS search_ready FROM c""")
def collection_stats(spark, sf_dir):
    from tidemill.operators.index import windows

    c = windows(table(spark, sf_dir, "documents"))
    return c.agg(F.count_distinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg(F.length("text")), 2).alias("mean_chars"), (F.count(F.lit(1)) > 0).alias("search_ready"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, floor(l_extendedprice * pow(7, l_linenumber))::BIGINT AS n FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN n < 1024 THEN printf('%.1f B', n::DOUBLE) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576.0::DOUBLE) WHEN n < 1099511627776 THEN printf('%.1f GB', n / 1073741824.0::DOUBLE) ELSE printf('%.1f TB', n / 1099511627776.0::DOUBLE) END AS size FROM x""")
def format_bytes(spark, sf_dir):
    n = F.floor(F.col("l_extendedprice") * F.pow(F.lit(7), F.col("l_linenumber"))).cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", formats.size_text(n).alias("size"))


@query("""WITH x AS (SELECT event_id, floor(value * value * 10) / 8 AS s FROM events)
SELECT event_id, CASE WHEN s < 1 THEN floor(s * 1000)::BIGINT || 'ms' WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN floor(s / 60)::BIGINT || 'm ' || (floor(s)::BIGINT % 60) || 's' ELSE floor(s / 3600)::BIGINT || 'h ' || ((floor(s)::BIGINT % 3600) // 60) || 'm' END AS shown FROM x""")
def format_duration(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", formats.duration_text(F.floor(F.col("value") * F.col("value") * 10) / 8).alias("shown"))


@query("""SELECT event_type AS query, count(*)::BIGINT AS runs, min(floor(epoch(ts))::BIGINT)::BIGINT AS first_start, max(floor(epoch(ts))::BIGINT + floor(value)::BIGINT)::BIGINT AS last_end, round(avg(floor(value)), 4) AS mean_s, max(floor(value))::BIGINT AS max_s,
quantile_cont(floor(value), 0.5) AS p50_s, quantile_cont(floor(value), 0.95) AS p95_s FROM events GROUP BY 1""")
def query_profile(spark, sf_dir):
    """Events as a log: ts is when a query began, value how many seconds it took."""
    start = F.unix_timestamp(F.col("ts").cast("timestamp"))
    log = table(spark, sf_dir, "events").select("event_type", start.alias("start"), (start + F.floor("value")).alias("end"))
    return profiles.query_profile(log, "event_type", "start", "end", exact=True)


_LOG = """CASE o_orderkey % 6 WHEN 0 THEN 'select * from t order by a' WHEN 1 THEN 'SELECT a FROM t GROUP BY a' WHEN 2 THEN 'select a from t join u' WHEN 3 THEN 'select distinct a from t' WHEN 4 THEN 'select a from t order by a limit 5' ELSE 'select 1' END"""


@query(f"""WITH q AS (SELECT o_orderkey, upper({_LOG}) AS q, (o_totalprice * 20)::BIGINT AS n FROM orders),
r AS (SELECT *, contains(q, 'ORDER BY') AND NOT contains(q, 'LIMIT') AS a, contains(q, 'GROUP BY') AND n > 1000000 AS b, contains(q, 'JOIN') AS c, contains(q, 'SELECT *') AS d, contains(q, 'DISTINCT') AND n > 100000 AS e FROM q)
SELECT o_orderkey, CASE WHEN e THEN 'high' WHEN c OR b THEN 'medium' WHEN a THEN 'high' ELSE 'low' END AS cost,
 array_to_string(list_filter([CASE WHEN a THEN 'add a limit' END, CASE WHEN b THEN 'group fewer rows' END, CASE WHEN c THEN 'check join keys' END, CASE WHEN d THEN 'name the columns' END, CASE WHEN e THEN 'count approximately' END], lambda x: x IS NOT NULL), ';') AS notes FROM r""")
def query_lint(spark, sf_dir):
    cost, notes = formats.cost_of_query(F.expr(_LOG), F.round(F.col("o_totalprice") * 20).cast("long"))
    return table(spark, sf_dir, "orders").select("o_orderkey", cost.alias("cost"), F.array_join(notes, ";").alias("notes"))


# ---- finds


@query("SELECT c_custkey, c_name, c_acctbal FROM (SELECT * FROM customer WHERE c_acctbal >= 100 AND (c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_nationkey = 3) AND NOT c_custkey < 10 ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 5)")
def doc_find(spark, sf_dir):
    where = {"c_acctbal": {"$gte": 100}, "$or": [{"c_mktsegment": {"$in": ["BUILDING", "MACHINERY"]}}, {"c_nationkey": 3}], "$not": {"c_custkey": {"$lt": 10}}}
    return documents.find(table(spark, sf_dir, "customer"), where, {"c_custkey": 1, "c_name": 1, "c_acctbal": 1}, ["-c_acctbal", "c_custkey"], 5, 50)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def doc_projection(spark, sf_dir):
    return documents.project(documents.project(table(spark, sf_dir, "orders"), {"o_orderstatus": 0, "o_orderdate": 0, "o_orderpriority": 0}), {"o_orderkey": 1, "o_custkey": 1, "o_totalprice": 1})


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000 ORDER BY c_custkey LIMIT 1")
def find_one(spark, sf_dir):
    return documents.find(table(spark, sf_dir, "customer"), {"c_acctbal": {"$gt": 5000}}, {"c_custkey": 1, "c_name": 1}, ["c_custkey"], 0, 1)


@query("SELECT count(*)::BIGINT AS n FROM orders WHERE o_orderstatus = 'O' AND o_totalprice < 100000")
def doc_count(spark, sf_dir):
    return documents.pipeline(table(spark, sf_dir, "orders"), [{"$match": {"o_orderstatus": "O", "o_totalprice": {"$lt": 100000}}}, {"$count": "n"}])


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def json_path_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").where(documents.json_equals("props", "$.k", 7)).select("event_id")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, event_type IN ('click', 'view') AS listed, user_id % 2 = 0 AS has_key FROM events")
def json_extract(spark, sf_dir):
    """A number out of a JSON column, and whether a JSON array has a text, a JSON document a key."""
    k = F.from_json("props", "k long")["k"]
    tags = F.when(F.col("event_type").isin("click", "view"), F.lit('{"a": {"tags": ["x", "seen"]}}')).otherwise(F.lit('{"a": {"tags": ["seen by none"], "seen": 1}}'))
    keys = F.when(F.col("user_id") % 2 == 0, F.lit('{"seen": null, "y": 2}')).otherwise(F.lit('{"y": "seen"}'))
    e = table(spark, sf_dir, "events").withColumn("tags", tags).withColumn("doc", keys)
    return e.select("event_id", k.alias("k"), documents.json_has("tags", "$.a.tags", "seen").alias("listed"), documents.json_has("doc", "$", "seen").alias("has_key"))


@query("""SELECT o_orderkey, '{"id":' || o_orderkey || ',"status":"' || o_orderstatus || '"}' AS doc FROM orders""")
def json_build(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))).alias("doc"))


@query("SELECT doc_id, lang, 'table' AS by FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) UNION ALL SELECT doc_id, lang, 'list' FROM documents WHERE doc_id IN (3, 14, 159)")
def doc_id_filter(spark, sf_dir):
    """Any of the ids of a table, or of a comma list."""
    d = table(spark, sf_dir, "documents")
    some = documents.with_ids(d, "doc_id", table(spark, sf_dir, "labels").where("quality = 1")).select("doc_id", "lang", F.lit("table").alias("by"))
    return some.unionByName(documents.with_ids(d, "doc_id", " 3,14, ,159,").select("doc_id", "lang", F.lit("list").alias("by")))


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY AND ts < TIMESTAMP '2024-01-20'")
def recent_events(spark, sf_dir):
    as_of = F.lit("2024-01-20").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").where((F.col("ts") >= as_of - F.expr("INTERVAL 7 DAYS")) & (F.col("ts") < as_of)).select("event_id", "user_id")


@query("""SELECT user_id, '{"user":' || user_id || ',"at":"' || strftime(max(ts), '%Y-%m-%dT%H:%M:%S') || '"}' AS doc FROM events GROUP BY 1""")
def doc_serialize(spark, sf_dir):
    nested = table(spark, sf_dir, "events").groupBy("user_id").agg(F.struct(F.col("user_id").alias("user"), F.max("ts").alias("at")).alias("doc"))
    return documents.json_safe(nested).select("user_id", F.to_json("doc").alias("doc"))


# ---- sorts and limits


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey)::INT AS place FROM customer ORDER BY place LIMIT 200")
def sort_spec(spark, sf_dir):
    top = documents.find(table(spark, sf_dir, "customer"), sort=["c_mktsegment", "-c_acctbal", "c_custkey"], limit=200)
    w = Window.orderBy(*documents.sort_columns(["c_mktsegment", "-c_acctbal", "c_custkey"]))  # over 200 rows
    return top.select("c_custkey", F.row_number().over(w).alias("place"))


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders)::BIGINT AS total, ceil((SELECT count(*) FROM orders) / 25)::BIGINT AS total_pages, 3 < ceil((SELECT count(*) FROM orders) / 25) AS has_next, true AS has_previous FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50)")
def paginate(spark, sf_dir):
    return documents.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 3, 25, ["-o_totalprice", "o_orderkey"])


@query("SELECT event_type, count(*)::BIGINT AS n FROM events WHERE ts >= TIMESTAMP '2024-01-13' GROUP BY 1 ORDER BY n DESC, event_type LIMIT 10")
def top_event_types(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-13").cast("timestamp_ntz")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(10)


@query("SELECT user_id, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20")
def top_users(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).orderBy(F.desc("n"), "user_id").limit(20)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def newest_first(spark, sf_dir):
    return documents.find(table(spark, sf_dir, "orders"), fields={"o_orderkey": 1, "o_orderdate": 1}, sort=["-o_orderdate", "o_orderkey"], limit=100)


# ---- aggregations


@query("SELECT c_mktsegment AS segment, n, avg_balance FROM (SELECT c_mktsegment, count(*)::BIGINT AS n, round(avg(c_acctbal), 4) AS avg_balance, avg(c_nationkey) AS x FROM customer WHERE c_acctbal >= 25 GROUP BY 1 ORDER BY avg_balance DESC LIMIT 5)")
def agg_pipeline(spark, sf_dir):
    out = documents.pipeline(table(spark, sf_dir, "customer"), [
        {"$match": {"c_acctbal": {"$gte": 25}}}, {"$group": {"_id": "$c_mktsegment", "avg_balance": {"$avg": "$c_acctbal"}, "avg_nation": {"$avg": "$c_nationkey"}, "n": {"$sum": 1}}},
        {"$sort": {"avg_balance": -1}}, {"$limit": 5},
    ])
    return out.select(F.col("_id").alias("segment"), "n", F.round("avg_balance", 4).alias("avg_balance"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 25")
def agg_project(spark, sf_dir):
    return documents.pipeline(table(spark, sf_dir, "lineitem"), [{"$match": {"l_quantity": {"$gt": 25}}}, {"$project": {"l_orderkey": 1, "l_linenumber": 1, "l_quantity": 1}}])


@query("SELECT o_custkey, array_to_string(list(o_orderkey || ':' || o_orderstatus ORDER BY o_orderkey), ',') AS orders FROM orders GROUP BY 1")
def agg_push(spark, sf_dir):
    got = documents.pipeline(table(spark, sf_dir, "orders"), [{"$group": {"_id": "$o_custkey", "orders": {"$push": {"key": "$o_orderkey", "status": "$o_orderstatus"}}}}])
    return got.select(F.col("_id").alias("o_custkey"), F.array_join(F.transform("orders", lambda o: F.concat(o["key"].cast("string"), F.lit(":"), o["status"])), ",").alias("orders"))


@query("""WITH o AS (SELECT o_custkey, list({'key': o_orderkey, 'status': o_orderstatus, 'price': o_totalprice}) AS orders FROM orders GROUP BY 1),
c AS (SELECT c_custkey, c_mktsegment, c_acctbal, orders FROM customer LEFT JOIN o ON o_custkey = c_custkey),
f AS (SELECT * FROM c WHERE orders IS NULL OR len(list_filter(orders, lambda x: x.status = 'F' AND x.price > 150000)) > 0),
b AS (SELECT CASE WHEN c_acctbal >= 0 AND c_acctbal < 2500 THEN 0 WHEN c_acctbal >= 2500 AND c_acctbal < 5000 THEN 2500 WHEN c_acctbal >= 5000 AND c_acctbal < 7500 THEN 5000 ELSE -1 END AS id, count(*) AS n FROM f GROUP BY 1),
u AS (SELECT c_mktsegment, unnest(CASE WHEN orders IS NULL THEN [NULL] ELSE orders END) AS x FROM f)
SELECT 'balance' AS facet, '{"_id":' || id || ',"n":' || n || '}' AS document FROM b
UNION ALL SELECT 'segment', '{"_id":"' || c_mktsegment || '","count":' || count(*) || '}' FROM f GROUP BY c_mktsegment
UNION ALL SELECT 'orders', '{"_id":"' || c_mktsegment || '","rows":' || count(*) || ',"keys":' || count(x.key) || '}' FROM u GROUP BY c_mktsegment""")
def agg_facets(spark, sf_dir):
    """Customers with no order or a large finished one, by balance, by segment, and with an order a row: facets of one pipeline."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    stages = [
        {"$lookup": {"from": "orders", "localField": "c_custkey", "foreignField": "o_custkey", "as": "orders"}},
        {"$match": {"$or": [{"orders": {"$size": 0}}, {"orders": {"$elemMatch": {"status": "F", "price": {"$gt": 150000}}}}]}},
        {"$facet": {
            "balance": [{"$bucket": {"groupBy": "$c_acctbal", "boundaries": [0, 2500, 5000, 7500], "default": -1, "output": {"n": {"$sum": 1}}}}],
            "segment": [{"$sortByCount": "$c_mktsegment"}],
            "orders": [
                {"$unwind": {"path": "$orders", "preserveNullAndEmptyArrays": True}}, {"$addFields": {"has": {"$cond": [{"$eq": ["$orders.key", None]}, 0, 1]}}},
                {"$group": {"_id": "$c_mktsegment", "rows": {"$sum": 1}, "keys": {"$sum": "$has"}}},
            ],
        }},
    ]
    return documents.pipeline(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), stages, {"orders": orders})


@query("SELECT DISTINCT 'lang' AS field, lang AS value FROM documents UNION ALL SELECT DISTINCT 'word', w FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE length(w) = 3")
def distinct_values(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    words = d.select(F.explode(F.array_distinct(F.filter(F.split("text", " "), lambda w: F.length(w) == 3))).alias("value")).distinct()
    return d.where("lang is not null").select(F.lit("lang").alias("field"), F.col("lang").alias("value")).distinct().unionByName(words.select(F.lit("word").alias("field"), "value"))


@query("SELECT n_name, sum((l_extendedprice)::DECIMAL(10,2))::DECIMAL(20,2)::VARCHAR AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def revenue_by_key(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    small = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    # sums by order first, so the wide joins carry one row an order
    per_order = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(10,2)")).alias("r"))
    return per_order.join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(small, F.col("o_custkey") == F.col("c_custkey")).groupBy("n_name").agg(F.sum("r").cast("decimal(20,2)").cast("string").alias("revenue"))


@query("SELECT count(*)::BIGINT AS n, round(avg(c_acctbal), 4) AS mean FROM customer")
def global_stats(spark, sf_dir):
    return table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


@query("SELECT 'status' AS facet, o_orderstatus AS value, count(*)::BIGINT AS n FROM orders GROUP BY ALL UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY ALL")
def facet_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    sets = o.groupingSets([["o_orderstatus"], ["o_orderpriority"]], "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.grouping("o_orderpriority").alias("g"))
    return sets.select(F.when(F.col("g") == 1, "status").otherwise("priority").alias("facet"), F.when(F.col("g") == 1, F.col("o_orderstatus")).otherwise(F.col("o_orderpriority")).alias("value"), "n")


@query("SELECT user_id, max(floor(epoch(ts)))::BIGINT AS last_used FROM events GROUP BY 1")
def session_last_used(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("last_used"))


@query("""SELECT 'revenue' AS name, round(sum(l_extendedprice), 2) AS value FROM lineitem UNION ALL SELECT 'lines', count(*)::DOUBLE FROM lineitem UNION ALL SELECT 'mean_discount', round(avg(l_discount), 6) FROM lineitem
UNION ALL SELECT 'orders', count(*)::DOUBLE FROM orders UNION ALL SELECT 'returned', count(*)::DOUBLE FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'urgent', count(*)::DOUBLE FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'""")
def kpi_evaluate(spark, sf_dir):
    """Registered formulas, each with its own text; those over one table run as one aggregate."""
    formulas = {
        "revenue": "SELECT round(sum(l_extendedprice), 2) FROM lineitem", "lines": "select count(*) from lineitem", "mean_discount": "SELECT round(avg(l_discount), 6) FROM lineitem", "orders": "SELECT count(1) FROM orders",
        "returned": "SELECT count(*) FROM lineitem WHERE l_returnflag = 'R'", "urgent": "SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'",
    }
    return metrics.evaluate({t: table(spark, sf_dir, t) for t in ("lineitem", "orders")}, formulas)


@query("WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS s FROM orders GROUP BY 1) SELECT month, round(s, 2) AS total, round((s - lag(s) OVER (ORDER BY month)) / lag(s) OVER (ORDER BY month), 6) AS growth FROM m")
def kpi_mom_growth(spark, sf_dir):
    return metrics.growth(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")


@query("""SELECT strftime(l_shipdate, '%Y-%m') AS month, l_returnflag AS flag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(max(l_quantity * l_extendedprice), 2) AS largest, count(*) FILTER (WHERE l_quantity > 25)::BIGINT AS large FROM lineitem GROUP BY 1, 2""")
def agg_expressions(spark, sf_dir):
    """Sums and groups over computed values: products, sums, a time as text, a choice."""
    got = documents.pipeline(table(spark, sf_dir, "lineitem"), [
        {"$addFields": {"net": {"$multiply": ["$l_extendedprice", {"$subtract": [1, "$l_discount"]}]}, "month": {"$dateToString": {"format": "%Y-%m", "date": "$l_shipdate"}}}},
        {"$group": {"_id": {"month": "$month", "flag": "$l_returnflag"}, "revenue": {"$sum": "$net"}, "largest": {"$max": {"$multiply": ["$l_quantity", "$l_extendedprice"]}}, "large": {"$sum": {"$cond": [{"$gt": ["$l_quantity", 25]}, 1, 0]}}}},
        {"$project": {"month": "$_id.month", "flag": "$_id.flag", "revenue": {"$round": ["$revenue", 2]}, "largest": {"$round": ["$largest", 2]}, "large": 1}},
    ])
    return got.select("month", "flag", F.round("revenue", 2).alias("revenue"), F.round("largest", 2).alias("largest"), F.col("large").cast("long").alias("large"))
