"""Queries: document cleaning and table repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions import cleaning, tablefix
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


def _replaced(expr: str, steps) -> str:
    for pattern, by in steps:
        expr = f"regexp_replace({expr}, '{pattern}', '{by}', 'g')"
    return expr


_CELLS = "array_to_string(list_filter(list_transform(string_split(l, '|'), lambda c: trim(c)), lambda c: c <> ''), ' | ')"
_MD = f"array_to_string(list_transform(string_split('# ' || source || chr(10) || '| **' || lang || '** | nan |' || chr(10) || '|---|---|' || chr(10) || chr(10) || chr(10) || chr(10) || text, chr(10)), lambda l: CASE WHEN starts_with(trim(l), '|') THEN {_CELLS} ELSE regexp_replace(l, '^#+\\s*', '') END), chr(10))"


def _markdown(df):
    return F.concat(F.lit("# "), "source", F.lit("\n| **"), "lang", F.lit("** | nan |\n|---|---|\n\n\n\n"), "text")


@query("SELECT doc_id, trim(" + _replaced(_MD, ((r"\n{3,}", r"\n\n"), (" {2,}", " "), (r"\*\*([^*\n]+)\*\*", r"\1"), (r"\*([^*\n]+)\*", r"\1"), (r"`([^`\n]+)`", r"\1"))).replace(r", '\n\n'", ", chr(10) || chr(10)") + ") AS text FROM documents")
def markdown_to_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", cleaning.markdown_to_text(_markdown(d)).alias("text"))


_NAN = "('| nan | NaN|' || text || ' nan end')"


@query("SELECT doc_id, " + _replaced(_NAN, ((r"(?i)\|\s*nan\s*\|", "| |"), (r"(?i)\bnan\b", ""), (r"[ \t]+", " "))) + " AS text FROM documents")
def clean_nan(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.clean_nan(F.concat(F.lit("| nan | NaN|"), "text", F.lit(" nan end"))).alias("text"))


@query("SELECT doc_id, array_to_string(list_transform(string_split(" + _NAN + ", chr(10)), lambda l: CASE WHEN contains(l, '|') THEN l ELSE trim(" + _replaced("l", ((r"(?i)\bnan\b", ""), (r"[ \t]+", " "))) + ") END), chr(10)) AS text FROM documents")
def clean_nan_lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.clean_nan_lines(F.concat(F.lit("| nan | NaN|"), "text", F.lit(" nan end"))).alias("text"))


@query("SELECT n_nationkey, '|' || repeat('---|', (n_nationkey % 6 + 1)::INT) AS line FROM nation")
def md_separator(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", cleaning.separator_row((F.col("n_nationkey") % 6 + 1).cast("int")).alias("line"))


_SHOWN = "CASE l_linenumber % 3 WHEN 0 THEN (l_quantity::INT)::VARCHAR || '.5' WHEN 1 THEN (l_quantity::INT)::VARCHAR || '%' ELSE (l_extendedprice::INT)::VARCHAR END"
_LABEL = "CASE l_orderkey % 2 WHEN 0 THEN 'Basic shares outstanding' ELSE 'Net revenue' END"


def _shown():
    k = F.col("l_linenumber") % 3
    q, p = F.round("l_quantity").cast("int").cast("string"), F.bround("l_extendedprice").cast("int").cast("string")
    return F.when(k == 0, F.concat(q, F.lit(".5"))).when(k == 1, F.concat(q, F.lit("%"))).otherwise(p)


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN contains(s, '%') OR (v BETWEEN 0 AND 100 AND contains(s, '.')) THEN 'percentage' WHEN contains(lab, 'shares') AND v BETWEEN 100 AND 50000 AND contains(s, '.') THEN 'shares' ELSE 'currency' END AS kind
FROM (SELECT l_orderkey, l_linenumber, {_SHOWN} AS s, CASE l_linenumber % 3 WHEN 2 THEN l_extendedprice ELSE l_quantity * 20 END AS v, {_LABEL} AS lab FROM lineitem)""")
def classify_value(spark, sf_dir):
    value = F.when(F.col("l_linenumber") % 3 == 2, F.col("l_extendedprice")).otherwise(F.col("l_quantity") * 20)
    label = F.when(F.col("l_orderkey") % 2 == 0, "Basic shares outstanding").otherwise("Net revenue")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cleaning.value_class(value, _shown(), label).alias("kind"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN k IN (2, 3) OR label = 1 THEN raw WHEN k = 0 AND (label = 0 OR q >= 25) THEN '($ ' || q * 4 || ')' WHEN k = 4 OR (k = 1 AND label = 0) THEN '$ ' || raw ELSE raw END AS shown
FROM (SELECT *, CASE k WHEN 0 THEN '(' || q * 4 || ')' WHEN 1 THEN '1,' || lpad(q::VARCHAR, 3, '0') WHEN 2 THEN q || ' %' WHEN 3 THEN '$ ' || q ELSE '12,' || lpad(q::VARCHAR, 3, '0') || '.50' END AS raw
FROM (SELECT l_orderkey, l_linenumber, l_quantity::INT AS q, l_linenumber % 5 AS k, l_orderkey % 3 AS label FROM lineitem))""")
def format_currency(spark, sf_dir):
    """Money by the label's word, never beside a word of shares, else by size."""
    q, k, label = F.round("l_quantity").cast("int"), F.col("l_linenumber") % 5, F.col("l_orderkey") % 3
    digits = F.lpad(q.cast("string"), 3, "0")
    raw = (
        F.when(k == 0, F.concat(F.lit("("), q * 4, F.lit(")")))
        .when(k == 1, F.concat(F.lit("1,"), digits))
        .when(k == 2, F.concat(q, F.lit(" %")))
        .when(k == 3, F.concat(F.lit("$ "), q))
        .otherwise(F.concat(F.lit("12,"), digits, F.lit(".50")))
    )
    words = F.when(label == 0, "Net revenue").when(label == 1, "Weighted average shares").otherwise("Depreciation")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cleaning.currency_text(raw, words).alias("shown"))


@query("SELECT p_partkey, CASE WHEN length(s) = 2 THEN '$ 1.' || s || ';next' ELSE '$ 1;' || s || ';next' END AS cells FROM (SELECT p_partkey, p_size::VARCHAR AS s FROM part)")
def join_decimals(spark, sf_dir):
    cells = F.array(F.lit("$ 1"), F.col("p_size").cast("string"), F.lit("next"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(cleaning.join_decimals(cells), ";").alias("cells"))


@query("SELECT p_partkey, CASE WHEN length(s) = 1 THEN '' ELSE s || ';' END || s || '.25 %;200.5;x' AS cells FROM (SELECT p_partkey, p_size::VARCHAR AS s FROM part)")
def clean_values(spark, sf_dir):
    s = F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(cleaning.clean_values(F.array(s, F.concat(s, F.lit(".25")), F.lit("200.5"), F.lit("x"))), ";").alias("cells"))


@query("SELECT o_custkey, CASE WHEN bool_or(k % 3 = 0) THEN min(CASE WHEN k % 3 = 0 THEN r END) END AS header_row FROM (SELECT o_custkey, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT - 1 AS r FROM orders) WHERE r < 3 GROUP BY 1")
def detect_header(spark, sf_dir):
    """The first of a sheet's three first rows that looks like a header; an order is a row, every third has texts."""
    from pyspark.sql.window import Window

    r = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("row_no")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.lit("12.5"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", r, F.array(text, text, F.lit("")).alias("cells")).where("row_no < 3")
    return rows.groupBy("o_custkey").agg(F.min(F.when(cleaning.header_like(F.col("cells")), F.col("row_no"))).alias("header_row"))


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, CASE WHEN c_nationkey < 5 THEN '' ELSE c_nationkey::VARCHAR END AS nation FROM customer")
def clean_table(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return cleaning.clean_table(c.select("c_custkey", "c_name", F.when(F.col("c_nationkey") >= 5, F.col("c_nationkey")).alias("nation"), F.lit(None).cast("string").alias("empty")))


@query("""SELECT 0 AS part, NULL::BIGINT AS row, '| **o_orderkey** | **note \\| text** | **empty** |' AS line UNION ALL SELECT 1, NULL, '| --- | --- | --- |'
UNION ALL SELECT 2, o_orderkey, '| ' || o_orderkey || ' | ' || o_orderpriority || '\\|x<br>a b |   |' FROM orders""")
def rows_to_markdown(spark, sf_dir):
    """Orders as a sheet with a column of two lines and one of `nan`."""
    note = F.concat("o_orderpriority", F.lit("|x \n\n a  b"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("row"), "o_orderkey", note.alias("note | text"), F.lit("nan").alias("empty"))
    return cleaning.markdown_lines(o, "row")


@query("""SELECT 0 AS part, NULL::BIGINT AS row, 'Sheet: orders' || chr(10) || 'Dimensions: ' || count(*) || ' rows × 3 columns' || chr(10) || chr(10) || 'COLUMNS: key | empty | note' || chr(10) || repeat('-', length('key | empty | note') + 10) AS line FROM orders
UNION ALL SELECT 1, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey || ' | ' ELSE '' END || '  ' || o_orderpriority || ' |   x' || chr(10) FROM orders WHERE o_orderkey % 3 <> 0""")
def rows_to_text(spark, sf_dir):
    """Orders as a sheet; a third of them have no value."""
    key = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(
        key.cast("long").alias("row"),
        F.when((key % 2 == 0) & (key % 3 != 0), key).alias("key"),
        F.lit(" ").alias("empty"),
        F.when(key % 3 != 0, F.concat("o_orderpriority", F.lit("\n\n x "))).alias("note"),
    )
    return cleaning.text_lines(o, "row", "orders")


@query("SELECT conv_id, array_to_string(list('## ' || turn || chr(10) || text ORDER BY turn), chr(10) || chr(10)) AS text FROM conversations WHERE role <> 'system' GROUP BY 1")
def assemble_parts(spark, sf_dir):
    """Parts in order, each under its head, empty ones dropped."""
    c = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("role") == "system", F.lit("")).otherwise(F.col("text")))
    part = F.struct("turn", F.when(F.trim("text") != "", F.concat(F.lit("## "), "turn", F.lit("\n"), "text")).alias("t"))
    parts = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(part)).alias("p")).withColumn("p", F.filter(F.col("p.t"), lambda x: x.isNotNull()))
    return parts.where("size(p) > 0").select("conv_id", F.array_join("p", "\n\n").alias("text"))


@query()
def md_fix_tables(spark, sf_dir):
    """Order lines as broken markdown tables, repaired."""
    line = lambda x: F.concat(F.lit("| Item "), x["l_linenumber"], F.lit(" | "), x["q"], F.lit(" | $ 1 | 96 | (241) |"))
    # numbers meet, and become text after that
    each = F.collect_list(F.struct("l_linenumber", F.round("l_quantity").cast("int").alias("q")))
    docs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(each.alias("x"))
    lines = F.sort_array(F.transform("x", lambda x: F.struct(x["l_linenumber"], line(x).alias("t"))))
    docs = docs.select("l_orderkey", F.array_join(lines["t"], "\n").alias("rows"))
    text = F.concat(F.lit("Three Months Ended June 30 and what follows it in the report of the year, as a table with some rows of values\n|  | 2024 | 2023 |\n|--|--|\n"), "rows")
    return docs.select("l_orderkey", tablefix.fix_tables()(text).alias("text"))


@query()
def md_split_values(spark, sf_dir):
    """Cells into which several numbers were crammed."""
    cell = F.concat(F.lit("$ "), F.round("l_extendedprice").cast("int"), F.lit(" 12.5 % ("), F.round("l_quantity").cast("int"), F.lit(") 1,234"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", tablefix.split_values()(cell).alias("values"))


@query()
def parse_quarantine(spark, sf_dir):
    """A parser over pages; those it fails on keep their error."""

    def parse(name: str, data: bytes) -> tuple[str, str]:
        text = data.decode()
        if "<article>" not in text:
            raise ValueError("no article")
        body = text.partition("<article>")[2].partition("</article>")[0]
        return body, f"# {name}\n{body}"

    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"))
    return tablefix.parse_all(pages, parse)
