"""Text and table cleaning as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def markdown_to_text(md: Column) -> Column:
    """Headings lose their marks, table rows become cells with ` | ` between, emphasis and code lose their signs,
    blank runs shrink. A separator row that starts with a pipe is a table row like others."""
    cells = lambda line: F.array_join(F.filter(F.transform(F.split(line, r"\|"), lambda c: F.trim(c)), lambda c: c != ""), " | ")
    line = lambda x: F.when(F.startswith(F.trim(x), F.lit("|")), cells(x)).otherwise(F.regexp_replace(x, r"^#+\s*", ""))
    out = F.array_join(F.transform(F.split(md, "\n"), line), "\n")
    for pattern, by in ((r"\n{3,}", "\n\n"), (r" {2,}", " "), (r"\*\*([^*\n]+)\*\*", "$1"), (r"\*([^*\n]+)\*", "$1"), (r"`([^`\n]+)`", "$1")):
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def clean_nan(text: Column) -> Column:
    """Table cells and words that are only `nan` go; runs of blanks shrink, line ends stay."""
    out = F.regexp_replace(text, r"(?i)\|\s*nan\s*\|", "| |")
    return F.regexp_replace(F.regexp_replace(out, r"(?i)\bnan\b", ""), r"[ \t]+", " ")


def clean_nan_lines(text: Column) -> Column:
    """The same, but only in lines without a pipe."""
    fix = lambda x: F.when(x.contains("|"), x).otherwise(F.trim(F.regexp_replace(F.regexp_replace(x, r"(?i)\bnan\b", ""), r"[ \t]+", " ")))
    return F.array_join(F.transform(F.split(text, "\n"), fix), "\n")


def separator_row(columns: Column) -> Column:
    """The line under a table's header, for so many columns."""
    return F.concat(F.lit("|"), F.repeat(F.lit("---|"), columns))


#: Words of a label that make its numbers counts of shares.
SHARE_WORDS = ("shares", "outstanding", "weighted", "dilution", "basic", "common")
#: Words of a label whose numbers are no money.
OTHER_WORDS = (
    "shares", "outstanding", "weighted", "average", "dilution", "basic", "common", "preferred", "treasury", "issued", "authorized",
    "margin", "rate", "ratio", "percentage", "%", "percent", "return", "yield", "growth", "change", "count", "number", "quantity", "units", "volume",
    "multiple", "factor", "index", "score", "days", "months", "years", "quarters", "periods", "employees", "headcount", "locations", "stores",
)
#: Words of a label whose numbers are money.
MONEY_WORDS = (
    "revenue", "sales", "income", "earnings", "expense", "cost", "expenditure", "spending", "profit", "ebitda", "ebit", "software", "consulting", "infrastructure", "financing",
    "hardware", "services", "products", "assets", "liabilities", "equity", "cash", "debt", "receivables", "inventory", "goodwill", "tax", "interest", "s,g&a", "r,d&e", "r&d",
)


def _has_word(label: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(F.arrays_overlap(F.split(F.lower(label), r"\s+"), F.array(*map(F.lit, words))), F.lit(False))


def value_class(value: Column, shown: Column, label: Column) -> Column:
    """percentage, shares or currency, for a number as it is shown beside a label."""
    point = shown.contains(".")
    share = _has_word(label, SHARE_WORDS) & (value >= 100) & (value <= 50_000) & point
    return F.when(shown.contains("%") | ((value >= 0) & (value <= 100) & point), "percentage").when(share, "shares").otherwise("currency")


def is_money(shown: Column, label: Column) -> Column:
    """Whether a bare number is money: by the words of its label (null: none), else by its size and form. Other text and null are not."""
    n = F.regexp_replace(shown, r"[^\d.]", "").try_cast("double")
    bare = shown.rlike(r"^[(\d,.)]+$") & n.isNotNull()
    large = (n >= 10_000) | ((n >= 1000) & shown.rlike(r"^[^.]*\.[^.]{2}$")) | ((n >= 100) & shown.rlike(r"^\(.*\)$"))
    out = bare & ~_has_word(label, OTHER_WORDS) & (value_class(n, shown, label) == "currency") & (_has_word(label, MONEY_WORDS) | large)
    return F.coalesce(out, F.lit(False))


def currency_text(shown: Column, label: Column) -> Column:
    """What is money beside its label gets the sign, `(241)` as `($ 241)` and `1,234` as `$ 1,234`; the rest stays, without blanks around."""
    v = F.regexp_replace(shown, r"^\s+|\s+$", "")
    signed = (
        F.when(v.rlike(r"^\(\d+(,\d{3})*(\.\d+)?\)$"), F.concat(F.lit("($ "), F.substr(v, F.lit(2))))
        .when(v.rlike(r"^\d{1,3}(,\d{3})*(\.\d+)?$"), F.concat(F.lit("$ "), v))
        .otherwise(v)
    )
    return F.when(is_money(v, label), signed).otherwise(v)


def clean_values(values: Column) -> Column:
    """Single digits go; decimals between 0 and 100 get a percent sign."""
    kept = F.filter(values, lambda v: ~v.rlike(r"^\d$"))
    return F.transform(kept, lambda v: F.when(v.rlike(r"^\d+\.\d+$") & (v.cast("double") > 0) & (v.cast("double") < 100), F.concat(v, F.lit(" %"))).otherwise(v))


def join_decimals(values: Column) -> Column:
    """`$ 1` followed by a cell of two digits is one value, `$ 1.96`."""
    last = lambda s: F.element_at(s, -1)
    step = lambda s, v: F.when((F.size(s) > 0) & F.coalesce(last(s).rlike(r"^\$ \d+$"), F.lit(False)) & v.rlike(r"^\d{2}$"), F.concat(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.concat(last(s), F.lit("."), v)))).otherwise(F.concat(s, F.array(v)))
    return F.aggregate(values, F.array().cast("array<string>"), step)


def header_like(cells: Column) -> Column:
    """At least 60 % of the cells are filled, and half of those are text; a cell of `nan` counts as text."""
    filled = F.filter(cells, lambda c: c.isNotNull() & (F.trim(c) != ""))
    text = F.filter(filled, lambda c: ~F.regexp_replace(c, r"[.\-]", "").rlike(r"^\d+$"))
    return (F.size(filled) >= 0.6 * F.size(cells)) & (F.size(text) >= 0.5 * F.size(filled)) & (F.size(filled) > 0)


def column_names(names: list[str]) -> list[str]:
    """First line that is not blank, hard blanks and runs of blanks squeezed, cut at 50 characters, else Column_n."""
    out = []
    for k, n in enumerate(names, 1):
        lines = [" ".join(x.replace("\xa0", " ").split()) for x in n.split("\n")]
        n = next((x for x in lines if x), f"Column_{k}")
        out.append(n if len(n) <= 50 else n[:47] + "...")
    return out


def clean_table(df: DataFrame) -> DataFrame:
    """Columns and rows without a value go; the rest is text, null as the empty string. One aggregate finds the columns."""
    filled = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    kept = df.select(*[F.col(c) for c in df.columns if filled[c]])
    out = kept.na.drop("all").select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in kept.columns])
    return out.toDF(*column_names(out.columns))


def _plain_lines(cell: Column) -> Column:
    """Lines of a cell with a character in them, hard blanks as blanks, without blanks around."""
    lines = F.split(F.replace(F.coalesce(cell, F.lit("")), F.lit("\xa0"), F.lit(" ")), "\n")
    return F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def markdown_cell(cell: Column, line_end: str = "<br>") -> Column:
    """Pipes escaped, lines joined, blanks squeezed; an empty cell, null and `nan` are the empty string."""
    out = F.regexp_replace(F.replace(F.array_join(_plain_lines(cell), line_end), F.lit("|"), F.lit("\\|")), r"\s+", " ")
    return F.when(out == "nan", "").otherwise(out)


def markdown_row(cells: Column) -> Column:
    """One table row of clean cells, empty ones as a blank."""
    shown = F.transform(cells, lambda c: F.when(markdown_cell(c) == "", " ").otherwise(markdown_cell(c)))
    return F.concat(F.lit("| "), F.array_join(shown, " | "), F.lit(" |"))


def text_row(cells: Column) -> Column:
    """Cells that are not empty, those of several lines line by line and indented."""
    several = lambda c: F.transform(_plain_lines(c), lambda x: F.concat(F.lit("  "), x))
    parts = F.transform(cells, lambda c: F.when(c.contains("\n"), several(c)).otherwise(_plain_lines(c)))
    return F.array_join(F.flatten(parts), " | ")


def _sheet(df: DataFrame, order: str) -> tuple[list[str], Column, Column]:
    names = [c for c in df.columns if c != order]
    return names, F.array(*[df[c].cast("string") for c in names]), F.lit(None).cast(df.schema[order].dataType)


def markdown_lines(df: DataFrame, order: str) -> DataFrame:
    """(part, row, line) of a sheet as a markdown table: bold column names (part 0), separator (1), a line a row (2).

    The lines of part 2 stand by `order`, which is no column of the sheet; no row is gathered. An empty sheet is its head.
    """
    names, cells, none = _sheet(df, order)
    bold = F.concat(F.lit("| "), F.array_join(F.array(*[F.concat(F.lit("**"), markdown_cell(F.lit(n), " "), F.lit("**")) for n in names]), " | "), F.lit(" |"))
    head = F.array(F.struct(F.lit(0).alias("part"), bold.alias("line")), F.struct(F.lit(1).alias("part"), F.lit("| " + " | ".join(["---"] * len(names)) + " |").alias("line")))
    top = df.sparkSession.range(1).select(F.inline(head)).select("part", none.alias("row"), "line")
    return top.unionAll(df.select(F.lit(2).alias("part"), df[order].alias("row"), markdown_row(cells).alias("line")))


def text_lines(df: DataFrame, order: str, sheet: str) -> DataFrame:
    """(part, row, line) of a sheet as text: its name, size and `COLUMNS:` line (part 0), then rows by `order` (1), each with a blank line after it.

    Rows without a value have no line but count in the size; an empty sheet says that it has no data.
    """
    names, cells, none = _sheet(df, order)
    columns = " | ".join(names)
    size = F.concat(F.lit(f"Sheet: {sheet}\nDimensions: "), F.col("n").cast("string"), F.lit(f" rows × {len(names)} columns\n\nCOLUMNS: {columns}\n" + "-" * (len(columns) + 10)))
    top = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("part"), none.alias("row"), F.when(F.col("n") == 0, f"Sheet '{sheet}' contains no data.").otherwise(size).alias("line"))
    rows = df.select(F.lit(1).alias("part"), df[order].alias("row"), text_row(cells).alias("line")).where("line <> ''")
    return top.unionAll(rows.withColumn("line", F.concat("line", F.lit("\n"))))
