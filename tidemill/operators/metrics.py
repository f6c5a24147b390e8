"""Metrics defined by SQL formulas."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.operators import changes
from tidemill.storage import named


def validate(kpis: DataFrame, schema: dict[str, list[str]], formula: str = "formula") -> DataFrame:
    """Adds error: what is wrong with a formula, else null. Tables are the names after FROM (not after JOIN); each
    must be known, and one of its columns must occur in the formula."""
    tables = F.regexp_extract_all(formula, F.lit(r"(?i)\bfrom\s+([a-zA-Z_][a-zA-Z0-9_]*)"), F.lit(1))
    known = F.create_map(*[x for t, cols in schema.items() for x in (F.lit(t), F.array(*map(F.lit, cols)))])
    unknown = F.filter(tables, lambda t: known[t].isNull())
    bare = F.filter(tables, lambda t: ~F.exists(known[t], lambda c: F.col(formula).contains(c)))
    return kpis.withColumn(
        "error",
        F.when(F.coalesce(F.trim(formula), F.lit("")) == "", "empty formula").when(F.size(tables) == 0, "no table")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown table "), F.get(unknown, 0)))
        .when(F.size(bare) > 0, F.concat(F.lit("no known column of "), F.get(bare, 0))),
    )


def register(registry: DataFrame, new: DataFrame, now: Column, order: str) -> DataFrame:
    """registry(name, formula, created_by, created_at) with the metrics of new(name, formula, created_by, order) whose names it lacks.

    Of several with one name the first in order stays; created_at is `now`.
    """
    return changes.insert_ignore(registry, new.withColumn("created_at", now).select(*registry.columns, order), "name", order)


def by_name(registry: DataFrame, name: str) -> DataFrame:
    return registry.where(F.col("name") == name)


def evaluate(tables: dict[str, DataFrame], formulas: dict[str, str]) -> DataFrame:
    """(name, value) of registered formulas, `SELECT expression FROM table` with or without more clauses; a value is one number.

    Formulas without more clauses that share a table are one aggregate over it; each other one is a query by itself.
    """
    simple: dict[str, dict[str, str]] = {}
    parts: list[DataFrame] = []
    for name, text in formulas.items():
        m = re.fullmatch(r"(?is)\s*select\s+((?:(?!\bfrom\b|\bselect\b).)+?)\s+from\s+(\w+)\s*;?\s*", text)
        if m and m[2].lower() in tables:
            simple.setdefault(m[2].lower(), {})[name] = m[1]
            continue
        spark = next(iter(tables.values())).sparkSession
        with named(spark, tables):
            got = spark.sql(text)
        parts.append(got.select(F.lit(name).alias("name"), F.col(f"`{got.columns[0]}`").cast("double").alias("value")))
    for t, own in simple.items():
        values = [F.struct(F.lit(n).alias("name"), F.expr(f).cast("double").alias("value")) for n, f in own.items()]
        parts.append(tables[t].agg(F.array(*values).alias("x")).select(F.inline("x")))
    return reduce(DataFrame.unionByName, parts)


def growth(df: DataFrame, ts: str, value: str) -> DataFrame:
    """(month, total, growth): each month's sum and its change against the month before in the table, as a share of that; null for the first and after a sum of 0."""
    months = df.groupBy(F.date_format(ts, "yyyy-MM").alias("month")).agg(F.sum(value).alias("s"))
    before = F.lag("s").over(Window.orderBy("month"))  # one row a month
    return months.select("month", F.round("s", 2).alias("total"), F.round(F.try_divide(F.col("s") - before, before), 6).alias("growth"))
