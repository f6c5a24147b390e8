"""SQL statements with bound values."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemill.storage import named

_QUOTED = r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*"


def run(spark: SparkSession, sql: str, tables: dict[str, DataFrame], values: dict | list | None = None) -> DataFrame:
    """A statement over the given tables. Values are bound, never pasted into the text.

    By name they are :name or %(name)s, by place $1, $2 and so on, or ?. What looks like one within quotes or a comment is text.
    """
    def rewrite(pattern: str, by) -> str:
        return re.sub(f"({_QUOTED})|{pattern}", lambda m: m[1] if m[1] is not None else by(m), sql)

    with named(spark, tables):
        if isinstance(values, dict):
            return spark.sql(rewrite(r"%\((\w+)\)s", lambda m: f":{m[2]}"), args=values)
        if values and re.search(r"\$\d", sql):
            return spark.sql(rewrite(r"\$(\d+)", lambda m: f":p{m[2]}"), args={f"p{i}": v for i, v in enumerate(values, 1)})
        return spark.sql(sql, args=values or [])
