"""Columns that show numbers, and parts of names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size_text(n: Column) -> Column:
    """Bytes in steps of 1024 with one decimal, from B to PB."""
    out = None
    for k, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        shown = F.format_string(f"%.1f {unit}", F.bround(n / F.lit(float(1024**k)), 1))
        out = F.when(n < 1024 ** (k + 1), shown) if out is None else out.when(n < 1024 ** (k + 1), shown)
    return out.otherwise(F.format_string("%.1f PB", F.bround(n / F.lit(float(1024**5)), 1)))


def duration_text(s: Column) -> Column:
    """Below a second in ms, below a minute in s with one decimal, then minutes and seconds, then hours and minutes."""
    whole = F.floor(s)
    return (
        F.when(s < 1, F.format_string("%dms", F.floor(s * 1000)))
        .when(s < 60, F.format_string("%.1fs", F.bround(s, 1)))
        .when(s < 3600, F.format_string("%dm %ds", F.floor(whole / 60), whole % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(whole / 3600), F.floor((whole % 3600) / 60)))
    )


def extension(name: Column) -> Column:
    """The lower-cased extension with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]+)$", 0).substr(F.lit(2), F.lit(1000)))


def stem(name: Column) -> Column:
    last = F.regexp_extract(name, r"[^/]*$", 0)
    return F.regexp_replace(last, r"(?<=.)\.[^.]*$", "")


def cost_of_query(text: Column, rows: Column) -> tuple[Column, Column]:
    """(cost, notes) of a logged query. Later rules overrule the cost of earlier ones."""
    q = F.upper(text)
    unlimited = q.contains("ORDER BY") & ~q.contains("LIMIT")
    distinct = q.contains("DISTINCT") & (rows > 100_000)
    grouped = q.contains("GROUP BY") & (rows > 1_000_000)
    cost = F.when(distinct, "high").when(q.contains("JOIN") | grouped, "medium").when(unlimited, "high").otherwise("low")
    notes = F.filter(
        F.array(F.when(unlimited, "add a limit"), F.when(grouped, "group fewer rows"), F.when(q.contains("JOIN"), "check join keys"), F.when(q.contains("SELECT *"), "name the columns"), F.when(distinct, "count approximately")),
        lambda x: x.isNotNull(),
    )
    return cost, notes
