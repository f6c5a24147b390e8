"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "\\x20\\x09-\\x0D"

#: Frequent short words of the languages that the texts are in.
STOP_WORDS = (
    "a", "and", "as", "at", "be", "by", "for", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with",
    "de", "des", "en", "est", "et", "la", "le", "les", "pour", "que", "un", "une",
    "das", "dem", "den", "der", "die", "ein", "ist", "mit", "nicht", "und", "von", "zu",
    "el", "es", "los", "las", "no", "para", "por", "se", "una", "y",
)


@dataclass(frozen=True)
class Rule:
    """Text is rejected where the metric is below least or above most."""

    metric: str
    least: float | None = None
    most: float | None = None


#: name of a ratio -> numerator, denominator (both among the measures of measure()).
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "exclaims_per_word": ("n_exclaims", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_text_lines"),
    "repeat_word_share": ("n_repeat_words", "n_words"),
    "stop_word_share": ("n_stop_words", "n_words"),
}

#: Thresholds for texts of 50 words and more; set far from what plain prose has.
RULES = (
    Rule("n_words", least=50),
    Rule("repeat_word_share", most=0.5),
    Rule("mean_word_chars", least=2, most=12),
    Rule("symbols_per_word", most=0.1),
    Rule("exclaims_per_word", most=0.25),
    Rule("dup_line_share", most=0.5),
    Rule("stop_word_share", least=0.02),
)


def measure(docs: DataFrame, keep: list[Column], text_col: str) -> DataFrame:
    """keep, and the measures of every whole text, made in a chain of projections; null has no words.

    Words are stretches without ASCII white space. Repeated words stand in a window of three words that the
    text has twice or more; the windows are compared by a 64-bit hash of their words, and sorted only
    in texts where some hash comes twice.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    one = docs.select(*keep, text.alias("__text"))
    trimmed = F.btrim("__text", F.lit(" \t\n\x0b\x0c\r"))
    two = one.withColumn("__trim", trimmed).withColumn("__words", F.when(F.col("__trim") == "", F.array().cast("array<string>")).otherwise(F.split("__trim", f"[{SPACE}]+")))
    lines = F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    windows = F.when(F.size("__words") < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size("__words") - 3, F.lit(0))), lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)))
    )
    less = lambda cls: F.octet_length("__text") - F.octet_length(F.regexp_replace("__text", cls, ""))
    three = two.select(
        *[F.col(c) for c in two.columns if c not in ("__trim", "__text", "__words")],
        F.size("__words").cast("long").alias("__n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("__word_chars"),
        less("[#*$%&|<>]").cast("long").alias("__n_symbols"),
        (F.octet_length("__text") - F.octet_length(F.replace("__text", F.lit("!"), F.lit("")))).cast("long").alias("__n_exclaims"),
        F.size(F.filter("__words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("__n_stop_words"),
        lines.alias("__lines"),
        windows.alias("__windows"),
    )
    four = three.withColumn("__n_text_lines", F.size("__lines").cast("long")).withColumn("__n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    # positions of windows whose hash stands beside an equal one in order of (hash, position)
    ordered = F.when(F.size("__windows") > F.size(F.array_distinct("__windows")), F.sort_array(F.arrays_zip(F.col("__windows").alias("h"), F.sequence(F.lit(0), F.size("__windows") - 1).alias("i"))))
    five = four.withColumn("__ordered", ordered).drop("__lines")
    hit = F.filter("__ordered", lambda x, k: F.coalesce((F.get("__ordered", k + 1)["h"] == x["h"]), F.lit(False)) | ((k > 0) & F.coalesce(F.get("__ordered", F.greatest(k - 1, F.lit(0)))["h"] == x["h"], F.lit(False))))
    six = five.withColumn("__at", F.when(F.col("__ordered").isNotNull(), F.sort_array(hit["i"]))).drop("__ordered", "__windows")
    # each window covers its word and up to two more that no later one covers
    covered = F.aggregate(F.transform("__at", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("__at", k + 1) - p, F.lit(3)))), F.lit(0), lambda s, x: s + x)
    return six.withColumn("__n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__at")


def rejected(rules: tuple[Rule, ...]) -> Column:
    """One condition from the threshold table; a ratio over nothing is 0."""
    found = F.lit(False)
    for r in rules:
        if r.metric in RATIOS:
            a, b = RATIOS[r.metric]
            value = F.when(F.col(f"__{b}") > 0, F.col(f"__{a}") / F.col(f"__{b}")).otherwise(F.lit(0.0))
        else:
            value = F.col(f"__{r.metric}")
        if r.least is not None:
            found = found | (value < r.least)
        if r.most is not None:
            found = found | (value > r.most)
    return found


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), one row per input row.

    Null and empty texts have no words and fail. base_failed: fewer than 50 words, or more than half of them
    repeated. kept: base passed, and no rule of the table rejects.
    """
    m = measure(docs, [F.col(id_col).alias("__id")], text_col)
    base = (F.col("__n_words") < 50) | (100 * F.col("__n_repeat_words") > 50 * F.col("__n_words"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return m.select(F.col("__id").alias(id_col), *[F.col(f"__{n}").alias(n) for n in names], base.alias("base_failed"), (~base & ~rejected(rules)).alias("kept"))


def accepted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows that judge() would keep, with all their columns, whatever their names; no shuffle and no join.

    Null and empty texts go; rows that repeat are judged each; the empty table gives no rows.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    # a filter would be moved below the projections, with their expressions copied into it; a column
    # that is not deterministic holds it above them
    m = measure(docs, [whole], text_col).withColumn("__part", F.spark_partition_id())
    base = (F.col("__n_words") < 50) | (100 * F.col("__n_repeat_words") > 50 * F.col("__n_words"))
    return m.where((F.col("__part") >= 0) & ~base & ~rejected(rules)).select("__row.*")
