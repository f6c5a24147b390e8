"""Repair of markdown tables, and pluggable parsers: rules that depend on each other's results, in vectorised functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.cleaning import MONEY_WORDS, OTHER_WORDS, SHARE_WORDS
from tidemill.workers import pieces

#: Documents below this length stay as they are.
SHORT = 100
#: Lines whose kind and repair a Python worker remembers, and the length up to which it does.
REMEMBERED, LONGEST = 50_000, 400
#: Values of a row.
WIDTH = 4
#: Words of a table's head.
DATE_WORDS = ("months ended", "year ended", "quarter", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Words in the first cell of a section row.
SECTION_WORDS = ("revenue", "gross profit", "expense", "income", "earnings", "shares outstanding", "discontinued operations", "cash flow", "balance sheet", "assets", "liabilities", "equity")
#: Parts of a label whose row is one of money, and whose plain or grouped numbers are.
ROW_PARTS = ("revenue", "income", "profit", "expense", "cost", "tax", "software", "consulting", "infrastructure", "financing", "other", "total", "gross", "net", "s,g&a", "r,d&e", "interest")
PLAIN_PARTS = ("other", "revenue", "income", "expense")
GROUPED_PARTS = ("revenue", "income", "expense", "profit", "total")
#: What a crammed cell may hold, most specific first.
NUMBERS = (
    r"\$\s*\d+\.\d+",
    r"\(\s*\$?\s*\d+\.\d+\s*\)",
    r"\d+\.\d+\s*%",
    r"\$\s*[\d,]+",
    r"\(\s*\$?\s*[\d,]+\s*\)",
    r"\d+\s*%",
    r"\b\d{1,3}(?:,\d{3})*\.\d+\b",
    r"\b\d{1,3}(?:,\d{3})*\b",
)
_YEARS = r"(?:19|20)\d\d"


def spaced(value: str) -> str:
    """`$1` as `$ 1` if there was a blank, `( 1 )` and `($1)` as `($ 1)`."""
    value = re.sub(r"^\$\s+", "$ ", value.strip())
    inner = re.fullmatch(r"\(\s*\$?\s*(.*?)\s*\)", value)
    return f"($ {inner[1]})" if inner else value


def split_numbers(cell: str) -> list[str]:
    """The numbers of a cell in order of pattern; each that is new leaves the text before the next pattern, repeats stay in it.

    A cell without a number gives its words of more than one sign, an empty one the empty string.
    """
    out: list[str] = []
    for p in NUMBERS:
        for found in re.findall(p, cell):
            if (value := spaced(found)) not in out:
                out.append(value)
                cell = cell.replace(found, " ", 1)
    return out or list(dict.fromkeys(w for w in cell.split() if len(w) > 1)) or [""]


def cells_of(line: str) -> list[str]:
    cells = [c.strip() for c in line.strip().split("|")]
    while cells and not cells[0]:
        cells.pop(0)
    while cells and not cells[-1]:
        cells.pop()
    return cells


def is_separator(line: str) -> bool:
    return bool(re.fullmatch(r"\s*\|?[\s:|-]*-[\s:|-]*\|?\s*", line)) and "|" in line


def join_decimals(values: list[str]) -> list[str]:
    """`$ 1` or a number of up to two digits, and a cell of two digits after it, are one value: `$ 1.96`, `1.96`."""
    out: list[str] = []
    for v in values:
        if out and re.fullmatch(r"\$\s*\d+|\d{1,2}", out[-1]) and re.fullmatch(r"\d{2}", v):
            out[-1] = f"{re.sub(r'^[$]\s*', '$ ', out[-1])}.{v}"
        else:
            out.append(v)
    return out


def is_section(label: str, values: list[str]) -> bool:
    """A label alone (values empty or nan), or one of section words in capitals of any kind that has no number beside it."""
    if all(not v or v.lower() == "nan" for v in values):
        return True
    known = any(w in label.lower() for w in SECTION_WORDS)
    return known and (label.isupper() or label.istitle()) and not any(re.search(r"\d", v) for v in values)


def is_money(v: str, label: str) -> bool:
    """Whether a bare number is money: by the words of its label, else by its size and form."""
    if not re.fullmatch(r"[(\d,.)]+", v) or not re.fullmatch(r"\d+\.?\d*|\.\d+", digits := re.sub(r"[^\d.]", "", v)):
        return False
    n, words = float(digits), set(label.lower().split())
    share = not words.isdisjoint(SHARE_WORDS) and 100 <= n <= 50_000 and "." in v
    if not words.isdisjoint(OTHER_WORDS) or share or (n <= 100 and "." in v):
        return False
    return not words.isdisjoint(MONEY_WORDS) or n >= 10_000 or (n >= 1000 and len(v.partition(".")[2]) == 2) or (n >= 100 and v[0] == "(" and v[-1] == ")")


def money(v: str) -> str:
    if re.fullmatch(r"\(\d+(?:,\d{3})*(?:\.\d+)?\)", v):
        return f"($ {v[1:]}"
    return f"$ {v}" if re.fullmatch(r"\d{1,3}(?:,\d{3})*(?:\.\d+)?", v) else v


def clean_value(v: str, label: str) -> str | None:
    """Single digits are fragments (None); money gets its sign; a plain decimal between 0 and 100 that is left is per cent."""
    if re.fullmatch(r"\d", v):
        return None
    v = money(v) if is_money(v, label) else v
    return f"{v} %" if re.fullmatch(r"\d+\.\d+", v) and 0 < float(v) < 100 else v


def in_money_row(v: str, label: str) -> str:
    """A value in a row whose label has a part of ROW_PARTS: there plain, grouped and negative numbers are money too."""
    low = label.lower()
    has = lambda parts: any(p in low for p in parts)
    if not v or not has(ROW_PARTS):
        return v
    v = money(v) if is_money(v, label) else v
    plain = re.fullmatch(r"\d+", v) and int(v) >= 10 and has(PLAIN_PARTS)
    grouped = re.fullmatch(r"\d{1,3}(?:,\d{3})+", v) and has(GROUPED_PARTS)
    return f"$ {v}" if plain or grouped else money(v) if v[0] == "(" else v


def has_dates(line: str) -> bool:
    """Whole words of dates, and no numbers but years and days."""
    words = re.search(rf"(?i)\b(?:{'|'.join(DATE_WORDS)})\b", line)
    return bool(words) and not re.search(r"\d", re.sub(rf"\b{_YEARS}\b|\b(?:{'|'.join(DATE_WORDS[3:])})\s+\d{{1,2}}\b", "", line.lower()))


def is_header(line: str, below: str) -> bool:
    """Before a separator, or with whole words of dates or a year by itself in two cells, and without other numbers."""
    return is_separator(below) or has_dates(line)


def fix_header(line: str) -> str:
    """Cells stay in their columns; two years in one cell become two columns, repeated cells go, and years after `Months Ended` get a line break."""
    text = line.strip()
    cells = [c.strip() for c in text.removeprefix("|").removesuffix("|").split("|")]
    if text.startswith("||"):
        cells = ["", *(c for c in cells if c)]
    out: list[str] = []
    for c in cells:
        two = re.fullmatch(rf"(.*?)({_YEARS})\s+({_YEARS})", c)
        for x in (f"{two[1]}{two[2]}", f"{two[1]}{two[3]}") if two else (c,):
            x = re.sub(rf"(Months Ended.*?)\s*({_YEARS})$", r"\1 <br/>\2", x)
            if not x or x not in out:
                out.append(x)
    return "| " + " | ".join(out) + " |"


def fix_row(line: str) -> str:
    """Label and values; a row without a label is an empty line; a label alone is a section and gets bold once."""
    cells = cells_of(line)
    if not cells or not re.search(r"[^\W\d_]", cells[0]):
        return ""
    label = cells[0]
    if is_section(label, cells[1:]):
        return f"| {label if label.startswith('**') else f'**{label}**'} |"
    values = [c for cell in cells[1:] for v in split_numbers(cell) if (c := clean_value(v, label)) is not None]
    values = [in_money_row(v, label) for v in join_decimals(values)][:WIDTH]
    return "| " + " | ".join([label, *values, *[""] * (WIDTH - len(values))]) + " |"


def remembered(f: Callable[[str], object]) -> Callable[[str], object]:
    """f, whose results for lines that are not too long a Python worker remembers: heads, separators and many rows come again."""
    known = lru_cache(REMEMBERED)(f)
    return lambda line: known(line) if len(line) <= LONGEST else f(line)


_separator, _dates, _header, _row = map(remembered, (is_separator, has_dates, fix_header, fix_row))


def fix_text(text: str | None) -> str | None:
    """Each line by its kind: a head stands before a separator or has words of dates; separators get the head's columns."""
    if text is None or len(text) < SHORT or "|" not in text:
        return text
    lines, out, columns = text.split("\n"), [], WIDTH + 1
    for i, line in enumerate(lines):
        if "|" not in line:
            out.append(line)
        elif _separator(line):
            out.append("|" + "---|" * columns)
        elif (i + 1 < len(lines) and "|" in lines[i + 1] and _separator(lines[i + 1])) or _dates(line):
            out.append(_header(line))
            columns = out[-1].count("|") - 1
        else:
            out.append(_row(line))
    return "\n".join(out)


def fix_tables():
    @F.pandas_udf("string")
    def fix(texts: pd.Series) -> pd.Series:
        return texts.map(fix_text)

    return fix


def split_values():
    @F.pandas_udf("array<string>")
    def split(cells: pd.Series) -> pd.Series:
        return cells.map(lambda c: split_numbers(c or ""))

    return split


def parse_all(files: DataFrame, parse: Callable[[str, bytes], tuple[str, str]]) -> DataFrame:
    """(path, text, markdown, success, error) of files(path, content) by a parser; a file it fails on keeps its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            rows = []
            for path, content in zip(piece.column(0).to_pylist(), piece.column(1), strict=True):
                try:
                    rows.append((path, *parse(path, bytes(content.as_py())), True, None))
                except Exception as e:  # any fault of a parser is that file's own
                    rows.append((path, "", f"Error: {e}", False, str(e)))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.string()] * 3, pa.bool_(), pa.string()), strict=True)], ["path", "text", "markdown", "success", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, text string, markdown string, success boolean, error string")
