"""License scans: stretches of normalised text against licence templates by Dice coefficient over word bigrams.

A text is one sequence of words, whatever its lines. Templates are short notices and whole licences."""

from __future__ import annotations

import math
import re
from bisect import bisect, bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from importlib import resources
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Notices that texts carry, by SPDX-like name. Extend or replace by the parameter.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "All-Rights-Reserved": "All rights reserved.",
}
#: Templates of so many bigrams or more are searched from each end in turn, shorter ones by all stretches.
LONG = 100
WORD = re.compile(r"[^\W_]+")


@cache
def full_texts() -> dict[str, str]:
    """Whole licences, by the same names, without their copyright lines where those differ."""
    return {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in resources.files("tidemill.llm").joinpath("licence_texts").iterdir() if f.name.endswith(".txt")}


def normal(text: str) -> list[str]:
    """Lower-case words of letters and digits."""
    return WORD.findall(text.lower())


def bigrams(words: list[str]) -> Counter:
    """Word pairs with their counts; a single word counts as a pair with nothing."""
    return Counter(zip(words, words[1:], strict=False)) if len(words) > 1 else Counter({(w, ""): 1 for w in words})


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Scanner:
    def __init__(self, templates: dict[str, str] | Iterable[tuple[str, str]], least: float):
        self.least = least
        pairs = templates.items() if isinstance(templates, dict) else templates
        self.templates = sorted(((n, len(w), bigrams(w)) for n, t in pairs if (w := normal(t))), key=lambda t: t[:2])
        self.holders: dict[tuple[str, str], list[int]] = {}
        for i, (_, _, b) in enumerate(self.templates):
            for pair in b:
                self.holders.setdefault(pair, []).append(i)
        # Dice is at most 2 min(a, b) / (a + b), so a stretch has from r b to b / r bigrams, and shares r b at least
        self.ratio = least / (2 - least)

    def starts(self, at: list[int], pairs: list[tuple[str, str]], own: Counter) -> list[int]:
        """The places in at from which some stretch may share enough: repeats count as often as the template has them."""
        size = own.total()
        need, most = math.ceil(size * self.ratio - 1e-9), math.floor(size / self.ratio + 1e-9)
        if len(at) < need or not any(b - a < most for a, b in zip(at, islice(at, max(need - 1, 0), None), strict=False)):
            return []
        found, seen, shared, end = [], Counter(), 0, 0
        for k, a in enumerate(at):
            while end < len(at) and at[end] - a < most:
                p = pairs[at[end]]
                seen[p] += 1
                shared += seen[p] <= own[p]
                end += 1
            if shared >= need:
                found.append(k)
            shared -= seen[pairs[a]] <= own[pairs[a]]
            seen[pairs[a]] -= 1
        return found

    def best(self, at: list[int], pairs: list[tuple[str, str]], own: Counter, k: int, step: int) -> tuple[float, int, int]:
        """(Dice, shared, other end): the best stretch from place k onwards (step 1) or backwards (-1); of equal ones the shortest."""
        size, seen, shared, top = own.total(), Counter(), 0, (0.0, 0, k)
        most = math.floor(size / self.ratio + 1e-9)
        j = k
        while 0 <= j < len(at) and abs(at[j] - at[k]) < most:
            p = pairs[at[j]]
            seen[p] += 1
            shared += seen[p] <= own[p]
            score = 2 * shared / (abs(at[j] - at[k]) + 1 + size)
            if score > top[0]:
                top = score, shared, j
            j += step
        return top

    def found(self, i: int, at: list[int], pairs: list[tuple[str, str]]) -> Iterator[tuple[float, float, str, int, int]]:
        """(shared times Dice, Dice, licence, first word, last word) of stretches like template i."""
        name, _, own = self.templates[i]
        starts = self.starts(at, pairs, own)
        if own.total() >= LONG:
            for score, shared, k, j in self.long(at, pairs, own, starts) if starts else ():
                yield shared * score, score, name, at[k], at[j] + 1
            return
        for k in starts:
            score, shared, j = self.best(at, pairs, own, k, 1)
            if score >= self.least:
                yield shared * score, score, name, at[k], at[j] + 1

    def long(self, at: list[int], pairs: list[tuple[str, str]], own: Counter, starts: list[int]) -> Iterator[tuple[float, int, int, int]]:
        """(Dice, shared, start, end) of stretches that do not begin within one another: each start's best end, and that end's best start.

        All ends of a start are tried at once. A later start shares no more with any end than this one does, and its stretch is shorter by as
        much as it is later: where nothing here is enough, this tells how much later a start must be, and those before it are not tried.
        """
        size = own.total()
        most = math.floor(size / self.ratio + 1e-9)
        place = {p: n for n, p in enumerate(own)}
        which, where = np.array([place[pairs[x]] for x in at]), np.array(at)
        most_of = np.array(list(own.values()))
        # how often each pair has stood before each place
        order = np.argsort(which, kind="stable")
        runs = np.flatnonzero(np.r_[True, np.diff(which[order]) > 0])
        nth = np.empty(len(at), np.int64)
        nth[order] = np.arange(len(at)) - np.repeat(runs, np.diff(np.r_[runs, len(at)]))
        before, done, after, least_at = np.zeros(len(own), np.int64), 0, -1, -1
        for k in starts:
            if k <= after or at[k] < least_at:
                continue
            before += np.bincount(which[done:k], minlength=len(own))
            done = k
            here = which[k : np.searchsorted(where, at[k] + most)]
            shared = np.cumsum(nth[k : k + len(here)] - before[here] < most_of[here])
            total = where[k : k + len(here)] - at[k] + 1 + size
            score = 2 * shared / total
            b = int(score.argmax())
            if score[b] < self.least:
                later = min(float((total - 2 * shared / self.least).min()), self.least * (most + size) / 2 - float(shared[-1]))
                least_at = at[k] + max(1, math.ceil(later - 1e-6))
                continue
            after = k + b
            yield (*(x := self.best(at, pairs, own, after, -1))[:2], x[2], after)

    def scan(self, text: str) -> list[tuple[int, str, float]]:
        """(line, licence, score): the stretches of the text, across lines, that are like a template, and the lines that
        they begin in. Of stretches that overlap the one that shares most, times its score, counts."""
        words = WORD.findall(text.lower())
        pairs = list(zip(words, islice(words, 1, None), strict=False))
        places: dict[int, list[int]] = {}
        for at, held in enumerate(map(self.holders.get, pairs)):
            if held:
                for i in held:
                    places.setdefault(i, []).append(at)
        every = [x for i, at in places.items() for x in self.found(i, at, pairs)]
        alone = [(self.templates[i][0], w) for i, t in enumerate(self.templates) if t[1] == 1 for w, _ in t[2]]
        if not every and not alone:
            return []
        before = [0, *accumulate(len(normal(line)) for line in text.split("\n"))]  # words before each line
        every += [(1.0, 1.0, n, a, a) for n, w in alone for a, b in zip(before, before[1:], strict=False) if b - a == 1 and words[a] == w]
        spans, out = [], []  # spans: of words, in order, without overlap
        while every:
            left = []
            for _, score, name, a, b in sorted(every, key=lambda x: (-x[0], -x[1], x[2], x[3])):
                k = bisect_left(spans, (a, a))
                if (k == len(spans) or spans[k][0] > b) and (k == 0 or spans[k - 1][1] < a):
                    spans.insert(k, (a, b))
                    out.append((a, bisect(before, a) - 1, name, score))
                else:
                    left.append((a, b))
            # a stretch that reached into another: what is free of it may still be like a template
            edges = [(-1, -1), *spans, (len(words), len(words))]
            free = {(edges[k][1] + 1, edges[k + 1][0]) for a, b in left for k in range(max(bisect(edges, (a, -1)) - 1, 0), bisect(edges, (b, len(words))))}
            every = [x for lo, hi in free if hi - lo > 1 for i, at in places.items() for x in self.found(i, at[bisect_left(at, lo) : bisect_left(at, hi - 1)], pairs)]
        return [x[1:] for x in sorted(out)]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, licence, score) for every stretch of every whole text that is like a template, score >= least.

    Stretches go across lines and do not overlap; line is where they begin, from 0. Without templates of
    one's own both the short notices and the whole licences count. Null and empty texts have none. Repeated
    rows give their matches each. A template of one word is only met by a line of that word. No shuffle;
    the templates go out with the task.
    """
    pairs = [*TEMPLATES.items(), *full_texts().items()] if templates is None else [*templates.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scanner(pairs, least)
        for batch in batches:
            rows = [(key.as_py(), *m) for key, t in zip(batch.column(0), batch.column(1), strict=True) if (x := t.as_py()) for m in s.scan(x)]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, [batch.schema.field(0).type, pa.int64(), pa.string(), pa.float64()], strict=True)], [id_col, "line", "licence", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, line long, licence string, score double")
