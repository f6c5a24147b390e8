"""Language identification by the nearest of several centroids per language.

A text becomes hashed byte trigrams of its lower-cased letters, weighted by 1 + log(count) and
inverse document frequency and scaled to length 1. Each language has a few centroids, found by
spherical k-means over a bounded sample of its labelled texts. A text belongs to the language of the
centroid with the largest cosine; it is rejected where its distance is far beyond what labelled texts of
that language and of about its length have, which were held out of the clustering.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.llm.common import Scratch, only

DIMS = 4096
#: Labelled rows of one language that the fit uses at most, taken at random.
SAMPLE = 1000
#: Rows that the fit uses in all, about, however many languages there are.
SAMPLE_ALL = 16_000
#: One in so many sampled rows is held out of the clustering and gives the limits of rejection.
HELD = 4
#: A text is rejected where its distance is further beyond this quantile of the held-out distances than that is beyond their median,
#: or nearer to 1, nothing in common, than to it.
QUANTILE = 0.99
#: Held-out rows that a limit needs at least.
ENOUGH = 50
#: A centroid of fewer than this share of a language's rows is one of strays and goes, if it is not the only one.
STRAYS = 0.03
CENTROIDS = 4
ROUNDS = 12
#: Lengths are told apart in powers of two of the number of trigrams, up to this many classes.
CLASSES = 16

# bytes that are no letters of any script become one space
_LETTERS = bytes(b if chr(b).isalpha() and b < 128 or b >= 128 else 32 for b in range(256))


def counts(text: str) -> np.ndarray | None:
    """Hashed trigram counts; None for a text without letters."""
    if not any(c.isalpha() for c in text):
        return None
    words = text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()
    b = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        b = np.array([32, 32, 32], dtype=np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    code = (code * np.uint32(2654435761)) >> np.uint32(20)  # the 12 high bits
    return np.bincount(code, minlength=DIMS).astype(np.float32)


def length_class(c: np.ndarray) -> int:
    return min(CLASSES - 1, int(np.log2(c.sum() + 1)))


def vector(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.zeros(DIMS, np.float32)
    on = c > 0
    v[on] = (1 + np.log(c[on])) * idf[on]
    norm = np.linalg.norm(v)
    return v / norm if norm else v


def k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts from rows that are far from each other, the first row first."""
    picked = [0]
    near = x @ x[0]
    while len(picked) < min(k, len(x)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picked[-1]])
    c = x[picked].copy()
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].mean(0)
                n = np.linalg.norm(m)
                c[j] = m / n if n else c[j]
    return c


def without_strays(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The centroids without those that few rows are nearest to."""
    n = np.bincount((x @ c.T).argmax(1), minlength=len(c))
    keep = n >= max(2, STRAYS * len(x))
    return c[keep] if keep.any() else c


def limits(distances: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The distance of each length class beyond which a text is rejected; nan where too few rows tell.

    A class is pooled with its neighbours, and with shorter ones, whose texts lie farther off, until there are ENOUGH held-out rows.
    """
    out = np.full(CLASSES, np.nan)
    for c in range(CLASSES):
        low = c - 1
        while low > 0 and ((kinds >= low) & (kinds <= c + 1)).sum() < ENOUGH:
            low -= 1
        d = distances[(kinds >= low) & (kinds <= c + 1)]
        if len(d) >= ENOUGH:
            middle, high = np.quantile(d, (0.5, QUANTILE))
            out[c] = high + min(high - middle, (1 - high) / 2)
    return out


@dataclass
class Model:
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    farthest: dict[str, np.ndarray]  # of each language: cosine distance beyond which a text of a length class is rejected

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected). No letter: und, 0, rejected; no model: und too."""
        c = counts(text) if text else None
        if c is None or not self.langs:
            return "und", 0.0, True
        s = self.centroids @ vector(c, self.idf)
        j = int(s.argmax())  # of equal ones the first, centroids being in order of language
        score = float(min(1.0, max(0.0, s[j])))
        return self.langs[j], score, bool(1 - score > self.farthest[self.langs[j]][length_class(c)])


def fit(docs: DataFrame, where: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the rows with a language and a letter (and where, if given).

    Rows are taken at random, each by itself, so equal or null ids and repeated rows neither lose a language nor make its
    sample longer than it may be. Every language with such a row is learned. Without labelled rows the model knows none.
    """
    spark = docs.sparkSession
    labelled = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), (F.lit(True) if where is None else where).alias("_use")).where("_use and _lang is not null").where(F.col("_text").rlike(r"\p{L}"))
    sizes = {r["_lang"]: r["count"] for r in labelled.groupBy("_lang").count().collect()}  # one row a language
    if not sizes:
        return Model([], np.zeros((0, DIMS), np.float32), np.ones(DIMS, np.float32), {})
    each = max(8, min(sample, SAMPLE_ALL // len(sizes)))
    # four times as many places as are wanted are looked at, so that ranking those of a language is bounded and never short;
    # only places move for it, not texts
    place = F.pmod(F.xxhash64(F.col("_id"), F.col("_text"), F.monotonically_increasing_id()), F.lit(1 << 50)) / float(1 << 50)
    up_to = lambda ends: F.broadcast(spark.createDataFrame(ends, "_lang string, _end double"))
    placed = labelled.withColumn("_place", place)
    places = placed.join(up_to([(k, min(1.0, 4 * each / n)) for k, n in sizes.items()]), "_lang").where("_place <= _end").select("_lang", "_place")
    ranked = places.withColumn("_row", F.row_number().over(Window.partitionBy("_lang").orderBy("_place"))).where(F.col("_row") <= each)
    ends = [tuple(r) for r in ranked.groupBy("_lang").agg(F.max("_place")).collect()]  # one row a language
    taken = placed.join(up_to(ends), "_lang").where("_place <= _end")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("langid")
        for batch in batches:
            rows = [(k.as_py(), p.as_py(), c.tobytes()) for k, p, t in zip(*(batch.column(i) for i in range(3)), strict=True) if (c := counts(t.as_py())) is not None]
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.binary()), strict=True)], ["_lang", "_place", "_counts"])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(DIMS, np.int64)
        for batch in batches:
            for c in batch.column(0):
                n, df = n + 1, df + (np.frombuffer(c.as_py(), np.float32) > 0)
        yield pa.record_batch([pa.array([n], pa.int64()), pa.array([df.tolist()], pa.list_(pa.int64()))], ["n", "df"])

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_place", kind="stable")
        c = np.stack([np.frombuffer(b, np.float32) for b in group["_counts"]])
        x = np.stack([vector(row, idf) for row in c])
        held = np.arange(len(x)) % HELD == HELD - 1 if len(x) >= 2 * HELD else np.ones(len(x), bool)
        own = x[~held] if not held.all() else x
        centres = without_strays(own, k_means(own, CENTROIDS))
        far = 1 - (x[held] @ centres.T).max(1)
        return pd.DataFrame({"_lang": group["_lang"].iloc[:1], "_centres": [centres.astype(np.float32).tobytes()], "_far": [far.tolist()], "_kinds": [[length_class(row) for row in c[held]]]})

    with Scratch(spark) as s:
        # a few thousand rows of fixed size
        made = s.cut(taken.select("_lang", "_place", "_text").mapInArrow(vectors, "_lang string, _place double, _counts binary"), "sample")
        parts = made.select("_counts").mapInArrow(frequencies, "n long, df array<long>").select("n", F.posexplode("df").alias("i", "df")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).collect()
        df = np.zeros(DIMS)
        for r in parts:
            df[r["i"]] = r["df"]
        total = parts[0]["n"] if parts else 0
        idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
        fitted = sorted(made.groupBy("_lang").applyInPandas(cluster, "_lang string, _centres binary, _far array<double>, _kinds array<int>").collect(), key=lambda r: r["_lang"])
    centres = [np.frombuffer(r["_centres"], np.float32).reshape(-1, DIMS) for r in fitted]
    langs = [r["_lang"] for r, c in zip(fitted, centres, strict=True) for _ in c]
    # where a language has too few held-out rows of a length those of all languages count, and without these nothing is rejected
    of = {r["_lang"]: limits(np.array(r["_far"]), np.array(r["_kinds"])) for r in fitted}
    every = limits(np.concatenate([[], *(r["_far"] for r in fitted)]), np.concatenate([[], *(r["_kinds"] for r in fitted)]))
    farthest = {k: np.where(np.isnan(v), np.where(np.isnan(every), 1.0, every), v) for k, v in of.items()}
    return Model(langs, np.concatenate(centres) if centres else np.zeros((0, DIMS), np.float32), idf, farthest)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for every whole text, repeated rows each; text is the only input of a prediction.

    Null and empty texts and those without a letter are und, with score 0, and rejected. Very long texts are counted whole. Of
    languages that are equally near the first by name counts. Further columns do not matter. The empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x CENTROIDS x DIMS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("langid")
        m = sent.value
        for batch in batches:
            got = [m.predict(t.as_py()) for t in batch.column(1)]
            lang, score, out = zip(*got, strict=True) if got else ([], [], [])
            yield pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], [id_col, "lang_pred", "score", "rejected"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns (whatever their names), whose text the model does not reject.

    Texts that are null, empty or without a letter go. Rows that repeat are judged each. The empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("langid")
        m = sent.value
        for batch in batches:
            yield batch.filter(pa.array([not m.predict(t.as_py())[2] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
