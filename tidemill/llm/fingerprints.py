"""Document fingerprints from content-defined chunks.

A gear hash over the UTF-8 bytes marks chunk ends: at each byte it depends on the 32 bytes before it
alone, so an edit moves no boundary further off. Chunking is normalised: below the wanted size a
stricter mask applies, above it a looser one, so sizes stay close together. The fingerprint is the
set of chunk digests with their lengths; the likeness of A to B is the containment of A in B, the
bytes of A's chunks that B has as well over all bytes of A's chunks.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import numbered, tasks, whole_numbers

#: Bytes: no chunk but the last is shorter than SMALLEST or longer than LARGEST; most are near USUAL.
SMALLEST, USUAL, LARGEST = 16, 64, 512
STRICT, LOOSE = np.uint32(0xFF << 24), np.uint32(0x0F << 28)  # 8 and 4 of the high bits
GEAR = np.array([xxhash.xxh32_intdigest(bytes([i]), seed=7) for i in range(256)], dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at every byte: the sum over the last 32 bytes of GEAR[byte] << distance, by doubling."""
    h = GEAR[data]
    for w in (1, 2, 4, 8, 16):
        nxt = h.copy()
        nxt[w:] += h[:-w] << np.uint32(w)
        h = nxt
    return h


def chunks(data: bytes) -> list[tuple[int, int]]:
    """(start, end) of each chunk; none for no bytes."""
    n = len(data)
    if n <= SMALLEST:
        return [(0, n)] if n else []
    h = gear(np.frombuffer(data, dtype=np.uint8))
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = loose[(h[loose] & STRICT) == 0].tolist()
    loose = loose.tolist()
    out, at = [], 0
    while n - at > SMALLEST:
        i = bisect_left(strict, at + SMALLEST - 1)
        if i < len(strict) and strict[i] < at + USUAL:
            end = strict[i] + 1
        else:
            i = bisect_left(loose, at + USUAL - 1)
            end = loose[i] + 1 if i < len(loose) else n
        end = min(end, at + LARGEST, n)
        out.append((at, end))
        at = end
    if at < n:
        out.append((at, n))
    return out


def fingerprint(text: str) -> dict[int, int]:
    """Chunk digest -> chunk length."""
    data = text.encode()
    return {xxhash.xxh3_64_intdigest(data[a:b]): b - a for a, b in chunks(data)}


def show(f: dict[int, int]) -> str:
    """digest:length in hexadecimal, by digest. The string of no chunks is empty."""
    return ",".join(f"{d:016x}:{f[d]:x}" for d in sorted(f))


def read(s: str) -> dict[int, int]:
    return {int(d, 16): int(n, 16) for d, n in (x.split(":") for x in s.split(","))} if s else {}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Of a in b. Of no chunks: 1 in no chunks, else 0."""
    total = sum(a.values())
    if not total:
        return 0.0 if b else 1.0
    return sum(n for d, n in a.items() if d in b) / total


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, fingerprint) of every whole text; null counts as empty. One row per input row, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([show(fingerprint(t)) for t in texts], pa.string())], [id_col, "n_chars", "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_chars long, fingerprint string")


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_run, _ahead, _id, _hash, _text): the documents cut into runs of ascending ids, one after another; ids are whole numbers.

    Cuts are quantiles of the ids, about four runs a task. A run of one id alone that is longer than others (nulls are
    such a run) is cut again, by hashes of texts. The first document of each run appears in the run before it once
    more, with _ahead set (the first run comes after the last), so each run has all that its documents' successors
    need, and only run numbers, ids and hashes of their first rows ever reach the driver. Texts move once.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text"))
    wanted = 4 * tasks(spark)
    cuts = base.where("_id is not null").select(F.col("_id").cast("double").alias("_x")).approxQuantile("_x", [k / wanted for k in range(1, wanted)], 1 / (8 * wanted)) if wanted > 1 else []
    # an id at which several cuts fall is a run by itself
    cuts = sorted({*cuts, *(float(np.nextafter(a, np.inf)) for a, b in pairwise(sorted(cuts)) if a == b)})
    at = Bucketizer(splits=[float("-inf"), *(cuts or [0.0]), float("inf")], inputCol="_x", outputCol="_run", handleInvalid="keep")
    # nulls come first, before the smallest id, in a run of their own
    runs = at.transform(base.withColumn("_x", F.col("_id").cast("double"))).withColumn("_run", F.when(F.col("_id").isNull(), F.lit(-1)).otherwise(F.col("_run").cast("long"))).drop("_x")
    sizes = runs.groupBy("_run").agg(F.count(F.lit(1)).alias("n"), F.min("_id").eqNullSafe(F.max("_id")).alias("one")).collect()  # twice wanted at most
    most = max(1, sum(r["n"] for r in sizes) // wanted)
    parts = F.lit(1)
    for r in sizes:
        if r["one"] and r["n"] > 2 * most:
            parts = F.when(F.col("_run") == r["_run"], -(-r["n"] // most)).otherwise(parts)
    part = F.floor((F.call_function("shiftright", F.col("_hash"), F.lit(32)) + (1 << 31)) * parts / float(1 << 32))
    runs = runs.withColumn("_hash", F.xxhash64("_text")).withColumn("_run", F.col("_run") * (1 << 20) + part.cast("long"))
    heads = sorted(runs.groupBy("_run").agg(F.min(F.struct("_id", "_hash")).alias("h")).select("_run", "h.*").collect(), key=lambda r: r["_run"])
    # the head of each run also goes to the run before; one row a run, so the table that is sent out is bounded by wanted
    before = spark.createDataFrame([(r["_id"], r["_hash"], heads[i - 1]["_run"]) for i, r in enumerate(heads)], "_head long, _head_hash long, _before long")
    both = runs.join(F.broadcast(before), F.col("_id").eqNullSafe(F.col("_head")) & (F.col("_hash") == F.col("_head_hash")), "left")
    here, there = F.struct("_run", F.lit(False).alias("_ahead")), F.struct(F.col("_before").alias("_run"), F.lit(True).alias("_ahead"))
    out = both.select(F.explode(F.when(F.col("_before").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("_at"), "_id", "_hash", "_text")
    return out.select("_at.*", "_id", "_hash", "_text")


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    Next: by ascending id (nulls first), after the last the first; rows with one id follow each other by a hash of
    the text, then the text. A single row is its own next. Edited: the last half (rounded down) of the code points
    replaced by as many of the next document's first ones, or by all if it has fewer. Null texts are empty. Ids
    may be of any type that can be sorted; further columns do not matter. The empty table gives no rows.
    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    if not whole_numbers(docs, id_col):
        inner, ids = numbered(docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text")), "_key")
        got = against_next(inner, "_key", "_text").join(ids, F.col("_key") == F.col("_n"), "left")
        return got.select(F.col("_id").alias(id_col), *got.columns[1:7])
    runs = in_order(docs, id_col, text_col).repartition(tasks(docs.sparkSession), "_run").sortWithinPartitions("_run", "_ahead", "_id", "_hash", "_text")
    names = ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = None  # the row that waits for its next one: run, id, text, fingerprint
        size = 0

        def pair(one: tuple, text: str, f: dict[int, int]) -> None:
            _, key, mine, own = one
            half = len(mine) // 2
            edited = mine[: len(mine) - half] + text[:half]
            e = fingerprint(edited)
            rows.append((key, len(mine), hashlib.sha256(edited.encode()).hexdigest(), show(own), show(e), containment(own, e), containment(own, f)))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        done = None  # the run whose end has been reached
        for batch in batches:
            for k, ahead, key, _, text in zip(*(batch.column(i) for i in range(5)), strict=True):
                k, ahead, text = k.as_py(), ahead.as_py(), text.as_py()
                if ahead and k == done:
                    continue
                f = fingerprint(text)
                if held is not None and held[0] == k:
                    pair(held, text, f)
                    size += len(text)
                held, done = (None, k) if ahead else ((k, key.as_py(), text, f), done)
                if size > 4_000_000 or len(rows) > 2000:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)

    made = runs.mapInArrow(run, "_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return made.select(F.col("_id").cast(docs.schema[id_col].dataType).alias(id_col), *names[1:])
