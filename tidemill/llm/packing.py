"""Best-fit packing of token sequences, planned over a histogram of lengths.

Documents are cut into pieces of at most `capacity` tokens. Only the counts of pieces by length reach
the driver, `capacity` numbers at most. Best-fit decreasing runs over these counts: bins with the same
free room are kept as ranges, so placing a million pieces of one length is one step. The plan is a
list of segments (length, ranks, bins, offset); each piece gets its rank within its length without
any global sort, and the segment that holds the rank gives its sequence and offset.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import cut, only, release, remember, short_batches, tasks

MEMO = 300_000


#: A word's ASCII signs at its end are a piece of their own for the tokenizer; an apostrophe may not be.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters-only words that are encoded as one text.
TOGETHER = 512


class WordTokenizer:
    """Ids of whole texts as the library gives them.

    With a tokenizer that lower-cases, drops white space and marks the end of each piece, words are encoded once and remembered
    as bytes; words of letters alone, which are one piece each, go through it many in one text. Any other tokenizer gets each text whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        # texts with the string of a special token, which the library takes for that token, go through it whole
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])]
        first = ((made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_words = steps == ["NFC", "Replace", "Lowercase"] and (first.get("type"), first.get("behavior"), first.get("invert")) == ("Split", "Removed", True) and made["model"].get("end_of_word_suffix") == "</w>"
        vocabulary = self.own.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _each(self, words: list[str]) -> None:
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            self.memo.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(part, self.own.encode_batch_fast(part, add_special_tokens=False), strict=True))

    def _together(self, words: list[str]) -> None:
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        for group, e in zip(groups, self.own.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(group):  # some letter became several pieces
                self._each(group)
                continue
            data, at = ids.tobytes(), 0
            for w, stop in zip(group, (stops * 4).tolist(), strict=True):
                self.memo[w] = data[at:stop]
                at = stop

    def learn(self, new: set[str]) -> None:
        letters, other, joined = set(), set(), []
        for w in new:
            stem = w.rstrip(SIGNS)
            if not (stem.isalpha() and stem.lower().isalpha()):
                other.add(w)
            elif stem == w:
                letters.add(w)
            else:
                signs = w[len(stem) :]
                joined.append((w, stem, signs))
                if stem not in self.memo:
                    letters.add(stem)
                if signs not in self.memo:
                    other.add(signs)
        self._each(list(other))
        self._together(list(letters))
        for w, stem, signs in joined:
            self.memo[w] = self.memo[stem] + self.memo[signs]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library gives them without special tokens added. Nothing joins across a space or a
        line end, so the text is cut there."""
        whole = [not self.by_words or any(t in x for t in self.special) for x in texts]
        words = [[] if w else x.replace("\n", " ").split(" ") for x, w in zip(texts, whole, strict=True)]
        found = set().union(*words)
        if len(self.memo) > MEMO:  # what is still in use comes back from the older half
            self.older, self.memo = self.memo, {}
        new = found.difference(self.memo)
        known = [w for w in new if w in self.older]
        self.memo.update(zip(known, map(self.older.__getitem__, known), strict=True))
        self.learn(new.difference(known))
        by_word = [np.frombuffer(b"".join(map(self.memo.__getitem__, ws)), "<u4") for ws in words]
        return [np.array(self.own.encode(x, add_special_tokens=False).ids, "<u4") if w else ids for x, w, ids in zip(texts, whole, by_word, strict=True)]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


remember("packing", word_tokenizer.cache_clear)


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every whole text with end_id after it; null counts as empty, so it is one token.

    Ids are those of tokenizers.Tokenizer.encode(text, add_special_tokens=False): the string of a special token in a text is that token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("packing")
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                # about a million characters at a time
                keys, texts, size = [], [], 0
                while at < batch.num_rows and size < 1_000_000:
                    keys.append(batch.column(0)[at].as_py())
                    texts.append(batch.column(1)[at].as_py() or "")
                    size += len(texts[-1]) + 1
                    at += 1
                rows = []
                for key, ids in zip(keys, word_tokenizer(tokenizer_path).encode(texts), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    rows += [(key, k, s, len(p := ids[s : s + capacity]), zlib.crc32(p.tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
                types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], [id_col, "piece", "start", "length", "ids_crc32"])

        release()

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, first rank, ranks, first bin, pieces a bin, offset) by best-fit decreasing.

    Piece of rank r in a segment: bin = first bin + (r - first rank) // pieces a bin, offset + length x
    ((r - first rank) mod pieces a bin). A piece goes where the least room is left over; a bin that takes
    one takes as many of the length as fit, since it is then the tightest.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> ranges (first bin, bins)
    bins = 0

    def put(free: int, first: int, n: int) -> None:
        if n and free:
            room.setdefault(free, []).append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for free in range(length, capacity):
            while left and room.get(free):
                first, n = room[free].pop()
                each = free // length
                full = min(n, left // each)
                if full:
                    out.append((length, rank, full * each, first, each, capacity - free))
                    put(free - each * length, first, full)
                    rank, left = rank + full * each, left - full * each
                rest = left if full < n and left < each else 0
                if rest:
                    out.append((length, rank, rest, first + full, each, capacity - free))
                    put(free - rest * length, first + full, 1)
                    rank, left = rank + rest, 0
                put(free, first + full + bool(rest), n - full - bool(rest))
            if not left:
                break
        if left:
            each = capacity // length
            out.append((length, rank, left, bins, each, 0))
            put(capacity - each * length, bins, left // each)
            if left % each:
                put(capacity - left % each * length, bins + left // each, 1)
            bins += -(-left // each)
    return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): every piece's place; offsets are gapless from 0.

    Null and empty texts are one piece of end_id alone. Repeated rows are packed each, also those without an id. Very
    long texts are cut into many pieces. Further columns, whatever their names, do not matter. The empty table gives no rows.
    """
    spark = docs.sparkSession
    docs, id_name, id_col = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), id_col, "_id"
    text_col = "_text"
    salts = tasks(spark)
    found = pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col).withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    with short_batches(spark):
        made = cut(found, "pieces")
    # a length that a third of all pieces share is ranked in as many parts as there are salts, rows that repeat one id too
    sums = cut(made.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    segments = spark.createDataFrame(plan(counts, capacity), "_length long, _rank long, _n long, _bin long, _each long, _offset long")
    own = Window.partitionBy("length", "_salt").orderBy(id_col, "piece")
    ranked = made.withColumn("_own", F.row_number().over(own)).join(starts, ["length", "_salt"]).withColumn("_at", F.col("_before") + F.col("_own") - 1)
    # the plan has a few segments for each length, so its size is bounded by the capacity
    placed = ranked.join(F.broadcast(segments), (F.col("length") == F.col("_length")) & (F.col("_at") >= F.col("_rank")) & (F.col("_at") < F.col("_rank") + F.col("_n")))
    step = F.col("_at") - F.col("_rank")
    return placed.select(
        F.col(id_col).alias(id_name), "piece", "start", "length", "ids_crc32",
        (F.col("_bin") + F.floor(step / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + F.pmod(step, F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )
