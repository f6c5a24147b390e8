"""Phrase collocations by prefix-free parsing.

A text is a sequence of words and breaks. Wherever the hash of a window of words says so, one chunk ends and the next begins, and
both have the window, so what a chunk is depends on its own words alone: copies and passages that documents share give the same
chunks wherever they stand. The distinct chunks with their frequencies are the dictionary, and phrases are counted in it, each
chunk once with its frequency as the weight. A phrase belongs to the chunk that it begins in, before the window it shares with the
next, so none counts twice.

Only phrases whose every pair of neighbouring words is frequent can be frequent. So pairs are counted as 64-bit hashes first; a bit
map of fixed size says which of these may be frequent, and phrases are then counted as words only where the map has all their
pairs. The map can be too full to help, but never leaves out a frequent phrase.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import Scratch, cut, only, remember, short_batches

#: One window in so many ends a chunk.
EVERY = 16
#: Bits of the map, a power of two: 8 MiB.
MAP_BITS = 1 << 26
#: Phrases, and pairs of words, that a counting task gathers from batches before it gives their sums on.
HELD = 1_000_000
#: Words whose hashes a Python worker remembers.
REMEMBERED = 200_000
#: Parts that a language's candidates are ranked in first.
RANKED_IN = 32
#: A-Z in lower case; what ends a piece becomes a full stop; a tab separates words like a blank.
BREAKS = b".,;:!?\n\x0b\x0c\r"
BREAK = b"."
_TABLE = bytes.maketrans(bytes(range(65, 91)) + BREAKS + b"\t", bytes(range(97, 123)) + BREAK * len(BREAKS) + b" ")


def parts(text: str) -> list[bytes]:
    """The words of a text, with a full stop for every break."""
    return text.encode().translate(_TABLE).replace(BREAK, b" . ").split()


class Hashes(dict):
    """Hash of each word, never 0; that of a break is 0."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = 0 if word == BREAK else xxhash.xxh3_64_intdigest(word) | 1
        return h


_hashes = Hashes()
remember("collocations", _hashes.clear)


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the window that begins at each word, whether it has no break), for all places where one fits."""
    n = max(len(h) - size + 1, 0)
    mixed, whole = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(size):
        own = h[k : k + n]
        mixed = (mixed ^ own) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        whole &= own != 0
    return mixed, whole


def chunks(words: list[bytes], overlap: int) -> Iterator[tuple[bytes, int]]:
    """(chunk, how many of its last words are the next chunk's first): a chunk is its words with blanks between."""
    mixed, whole = windows(hashed(words), overlap)
    starts = np.flatnonzero(whole & ((mixed >> np.uint64(32)) % np.uint64(EVERY) == 0)).tolist() if len(mixed) else []
    at = 0
    for b in starts:
        if b > at:
            yield b" ".join(words[at : b + overlap]), overlap
            at = b
    if at < len(words):
        yield b" ".join(words[at:]), 0


def dictionary(docs: DataFrame, most_words: int, text_col: str = "text", group_col: str = "lang") -> DataFrame:
    """(lang, chunk, context, n): the distinct chunks of all texts by group (null: und), context words at their ends being the next one's, and their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("collocations")
        for batch in batches:
            rows: list[tuple[str, bytes, int]] = []
            for lang, text in zip(*batch.columns, strict=True):
                if words := parts(text.as_py() or ""):
                    lang = lang.as_py()
                    rows += [(lang, *c) for c in chunks(words, most_words - 1)]
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary()).cast(pa.string()), pa.array(cols[2], pa.int32())], ["lang", "chunk", "context"])

    rows = docs.select(F.coalesce(F.col(group_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, "lang string, chunk string, context int").groupBy("lang", "chunk", "context").agg(F.count(F.lit(1)).alias("n"))


def mixed_bytes(words: pa.BinaryArray) -> np.ndarray:
    """Hash of each word from its bytes in the Arrow array, never 0; that of a break is 0. For the map alone, where words that share a hash do no harm."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64)
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(sizes.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
        place = np.arange(len(data)) - np.repeat(starts, sizes)
        h = np.add.reduceat((data + np.uint64(1)) * powers[place], starts) if len(data) else np.zeros(0, np.uint64)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) | np.uint64(1)
    h[pa.compute.equal(words, BREAK).to_numpy(zero_copy_only=False)] = 0
    return h


class Block(NamedTuple):
    """Chunks of one group in a row, breaks between them. Each different word is looked at once; the words in a row are its numbers."""

    lang: str
    known: pa.BinaryArray  # the different words
    ids: np.ndarray  # the words in a row, as places in known
    weights: np.ndarray  # of the phrases that begin at each word; 0 for what is the next chunk's, and for breaks
    pairs: np.ndarray  # hash of each word, the next and the group
    whole: np.ndarray  # whether there is such a pair


def blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    lang, chunk, context, n = batch.columns
    for one in lang.unique():
        at = np.flatnonzero(pa.compute.equal(lang, one).to_numpy(zero_copy_only=False))
        texts = chunk.take(pa.array(at)).cast(pa.binary())
        sizes = pa.compute.count_substring(texts, " ").to_numpy() + 1
        split = pa.compute.split_pattern(pa.array([b" . ".join(texts.to_pylist())], pa.binary()), " ").flatten().dictionary_encode()
        known, ids = split.dictionary, split.indices.to_numpy().astype(np.int64)
        h = mixed_bytes(known)[ids]
        own, weight = context.to_numpy()[at], n.to_numpy()[at]
        # each chunk's words, then a break, but for the last
        within = np.arange(len(ids)) - np.repeat(np.cumsum(sizes + 1) - sizes - 1, sizes + 1)[: len(ids)]
        weights = np.where(within < np.repeat(sizes - own, sizes + 1)[: len(ids)], np.repeat(weight, sizes + 1)[: len(ids)], 0)
        weights[h == 0] = 0
        mixed, whole = windows(h, 2)
        yield Block(one.as_py(), known, ids, weights, mixed ^ np.uint64(xxhash.xxh3_64_intdigest(one.as_py())), whole)


def phrases(b: Block, may: np.ndarray, most_words: int) -> Iterator[tuple[int, pa.BinaryArray, np.ndarray]]:
    """(words, phrases, occurrences): the different phrases of each length from 1 in a block; of two words and more, where may holds for all their pairs."""
    total = np.zeros(len(b.known), np.int64)
    np.add.at(total, b.ids, b.weights)
    seen = np.flatnonzero(total)
    yield 1, b.known.take(pa.array(seen)), total[seen]
    at = np.flatnonzero(may & (b.weights > 0))
    code = b.ids[at]  # numbers what stands at each place so far
    for k in range(2, most_words + 1):
        _, first, code = np.unique(code * len(b.known) + b.ids[at + k - 1], return_index=True, return_inverse=True)
        total = np.zeros(len(first), np.int64)
        np.add.at(total, code, b.weights[at])
        yield k, pa.compute.binary_join_element_wise(*(b.known.take(pa.array(b.ids[at[first] + i])) for i in range(k)), b" "), total
        on = may[at + k - 1]
        at, code = at[on], code[on]


def frequent_map(chunked: DataFrame, least: int) -> np.ndarray:
    """MAP_BITS bits as bytes: that of every pair of neighbouring words with least occurrences or more in its group is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("collocations")
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            key, weight = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            held.clear()
            order = np.argsort(key)
            key, weight = key[order], weight[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            return pa.record_batch([pa.array(key[first].view(np.int64)), pa.array(np.add.reduceat(weight, first) if len(key) else weight)], ["pair", "n"])

        for batch in batches:
            for b in blocks(batch):
                at = np.flatnonzero(b.whole & (b.weights[:-1] > 0))
                held.append((b.pairs[at], b.weights[at]))
            if sum(len(key) for key, _ in held) > HELD:
                yield out()
        yield out()

    place = F.pmod("pair", F.lit(MAP_BITS))
    often = chunked.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    bits = often.groupBy(F.call_function("shiftright", place, F.lit(6)).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("pair", F.lit(64)).cast("int"))).alias("bits"))
    made = bits.toArrow()  # MAP_BITS / 64 rows at most
    out = np.zeros(MAP_BITS >> 6, np.int64)
    out[made["at"].to_numpy()] = made["bits"].to_numpy()
    return out.view(np.uint8)


def counts(chunked: DataFrame, most_words: int, least: int) -> DataFrame:
    """(lang, words, phrase, n): phrases of up to most_words words with least occurrences or more; with 0 words, all words of the group."""
    spark = chunked.sparkSession
    known = spark.sparkContext.broadcast(frequent_map(chunked, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("collocations")
        names, held, bits = ["lang", "words", "phrase", "n"], [], known.value

        def rows(lang: str, k: int, found: pa.BinaryArray, total: np.ndarray) -> pa.Table:
            return pa.table([pa.repeat(pa.scalar(lang, pa.string()), len(found)), pa.repeat(pa.scalar(k, pa.int32()), len(found)), found, pa.array(total, pa.int64())], names)

        def out() -> Iterator[pa.RecordBatch]:
            summed = pa.concat_tables(held).group_by(names[:3], use_threads=False).aggregate([("n", "sum")])
            held.clear()
            yield from pa.table([*summed.columns[:2], summed["phrase"].cast(pa.string()), summed["n_sum"]], names).to_batches()

        for batch in batches:
            for b in blocks(batch):
                held.append(rows(b.lang, 0, pa.array([b""], pa.binary()), b.weights.sum()[None]))
                place = (b.pairs.view(np.int64) % MAP_BITS).astype(np.int64)
                may = np.r_[b.whole & ((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool), False]
                held += [rows(b.lang, *found) for found in phrases(b, may, most_words)]
            if sum(t.num_rows for t in held) > HELD:
                yield from out()
        if held:
            yield from out()

    found = chunked.mapInArrow(run, "lang string, words int, phrase string, n long").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return found.where(f"n >= {least} or words = 0")


def mine(docs: DataFrame, most_words: int = 3, least: int = 10, best: int = 2000, share: int = 50, text_col: str = "text", group_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each group's best phrases of 2 to most_words words.

    Words are [^\\x20\\x09]+ between the breaks [.,;:!?\\x0A-\\x0D], A-Z in lower case; phrases do not go over a break. a, l and r are the
    occurrences of the phrase and of its parts at the cut of the lowest floor(1000000 a a / (l r)), its score (ties: the earliest cut); n
    is that of all words of the group. Phrases occur least times or more; those within a longer one that has share percent of
    their occurrences or more are dropped. Ranks go by score and a, both descending, and the phrase. Null texts are empty, a null
    group is und; repeated rows count each; texts of any length count whole. The empty table gives no rows.
    """
    spark = docs.sparkSession
    with Scratch(spark) as s:
        with short_batches(spark):
            chunked = s.cut(dictionary(docs, most_words, text_col, group_col), "dictionary")
        with short_batches(spark, 5000):
            found = s.cut(counts(chunked, most_words, least), "counts")
        s.drop(chunked)
        of = lambda part: found.select("lang", F.col("phrase").alias(part), F.col("n").alias(part[0]))
        phrases = found.where("words > 1").select("lang", "phrase", F.col("n").alias("a"), "words", F.split("phrase", " ").alias("_w"))
        cuts = phrases.select("lang", "phrase", "a", "words", "_w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
        at = lambda first, n: F.concat_ws(" ", F.slice("_w", first, n))
        cuts = cuts.select("lang", "phrase", "a", "k", at(F.lit(1), F.col("k")).alias("left"), at(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
        whole = lambda c: F.col(c).cast("decimal(19,0)")
        valued = cuts.join(of("left"), ["lang", "left"]).join(of("right"), ["lang", "right"])
        # a a stays below 10^32 for 10^13 occurrences: decimals hold it whole
        valued = valued.withColumn("up", (whole("a") * whole("a")).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("down", (whole("l") * whole("r")).cast("decimal(38,0)"))
        valued = valued.withColumn("score", F.expr("up div down"))
        scored = valued.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("m")).select("lang", "phrase", "a", "m.l", "m.r", "m.score")
        inner = phrases.where("words > 2").select("lang", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: at(i, n))))).alias("phrase"))
        longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
        left = scored.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("_longer") < share * F.col("a"), F.lit(True))).drop("_longer")
        order = (F.desc("score"), F.desc("a"), "phrase")
        some = left.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANKED_IN)))
        some = some.withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_rank") <= best)
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
        total = found.where("words = 0").select("lang", "n")
        return cut(ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
