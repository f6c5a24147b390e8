"""Indexing a corpus: chunks, embeddings, points, inverted index."""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.workers import pieces

SIZE, OVERLAP = 512, 100


def words(text: str) -> Column:
    """Words of a text column, split at white space."""
    return F.filter(F.split(F.col(text), r"\s+"), lambda x: x != "")


def windows(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, text: str = "text") -> DataFrame:
    """(doc_id, chunk_id, text): windows of so many words, each sharing `overlap` with the last. Texts without words have none."""
    step = size - overlap
    w = docs.select("doc_id", words(text).alias("_w")).where("size(_w) > 0")
    n = F.greatest(F.lit(1), F.ceil((F.size("_w") - overlap) / step).cast("int"))
    cuts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.array_join(F.slice("_w", k * step + 1, size), " "))
    return w.select("doc_id", F.posexplode(cuts).alias("chunk_id", "text"))


def _cut_up(docs: DataFrame, pack: Callable[[str], list[str]]) -> DataFrame:
    """(doc_id, chunk_id, text): what pack makes of each text (null: empty), numbered from 0; a piece of the texts at a time."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            found = [pack(t.as_py() or "") for t in piece.column(1)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield pa.record_batch([piece.column(0).take(pa.array(np.repeat(np.arange(len(found)), sizes))), pa.array(at, pa.int32()), pa.array([c for cs in found for c in cs], pa.string())], ["doc_id", "chunk_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, chunk_id int, text string")


def sentences(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_id, text): whole sentences packed up to `size` words; the next chunk starts with the last
    sentences of this one, up to `overlap` words. A longer sentence is a chunk by itself."""

    def pack(text: str) -> list[str]:
        parts = [(s, len(s.split())) for s in re.findall(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+$", text) if s.strip()]
        out, now, n = [], [], 0
        for s, k in parts:
            if now and n + k > size:
                out.append("".join(x for x, _ in now))
                kept, n = [], 0
                while now and n + now[-1][1] <= overlap and n + now[-1][1] + k <= size:
                    kept.insert(0, now[-1])
                    n += now.pop()[1]
                now = kept
            now.append((s, k))
            n += k
        return [*out, "".join(x for x, _ in now)] if now else out

    return _cut_up(docs, pack)


def hash_embedder(dims: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Signed feature hashing of lower-cased words, scaled to length 1 (zero for no words): needs no model."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for row, t in zip(out, texts, strict=True):
            for w in re.findall(r"\w+", t.lower()):
                h = zlib.crc32(w.encode())
                row[h % dims] += 1 if h >> 31 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)

    return embed


def embed(chunks: DataFrame, model: Callable[[list[str]], np.ndarray], batch: int = 256) -> DataFrame:
    """Adds vector (array<float>) and error, in batches. Where a batch fails its rows are tried one by one, and a row that fails gets the error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, batch):
            texts = [t or "" for t in piece.column(piece.schema.get_field_index("text")).to_pylist()]
            try:
                vectors, errors = pa.array([np.asarray(v, np.float32) for v in model(texts)], pa.list_(pa.float32())), [None] * len(texts)
            except Exception:
                found, errors = [], []
                for t in texts:
                    try:
                        found.append(np.asarray(model([t])[0], np.float32))
                        errors.append(None)
                    except Exception as e:
                        found.append(None)
                        errors.append(str(e))
                vectors = pa.array(found, pa.list_(pa.float32()))
            yield pa.record_batch([*piece.columns, vectors, pa.array(errors, pa.string())], [*piece.schema.names, "vector", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInArrow(run, f"{schema}, vector array<float>, error string")


def points(chunks: DataFrame) -> DataFrame:
    """Chunks with an id that depends on document and ordinal alone, so that indexing again does not double them."""
    return chunks.withColumn("id", F.sha2(F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_id").cast("string")), 256))


def postings(docs: DataFrame, text: str = "text", lengths: bool = False) -> DataFrame:
    """(token, doc_id, tf): lower-cased word tokens of 2 to 15 characters. Counted within each row, so nothing is shuffled.

    With lengths also dl, the tokens of the row, and first, which holds for one posting of each row. Rows that share an id have
    postings each. Texts without a token, and null ones, have none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["token", "doc_id", "tf", *(["dl", "first"] if lengths else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            found = [Counter([t for t in (x.as_py() or "").split("\n") if 2 <= len(t) <= 15]) for x in piece.column(1)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            cols = [pa.array([t for c in found for t in c], pa.string()), piece.column(0).take(pa.array(np.repeat(np.arange(len(found)), sizes))), pa.array([n for c in found for n in c.values()], pa.int64())]
            if lengths:
                first = np.zeros(int(sizes.sum()), bool)
                first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
                cols += [pa.array(np.repeat([c.total() for c in found], sizes), pa.int64()), pa.array(first)]
            yield pa.record_batch(cols, names)

    # lower case and what separates tokens are Spark's, so queries are cut up the same way
    ready = docs.select("doc_id", F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}_]+", "\n").alias("_t"))
    return ready.mapInArrow(run, f"token string, doc_id {kind}, tf long" + ", dl long, first boolean" * lengths)


@cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: What splits a text before byte-level BPE: white space as the tokenizer has it; words whose tokens a worker remembers, and the length up to which it does.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
REMEMBERED, LONGEST = 500_000, 60
_PIECES = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class Tokens:
    """Where the tokens of texts begin, for a tokenizers file, without special tokens.

    Byte-level BPE without a normalizer splits a text at its white space first, so pieces are encoded once and remembered. Texts with the
    string of an added token, and all texts for other tokenizers, go through the library whole.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.tokenizer = _tokenizer(path)
        before = made.get("pre_tokenizer") or {}
        known = (before.get("type"), before.get("use_regex", True), before.get("add_prefix_space"), made.get("normalizer"), made["model"]["type"])
        self.by_pieces = known == ("ByteLevel", True, False, None, "BPE") and not (made["model"].get("dropout") or made.get("truncation") or made.get("padding") or made.get("post_processor"))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> list[tuple[int, int]]:
        return self.tokenizer.encode(text, add_special_tokens=False).offsets

    def learn(self, new: list[str]) -> None:
        """Words that begin with a blank are the same pieces one after another, so they are encoded as one text."""
        starts = np.array([a for a, _ in self("".join(new))], np.int64)
        edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))])
        at = np.searchsorted(starts, edges).tolist()
        within = (starts - np.repeat(edges[:-1], np.diff(at))).tolist()
        if len(self.memo) + len(new) > REMEMBERED:
            self.memo.clear()
        self.memo.update((w, tuple(within[i:j])) for w, (i, j) in zip(new, pairwise(at), strict=True))

    def piece(self, word: str) -> tuple[int, ...]:
        if (at := self.memo.get(word)) is None:
            at = tuple(a for a, _ in self(word))
            if len(word) <= LONGEST:
                if len(self.memo) >= REMEMBERED:
                    self.memo.clear()
                self.memo[word] = at
        return at

    def cut(self, text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray] | None:
        """(pieces, where each begins, tokens before each, where each token begins) of a text that can be cut at its white space."""
        if not self.by_pieces or any(t in text for t in self.added):
            return None
        words = _PIECES.findall(text)
        if new := [w for w in set(words).difference(self.memo) if w[0] == " " and 1 < len(w) <= LONGEST and not w[1].isspace()]:
            self.learn(new)
        within = [self.memo.get(w) or self.piece(w) for w in words]
        edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        n = np.fromiter(map(len, within), np.int64, len(words))
        return words, edges, np.concatenate([[0], np.cumsum(n)]), np.repeat(edges[:-1], n) + np.fromiter(chain.from_iterable(within), np.int64, int(n.sum()))

    def starts(self, text: str) -> tuple[np.ndarray, Callable[[int, int], int]]:
        """(where each token begins, how many tokens text[a:b] has when it is taken by itself)."""
        alone = lambda a, b: len(self(text[a:b]))
        if (found := self.cut(text)) is None:
            return np.array([a for a, _ in self(text)], np.int64), alone
        words, edges, before, starts = found
        ends, until = edges.tolist(), before.tolist()

        def count(a: int, b: int) -> int:
            # from the start of a piece on, pieces are those of the whole text up to the last that is no white space; that and the rest are cut again
            first, last = bisect_left(ends, a), bisect_left(ends, b) - 1
            while last > first and words[last].isspace():
                last -= 1
            if ends[first] != a:  # begins within a piece: what is left of it is a piece by itself
                return sum(len(self.piece(w)) for w in _PIECES.findall(text[a:b]))
            return until[last] - until[first] + sum(len(self.piece(w)) for w in _PIECES.findall(text[ends[last] : b]))

        return starts, count


def token_chunks(text: str, places: Callable[[str], list[tuple[int, int]]], size: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of chunks of a text: whole sentences packed up to size tokens, where places gives the tokens' (start, end); a longer sentence is cut between tokens.

    The next chunk starts with the last sentences, or pieces, of this one, up to overlap tokens. No chunk has more than size
    tokens when it is taken by itself: where tokens join otherwise than in the whole text, it ends a piece earlier.
    """
    if isinstance(places, Tokens):
        starts, alone = places.starts(text)
    else:
        starts, alone = np.array([a for a, _ in places(text)], np.int64), lambda a, b: len(places(text[a:b]))
    # (start, end, tokens before the start, tokens before the end)
    units: list[tuple[int, int, int, int]] = []
    spans = [m.span() for m in re.finditer(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+$", text)]
    for (a, b), (lo, hi) in zip(spans, np.searchsorted(starts, np.array(spans, np.int64).reshape(-1, 2)).tolist(), strict=True):
        if hi - lo <= size:
            if text[a:b].strip():
                units.append((a, b, lo, hi))
            continue
        cuts = [a, *dict.fromkeys(int(x) for x in starts[lo + size : hi : size] if a < x < b), b]
        units += [(x, y, *np.searchsorted(starts, (x, y)).tolist()) for x, y in pairwise(cuts) if text[x:y].strip()]
    out, first = [], 0
    while first < len(units):
        last = first
        while last + 1 < len(units) and units[last + 1][3] - units[first][2] <= size:
            last += 1
        a, b = units[first][0], units[last][1]
        while alone(a, b) > size:
            if last > first:
                last -= 1
                b = units[last][1]
            else:  # one piece that has more tokens by itself: what is beyond goes on as a piece of its own
                b = a + max(places(text[a:b])[size][0], 1)
                rest = [(b, units[first][1])] if text[b : units[first][1]].strip() else []
                units[first : first + 1] = [(x, y, *np.searchsorted(starts, (x, y)).tolist()) for x, y in [(a, b), *rest]]
        out.append((a, b))
        if last + 1 == len(units):
            break
        end, back = int(np.searchsorted(starts, b)), last + 1
        while back - 1 > first and end - units[back - 1][2] <= overlap and units[last + 1][3] - units[back - 1][2] <= size:
            back -= 1
        first = back
    return out


@cache
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def token_sentences(docs: DataFrame, tokenizer_path: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_id, text): sentences packed by the tokens of a tokenizers file, as token_chunks does. Texts of white space have none."""

    def pack(text: str) -> list[str]:
        return [text[a:b] for a, b in token_chunks(text, _tokens(tokenizer_path), size, overlap)]

    return _cut_up(docs, pack)
