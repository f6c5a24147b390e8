"""Byte-level BPE with a backtracking encoder over a multi-pattern automaton.

Bytes are mapped to Latin-1 characters so that the automaton can hold every token. For one piece
of text the automaton gives the longest token at each position in one pass. The encoder goes from
left to right, takes the longest token that may stand after the previous one, and steps back where
none fits. Two tokens may stand side by side if merging their joined bytes by rank gives the two
back; answers are remembered. A position that turned out to be a dead end is never tried again,
so the work is linear in the text, and the result is exactly what merging by rank gives.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: White space as the tokenizer's pattern sees it (Unicode White_Space).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the pattern for which pieces can be cut at white space first.
WORDWISE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of each memo table; a full table is emptied.
MEMO = 250_000


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.fine = regex.compile(pattern)
        self.coarse = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+") if pattern == WORDWISE else None
        self.fits: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}
        self.pieces: dict[str, list[int]] = {}
        self.words: dict[str, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Merging by rank, step by step; only used on the joined bytes of two tokens."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= MEMO:
                self.fits.clear()
            known = self.fits[left, right] = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return known

    def prefix_token(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self.shorter:
            b = self.bytes_of[token]
            self.shorter[token] = next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ranks), None)
        return self.shorter[token]

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        longest: list[int | None] = [None] * (len(piece) + 1)
        for end, (size, token) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = token  # later ends are longer tokens
        alive = bytearray(b"\1") * (len(piece) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(piece):
            while token is not None and not (alive[at + len(self.bytes_of[token])] and (not out or self.may_follow(out[-1], token))):
                token = self.prefix_token(token)
            if token is not None:
                out.append(token)
                at += len(self.bytes_of[token])
                token = longest[at]
            elif out:
                alive[at] = 0
                token = out.pop()
                at -= len(self.bytes_of[token])
            else:
                raise ValueError("the vocabulary lacks single bytes")
        return out

    def _word(self, word: str) -> list[int]:
        """A stretch between spaces: its pieces by the pattern, each encoded by itself."""
        out: list[int] = []
        for piece in self.fine.findall(word):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode())
                if len(piece) < 100:
                    if len(self.pieces) >= MEMO:
                        self.pieces.clear()
                    self.pieces[piece] = ids
            out += ids
        if len(word) < 100:
            if len(self.words) >= MEMO:
                self.words.clear()
            self.words[word] = out
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for word in self.coarse.findall(text) if self.coarse else (text,):
            out += self.words.get(word) or self._word(word)
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    """One codec for each Python worker, from a rank file (base64 token, space, rank on each line)."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(b): int(i) for b, i in (line.split() for line in f if line.strip())}
    return Codec(ranks, pattern)


def _u32(ids: list[int]) -> bytes:
    a = array("I", ids)
    if a.itemsize != 4:
        a = array("L", ids)
    return a.tobytes()


def encode(docs: DataFrame, ranks_path: str, pattern: str = WORDWISE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>). Null and empty texts give an empty array; repeated rows stay repeated; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([c.encode(t.as_py()) for t in batch.column(1)], pa.list_(pa.int32()))], [id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {_type(docs, id_col)}, ids array<int>")


def decode(tokens: DataFrame, ranks_path: str, pattern: str = WORDWISE, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, data binary): the bytes of the tokens. A null array gives null bytes; an unknown id fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            data = [None if (x := v.as_py()) is None else c.decode(x) for v in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(data, pa.binary())], [id_col, "data"])

    return tokens.select(id_col, ids_col).mapInArrow(run, f"{id_col} {_type(tokens, id_col)}, data binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str = WORDWISE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode, decode the ids again, and keep digests only, in one pass without a shuffle.

    Null and empty texts count as empty: 0 tokens and the digest of no bytes. One row per input row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for batch in batches:
            n, ids_hex, data_hex = [], [], []
            for t in batch.column(1):
                ids = c.encode(t.as_py())
                n.append(len(ids))
                ids_hex.append(hashlib.sha256(_u32(ids)).hexdigest())
                data_hex.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(data_hex, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {_type(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()
