"""Token ids as flat binary files with 64-bit document offsets, memory-mapped by their readers.

Documents are dealt by ranges of their id, so the files one after another hold them in ascending order. A task writes
part-<n>.bin, the ids as unsigned integers of two or four bytes; part-<n>.idx, a header and where each document begins in it,
one more than there are documents; and part-<n>.ids, the document ids as an Arrow file. What stands before a file in the whole
is not known to its task: the manifest has these bases, which are prefix sums over the files' counts. Readers map the files and
take any document's tokens without reading others.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from contextlib import ExitStack
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import cut, new_folder, only, remember, short_batches, tasks

#: Header of an index: name, version, bytes of a token, documents.
HEADER = struct.Struct("<8sHHQ")
MAGIC, VERSION = b"TOKENIDX", 1
#: Words a worker remembers, in each of two generations.
MEMO = 400_000
#: Words that are encoded as one text.
TOGETHER = 512
#: Documents that one reading task takes from a file at a time.
BLOCK = 20_000
#: Ends the keys of pieces; no text has it.
MARK = "\ud800"
#: What splits a text: white space as the tokenizer has it.
SPACE = "\t-\r \x85\xa0  -     　"


class Encoder:
    """Ids of whole texts as the library gives them without added special tokens.

    Where the tokenizer is byte-level BPE over the usual pieces (white space goes with the letters after it), a text can be cut before
    each blank and line end, so words are encoded once and remembered as bytes; but not within three or more white-space
    characters, nor two at the end, which the library takes together: such texts are cut at their white space instead. Texts with the
    string of a special token, and all texts for any other tokenizer, go through the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        before = made.get("pre_tokenizer") or {}
        self.by_words = (before.get("type"), before.get("use_regex"), before.get("add_prefix_space"), made.get("normalizer"), made["model"]["type"]) == ("ByteLevel", True, False, None, "BPE")
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        vocabulary = self.own.get_vocab()
        self.size = max(vocabulary.values()) + 1
        # the signs that stand for a blank and a line end among the tokenizer's bytes
        self.begins = np.zeros(self.size, bool)
        self.begins[[i for t, i in vocabulary.items() if t[0] in "ĠĊ"]] = True
        self.plain = re.compile(r"\n?\S").match
        self.runs = re.compile(r"\s[ \n](?=\s|\Z)")
        self.coarse = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _each(self, words: list[str]) -> None:
        """Words by themselves, with the blank before them that their key leaves out."""
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            texts = [w if w[:1] == "\n" else f" {w}" for w in part]
            self.memo.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(part, self.own.encode_batch_fast(texts, add_special_tokens=False), strict=True))

    def learn(self, new: list[str]) -> None:
        plain = list(filter(self.plain, new))
        self._each([w for w in new if not self.plain(w)] if len(plain) < len(new) else [])
        groups = [plain[i : i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        # a blank before each, but for those that begin with a line end
        texts = [f" {' '.join(g)}".replace(" \n", "\n") for g in groups]
        for group, e in zip(groups, self.own.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(self.begins[ids])
            if len(at) != len(group):  # a word became something else beside others
                self._each(group)
                continue
            data, at = ids.tobytes(), [*(at * 4).tolist(), len(ids) * 4]
            self.memo.update(zip(group, [data[a:b] for a, b in pairwise(at)], strict=True))

    def words(self, text: str) -> list[str]:
        """Keys of the text's words: a word after a blank is its own key, one after a line end has that before it. The first
        word counts as one after a line end, whose token is dropped again."""
        return f" \n{text}".replace("\n", " \n").split(" ")[2:]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        cut_up: list[tuple[int, list[str], int]] = []
        for i, x in enumerate(texts):
            if not x:
                out[i] = np.empty(0, "<u4")
            elif not self.by_words or any(t in x for t in self.special):
                out[i] = np.array(self.own.encode(x, add_special_tokens=False).ids, "<u4")
            elif self.runs.search(x) or x[0].isspace():
                # keys of pieces that do not begin with a blank would be read as words after one, so these have an end mark
                cut_up.append((i, [p[1:] if p[0] == " " and len(p) > 1 and not p[1].isspace() else p + MARK for p in self.coarse.findall(x)], 0))
            else:
                cut_up.append((i, self.words(x), 4))
        found = set().union(*(ws for _, ws, _ in cut_up))
        if len(self.memo) > MEMO:  # what is still in use comes back from the older half
            self.older, self.memo = self.memo, {}
        new = found.difference(self.memo)
        known = [w for w in new if w in self.older]
        self.memo.update(zip(known, map(self.older.__getitem__, known), strict=True))
        new.difference_update(known)
        marked = [w for w in new if w[-1:] == MARK]
        new.difference_update(marked)
        self.memo.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(marked, self.own.encode_batch_fast([w[:-1] for w in marked], add_special_tokens=False), strict=True))
        self.learn(list(new))
        for i, ws, skip in cut_up:
            out[i] = np.frombuffer(b"".join(map(self.memo.__getitem__, ws)), "<u4", offset=skip)
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


remember("tokenfiles", encoder.cache_clear)


def _fs(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


class Writer:
    """The three files of one part; they get their names when all is written, so a task that runs again replaces them whole."""

    def __init__(self, folder: str, part: int, attempt: int, token_bytes: int, id_type: pa.DataType):
        self.fs, path = _fs(folder)
        self.path, self.hidden = f"{path}/part-{part:06d}", f"{path}/.part-{part:06d}.{attempt}"
        self.dtype = np.dtype(f"<u{token_bytes}")
        self.offsets = array("q", [0])
        self.open = ExitStack()
        self.bin = self.open.enter_context(self.fs.open_output_stream(f"{self.hidden}.bin", compression=None))
        self.schema = pa.schema([("id", id_type)])
        out = self.open.enter_context(self.fs.open_output_stream(f"{self.hidden}.ids", compression=None))
        self.ids = self.open.enter_context(pa.ipc.new_file(out, self.schema))

    def add(self, keys: pa.Array, every: list[np.ndarray]) -> None:
        self.ids.write_batch(pa.record_batch([keys], schema=self.schema))
        for ids in every:
            self.offsets.append(self.offsets[-1] + len(ids))
        self.bin.write(np.concatenate(every).astype(self.dtype).tobytes())

    def close(self) -> tuple[int, int]:
        self.open.close()
        with self.fs.open_output_stream(f"{self.hidden}.idx", compression=None) as f:
            f.write(HEADER.pack(MAGIC, VERSION, self.dtype.itemsize, len(self.offsets) - 1))
            f.write(np.frombuffer(self.offsets, np.int64).astype("<i8").tobytes())
        for kind in ("bin", "ids", "idx"):
            self.fs.move(f"{self.hidden}.{kind}", f"{self.path}.{kind}")
        return len(self.offsets) - 1, self.offsets[-1]


class Part:
    """One part's files: mapped into memory where they are local or mounted, else read by ranges."""

    def __init__(self, folder: str, part: int):
        self.fs, path = _fs(folder)
        self.path = f"{path}/part-{part:06d}"
        self.local = isinstance(self.fs, pafs.LocalFileSystem)
        head = self._bytes("idx", 0, HEADER.size)
        magic, version, width, self.documents = HEADER.unpack(head)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError(f"{self.path}.idx is no index of this format")
        self.dtype = np.dtype(f"<u{width}")
        self.mapped = np.memmap(f"{self.path}.bin", self.dtype, "r") if self.local and self.fs.get_file_info(f"{self.path}.bin").size else None

    def _bytes(self, kind: str, start: int, n: int) -> bytes:
        with self.fs.open_input_file(f"{self.path}.{kind}") as f:
            return f.read_at(n, start)

    def offsets(self, first: int, last: int) -> np.ndarray:
        """Where documents first..last - 1 begin, and where the last of them ends."""
        return np.frombuffer(self._bytes("idx", HEADER.size + 8 * first, 8 * (last - first + 1)), "<i8")

    def ids(self, first: int, last: int) -> pa.Array:
        with self.fs.open_input_file(f"{self.path}.ids") as f:
            file, at, out = pa.ipc.open_file(f), 0, []
            for k in range(file.num_record_batches):
                batch = file.get_batch(k)
                lo, hi = max(first - at, 0), min(last - at, batch.num_rows)
                if lo < hi:
                    out.append(batch.column(0).slice(lo, hi - lo))
                at += batch.num_rows
                if at >= last:
                    break
            return pa.concat_arrays(out) if out else pa.array([], file.schema.field(0).type)

    def tokens(self, start: int, end: int) -> np.ndarray:
        if start == end:
            return np.empty(0, self.dtype)
        if self.mapped is not None:
            return self.mapped[start:end]
        width = self.dtype.itemsize
        return np.frombuffer(self._bytes("bin", start * width, (end - start) * width), self.dtype)


def write(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the ids of every whole text, with end_id after it, in ascending order of the documents' ids; returns the folder.

    Null and empty texts have the end_id alone. Rows that repeat an id stand together, in any order among them; those without
    an id come first. A text of any length is one document. An id that a third of all rows share is dealt over many files. Further
    columns, whatever their names, do not matter. The empty table has a manifest without files. folder is one that all executors
    reach through pyarrow; by default in the shared one.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    fs, path = _fs(folder)
    fs.create_dir(path, recursive=True)
    width = 2 if max(encoder(tokenizer_path).size - 1, end_id) < 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("tokenfiles")
        part, out = TaskContext.get().partitionId(), None
        e = encoder(tokenizer_path)
        end = np.array([end_id], "<u4")
        for batch in batches:
            if batch.num_rows and out is None:
                out = Writer(folder, part, TaskContext.get().taskAttemptId(), width, batch.schema.field(0).type)
            at = 0
            while at < batch.num_rows:
                # about a million characters at a time
                first, texts, size = at, [], 0
                while at < batch.num_rows and size < 1_000_000:
                    texts.append(batch.column(1)[at].as_py() or "")
                    size += len(texts[-1]) + 1
                    at += 1
                out.add(batch.column(0).slice(first, at - first), [np.concatenate([ids, end]) for ids in e.encode(texts)])
        rows = [] if out is None else [(part, *out.close())]
        cols = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
        yield pa.record_batch(cols, ["part", "documents", "tokens"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    n = tasks(spark)
    dealt = rows.repartitionByRange(n, F.asc_nulls_first("_id"), "_row").sortWithinPartitions(F.asc_nulls_first("_id"), "_row").select("_id", "_text")
    with short_batches(spark):
        # a row a file, so the sums before each are made here
        made = sorted(tuple(r) for r in dealt.mapInArrow(run, "part long, documents long, tokens long").collect())
    before, bases = (0, 0), []
    for part, documents, tokens in made:
        bases.append((part, before[0], documents, before[1], tokens))
        before = before[0] + documents, before[1] + tokens
    spark.createDataFrame(bases, "part long, first_document long, documents long, first_token long, tokens long").coalesce(1).write.parquet(f"{folder}/manifest")
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(part, first_document, documents, first_token, tokens) of every file: first_* are what all files before it hold."""
    return spark.read.parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str, id_type: str = "long", tokens: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; with tokens=True its ids (array<long>) too.

    start counts the tokens of all documents before it. ids_crc32 is that of the ids as little-endian unsigned 32-bit integers.
    """
    blocks = manifest(spark, folder).select("part", "first_token", F.explode(F.sequence(F.lit(0).cast("long"), F.col("documents") - 1, F.lit(BLOCK).cast("long"))).alias("first"), "documents")
    n = max(1, min(blocks.count(), 4 * tasks(spark)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, base, first, documents in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p, last = Part(folder, part), min(first + BLOCK, documents)
                at = p.offsets(first, last)
                keys, lo = p.ids(first, last), 0
                while lo < last - first:
                    hi = int(np.searchsorted(at, at[lo] + 1_000_000, "right")) - 1
                    hi = min(max(hi, lo + 1), last - first)
                    own = [p.tokens(a, b).astype("<u4") for a, b in zip(at[lo:hi].tolist(), at[lo + 1 : hi + 1].tolist(), strict=True)]
                    cols = [keys.slice(lo, hi - lo), pa.array(base + at[lo:hi]), pa.array(np.diff(at[lo : hi + 1])), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                    yield pa.record_batch(cols + ([pa.array([x.astype("i8") for x in own], pa.list_(pa.int64()))] if tokens else []), ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + tokens])
                    lo = hi

    return blocks.repartition(n).mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * tokens)
