"""WARC archives with a Zstandard dictionary of their own.

Each task writes archives to a shared folder. The first records of an archive train its dictionary, which
stands in a leading skippable frame; each record is then a frame by itself, compressed with it, so that
any record can be read alone. Records whose payload another record has already are revisits without
payload. Files get their names by partition and appear by a rename, so a task that runs again replaces
what it wrote before.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import cut, join_groups, new_folder

#: Fixed value: magic number of the skippable frame that holds the dictionary.
FRAME = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
#: The dictionary is made from the archive's first records, up to this many bytes.
SAMPLE_BYTES = 4 << 20
#: An archive is closed when its records, uncompressed, have this many bytes.
ARCHIVE_BYTES = 256 << 20
#: Payloads below this are never revisits.
LEAST_BYTES = 100
DATE = "1970-01-01T00:00:00Z"  # pages carry no date
LEVEL = 3


def roles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The rows (id, url if any, html, _digest, _first): _first is the smallest id among rows with the same payload of
    LEAST_BYTES or more, where there are several rows of it; else null.

    Only ids and digests meet by digest, one of many rows in parts; pages then meet the ids of repeated payloads by id.
    """
    keyed = pages.withColumn("_digest", F.sha2(F.coalesce(html_col, F.lit("")).cast("binary"), 256))
    groups = keyed.where(F.octet_length(html_col) >= LEAST_BYTES).groupBy("_digest").agg(F.min(id_col).alias("_first"), F.count(F.lit(1)).alias("_n"))
    repeated = cut(groups.where("_n > 1").select("_digest", "_first", "_n"), "repeated")
    long = keyed.where(F.octet_length(html_col) >= LEAST_BYTES).select(F.col(id_col).alias("_id"), F.col("_digest").alias("_same"), "_digest")
    total = repeated.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    members = cut(join_groups(long, repeated, "_digest", "_id", total, "_n").select("_id", "_same", "_first").distinct(), "members")
    return keyed.join(members, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_same")), "left").drop("_id", "_same")


def urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def header_safe(s: str) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in s)


def record(page_id, url: str | None, payload: bytes, digest: str, first) -> bytes:
    revisit = first is not None and first != page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_safe(url)}")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(first)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary in Zstandard's format, or none where the records are too few or too small to make one."""
    cut_up = [s[i : i + 16384] for s in samples for i in range(0, len(s), 16384)]
    size = min(DICTIONARY_BYTES, sum(map(len, cut_up)) // 8)
    if len(cut_up) < 8 or size < 1024:
        return b""
    try:
        return zstandard.train_dictionary(size, cut_up, k=256, d=8, f=18, accel=4).as_bytes()
    except zstandard.ZstdError:  # too little in common
        return b""


class Archive:
    """One file being written; records wait until there are enough of them for the dictionary."""

    def __init__(self, uri: str, attempt: int):
        self.uri = uri
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.hidden = f"{self.path}.{attempt}.tmp"
        self.out = None
        self.waiting: list[bytes] = []
        self.size = 0

    def add(self, data: bytes) -> None:
        self.size += len(data)
        if self.out is None:
            self.waiting.append(data)
            if self.size >= SAMPLE_BYTES:
                self.begin()
        else:
            self.out.write(self.press.compress(data))

    def begin(self) -> None:
        d = dictionary(self.waiting)
        self.press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_checksum=True)
        self.out = self.fs.open_output_stream(self.hidden, compression=None)
        if d:
            self.out.write(struct.pack("<II", FRAME, len(d)) + d)
        for x in self.waiting:
            self.out.write(self.press.compress(x))
        self.waiting = []

    def close(self) -> None:
        if self.out is None:
            self.begin()
        self.out.close()
        self.fs.move(self.hidden, self.path)


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every row as a record and return (archive, records): the files' addresses.

    The payload is the html in UTF-8 (null: empty). Rows with equal payloads of LEAST_BYTES or more: the one with
    the smallest id is the response, the others revisit it; rows that repeat its id are responses as well.
    A null id has an empty name, and is no group's first while another row has an id. The empty table
    makes no archive. folder is one that all executors reach through pyarrow; by default in the shared one.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    rows = roles(pages.select(id_col, url_col, html_col), id_col, html_col).select(id_col, url_col, html_col, "_digest", "_first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, now = 0, 0, None
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        made = []
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(5)), strict=True):
                key, url, html, digest, first = (x.as_py() for x in row)
                if now is None:
                    now, n = Archive(f"{folder}/part-{part:06d}-{at:04d}.warc.zst", attempt), 0
                now.add(record(key, url, (html or "").encode(), digest, first))
                n += 1
                if now.size >= ARCHIVE_BYTES:
                    now.close()
                    made.append((now.uri, n))
                    at, now = at + 1, None
        if now is not None:
            now.close()
            made.append((now.uri, n))
        yield pa.record_batch([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], ["archive", "records"])

    return cut(rows.mapInArrow(run, "archive string, records long"), "archives")


def frames(uri: str) -> Iterator[bytes]:
    """The decompressed frames of an archive, one after another."""
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_stream(path, compression=None) as f:
        data = f.read(8)
        known = None
        if len(data) == 8 and struct.unpack("<I", data[:4])[0] == FRAME:
            known = zstandard.ZstdCompressionDict(f.read(struct.unpack("<I", data[4:])[0]))
            data = b""
        d = zstandard.ZstdDecompressor(dict_data=known)
        while data or (data := f.read(1 << 20)):
            o, out = d.decompressobj(), []
            while not o.eof:
                if not data and not (data := f.read(1 << 20)):
                    raise ValueError(f"{uri} ends within a frame")
                out.append(o.decompress(data))
                data = o.unused_data if o.eof else b""
            yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The fields and the block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read(archives: DataFrame, id_type: str = "long", payload: bool = True) -> DataFrame:
    """The records of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    payload_digest of a response is taken from the payload that was read. payload is null for revisits, and for
    all if not asked for. A record whose length or digest is wrong fails the job.
    """
    n = max(1, archives.count())

    def key(x: str):
        x = x[len("<urn:page:") : -1]
        return None if x == "" else x if id_type == "string" else int(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0):
                rows, size = [], 0
                for data in frames(uri.as_py()):
                    f, block = parse(data)
                    http, _, body = block.partition(b"\r\n\r\n")
                    length = int(http.rsplit(b"Content-Length: ", 1)[1])
                    digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
                    kind = f["WARC-Type"]
                    if kind == "response":
                        own = hashlib.sha256(body).hexdigest()
                        if (own, len(body)) != (digest, length):
                            raise ValueError(f"{uri}: {f['WARC-Record-ID']} is damaged")
                    rows.append((key(f["WARC-Record-ID"]), f.get("WARC-Target-URI"), length, digest, kind, key(f["WARC-Refers-To"]) if kind == "revisit" else None, body if payload and kind == "response" else None))
                    size += len(data)
                    if size > 8_000_000:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [kinds[id_type], pa.string(), pa.int64(), pa.string(), pa.string(), kinds[id_type], pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return archives.select("archive").repartition(n).mapInArrow(run, f"page_id {id_type}, url string, payload_bytes long, payload_digest string, record_type string, refers_to {id_type}, payload binary")
