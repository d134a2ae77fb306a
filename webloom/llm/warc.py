"""WARC archives with dictionary-compressed records.

A writer task gathers records up to ``archive_bytes``, trains a Zstandard dictionary on a bounded
sample of them, puts it into a leading skippable frame and compresses every record into a frame of
its own, so any record can be read with the dictionary alone. Every archive that holds a record has
a dictionary: where there is too little to train on, it is plain content of the sample. Archives go to the shared folder
through its file system; a task hands on the names of the files that it finished, so files of lost
or repeated attempts are never read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import scratch, stored

#: Magic number of the skippable frame that holds the dictionary, and of a Zstandard frame.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: Fixed by the WARC 1.1 specification.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of payload per archive, of the dictionary, and of the records it is trained on.
ARCHIVE_BYTES, DICTIONARY_BYTES, SAMPLE_BYTES = 16 << 20, 32 << 10, 2 << 20
#: Bytes of one piece of the sample.
PIECE_BYTES = 8 << 10
READ_BYTES = 1 << 20


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _line(value) -> str:
    """A header value on one line."""
    return " ".join(str(value).split())


def record(page_id, url, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record: an HTTP response, or a revisit that keeps its headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def sample(records: list[bytes]) -> list[bytes]:
    """Pieces of ``PIECE_BYTES`` at most, ``SAMPLE_BYTES`` together: evenly spread records, and evenly spread parts of long ones."""
    step = max(1, -(-len(records) * PIECE_BYTES // SAMPLE_BYTES))
    chosen = records[::step]
    share = SAMPLE_BYTES // max(1, len(chosen))
    pieces = []
    for r in chosen:
        n = min(-(-len(r) // PIECE_BYTES), max(1, share // PIECE_BYTES))
        width = min(PIECE_BYTES, len(r))
        pieces += [r[at:at + width] for at in (k * (len(r) - width) // max(1, n - 1) for k in range(n))]
    return pieces


def train_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from a bounded sample of the records; the end of the sample itself where there is too little to train on."""
    pieces = sample(records)
    size = min(DICTIONARY_BYTES, max(1024, sum(map(len, pieces)) // 10))
    try:
        return zstandard.train_dictionary(size, pieces, k=200, d=8).as_bytes()
    except zstandard.ZstdError:  # too little or too uniform data: plain content serves as well
        return b"".join(pieces)[-size:]


def archive(records: list[bytes], level: int = 3) -> bytes:
    """Archive of the records: the dictionary frame, then a frame per record."""
    trained = train_dictionary(records)
    packed = zstandard.ZstdCompressor(level=level, write_content_size=True).compress(trained)
    parts = [struct.pack("<II", DICTIONARY_MAGIC, len(packed)), packed]
    known = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
    compressor = zstandard.ZstdCompressor(level=level, write_content_size=True, **known)
    parts += [compressor.compress(r) for r in records]
    return b"".join(parts)


def read_archive(stream) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("the archive does not begin with a dictionary frame")
    trained = zstandard.ZstdDecompressor().decompress(stream.read(size))
    known = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
    decompressor = zstandard.ZstdDecompressor(**known)
    held = b""
    frame, parts, begun = decompressor.decompressobj(), [], False
    while True:
        held = held or stream.read(READ_BYTES)
        if not held:
            break
        parts.append(frame.decompress(held))
        held, begun = b"", True
        if frame.eof:
            yield b"".join(parts)
            held = frame.unused_data
            frame, parts, begun = decompressor.decompressobj(), [], False
    if begun:
        raise ValueError("the archive ends inside a record")


def parse(body: bytes) -> dict:
    """Header fields of a record (names in lower case), its HTTP length and its payload."""
    head, _, rest = body.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(v) for k, _, v in (line.partition(":") for line in http.decode().split("\r\n")) if k.lower() == "content-length")
    return fields | {"http-length": length, "payload": payload}


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id, url, html`` with ``refers_to``: the largest page_id with the same payload, null for that page itself.

    Payloads are compared by SHA-1 and length; below ``least`` bytes nothing refers. The largest
    ids are found by a sum per digest before they are joined, so hot payloads can be split.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.sha1(body.cast("binary")).alias("sha"), F.octet_length(body).alias("size"))
    owners = keyed.groupBy("sha", "size").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).filter(
        (F.col("n") > 1) & (F.col("size") >= least)).select("sha", "size", "owner")
    joined = keyed.join(owners, ["sha", "size"], "left")
    return joined.select(
        "page_id", "url", "html",
        F.when(F.col("owner").isNotNull() & ~F.col("owner").eqNullSafe(F.col("page_id")), F.col("owner")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``page_id, url, html, refers_to`` rows to archives; returns a row ``path, records`` per file."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)

        def flush(records: list[bytes]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(archive(records))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(records)], pa.int64())], names=["path", "records"])

        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                ids, urls, bodies, refers = (c.to_pylist() for c in batch.slice(at, 64).columns)
                for page_id, url, html, refers_to in zip(ids, urls, bodies, refers):
                    payload = (html or "").encode()
                    held.append(record(page_id, url, payload, refers_to, refers_to is not None))
                    size += len(held[-1])
                    if size >= archive_bytes:
                        yield flush(held)
                        held, size = [], 0
        if held:
            yield flush(held)

    rows = pages.select("page_id", "url", "html", "refers_to")
    return stored(rows.mapInArrow(write, "path string, records long"), "archives")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """Records of the listed archives: type, ids, target, digest, length and payload."""
    names = ["record_type", "record_id", "refers_to_id", "url", "payload_digest", "payload_bytes", "payload"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{name}") as stream:
                    held, size = [], 0
                    for body in read_archive(stream):
                        held.append(parse(body))
                        size += len(body)
                        if size > READ_BYTES:
                            yield batch_of(held)
                            held, size = [], 0
                    if held:
                        yield batch_of(held)

    def batch_of(found: list[dict]) -> pa.RecordBatch:
        column = lambda key: pa.array([f.get(key) for f in found], pa.string())
        return pa.RecordBatch.from_arrays(
            [column("warc-type"), column("warc-record-id"), column("warc-refers-to"), column("warc-target-uri"),
             pa.array([f["warc-payload-digest"].removeprefix("sha1:") for f in found]),
             pa.array([f["http-length"] for f in found], pa.int64()), pa.array([f["payload"] for f in found], pa.binary())], names=names)

    schema = T.StructType([T.StructField(n, T.StringType()) for n in names[:5]] + [
        T.StructField("payload_bytes", T.LongType()), T.StructField("payload", T.BinaryType())])
    return files.select("path").repartition(files.sparkSession.sparkContext.defaultParallelism, "path").mapInArrow(read, schema)


def page_of(urn: Column, kind: T.DataType) -> Column:
    """The page id in a record id; null where the page had none."""
    inner = F.regexp_extract(urn, "^<urn:page:(.*)>$", 1)
    return F.when(inner != "", inner).cast(kind)


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages to fresh archives in the shared folder and read the archives back.

    Columns: page_id, url, payload_bytes and payload_digest (of the full payload), record_type,
    refers_to, payload. A null html is an empty payload, a null page_id stays null, a null url
    has no target header, repeated rows become records of their own (of rows that share the
    largest id too, all are responses). An empty table gives no records. Other columns go.
    """
    folder = scratch(pages.sparkSession, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    kind = pages.schema["page_id"].dataType
    found = read_archives(write_archives(revisits(pages, least), folder), folder)
    return found.select(
        page_of(F.col("record_id"), kind).alias("page_id"), "url", "payload_bytes", "payload_digest", "record_type",
        page_of(F.col("refers_to_id"), kind).alias("refers_to"), "payload")
