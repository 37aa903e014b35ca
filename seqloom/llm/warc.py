"""WARC archives: a writer with revisit records and a sequential, verifying reader."""

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

#: Payloads of fewer bytes are stored again rather than referred to.
MIN_REVISIT_BYTES = 100
#: Compressed bytes after which the writer begins another file.
ROLL_BYTES = 256 << 20
READ_BYTES = 1 << 18
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("payload", T.BinaryType()),
        T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()),
    ]
)


class WarcError(ValueError):
    """A record that is cut off, malformed or does not match its digests."""


def _labelled(digest: bytes) -> str:
    return "sha256:" + base64.b32encode(digest).decode()


def _unlabelled(value: str) -> bytes:
    name, _, digest = value.partition(":")
    if name.lower() != "sha256":
        raise WarcError(f"digest {value!r} is not SHA-256")
    return base64.b32decode(digest)


def _clean(value: str) -> str:
    """A header value on one line: runs of white space are one blank, and there is none at its ends."""
    return " ".join(value.split())


def record_id(page_id, url, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {url} {digest.hex()}')}>"


def record_bytes(page_id, url, payload: bytes, digest: bytes, refers_to, refers_url=None) -> bytes:
    """One uncompressed record; with refers_to a revisit, whose block has the HTTP header alone.

    refers_to and refers_url name the response's page; a URL of any length is one header line.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, url, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else _clean(url),
        "WARC-Payload-Digest": _labelled(digest),
        "WARC-Block-Digest": _labelled(hashlib.sha256(block).digest()),
        "WARC-Profile": None if refers_to is None else REVISIT_PROFILE,
        "WARC-Refers-To": None if refers_to is None else record_id(refers_to, refers_url, digest),
        "WARC-Refers-To-Target-URI": None if refers_to is None or refers_url is None else _clean(refers_url),
        "WARC-Refers-To-Date": None if refers_to is None else DATE,
        "X-Page-Id": page_id,
        "X-Refers-To-Page-Id": refers_to,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = [f"{k}: {v}" for k, v in head.items() if v is not None]
    return ("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Member:
    """The uncompressed bytes of one gzip member, read as they are asked for."""

    def __init__(self, source: "_Source"):
        self.source, self.z, self.buffer = source, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        if self.z.eof:
            return False
        data = self.source.take()
        if not data:
            raise WarcError(f"{self.source.name}: the gzip member is cut off")
        try:
            self.buffer += self.z.decompress(data, READ_BYTES)
        except zlib.error as e:
            raise WarcError(f"{self.source.name}: {e}") from e
        self.source.back(self.z.unused_data if self.z.eof else self.z.unconsumed_tail)
        return True

    def until(self, mark: bytes) -> bytes:
        at, seen = self.buffer.find(mark), 0
        while at < 0:
            seen = max(0, len(self.buffer) - len(mark) + 1)
            if not self._more():
                raise WarcError(f"{self.source.name}: no end of the header")
            at = self.buffer.find(mark, seen)
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise WarcError(f"{self.source.name}: content is shorter than its length")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out

    def rest(self) -> bytes:
        while self._more():
            if len(self.buffer) > READ_BYTES:
                raise WarcError(f"{self.source.name}: more than one record in a gzip member")
        return bytes(self.buffer)


class _Source:
    def __init__(self, stream: BinaryIO, name: str):
        self.stream, self.name, self.held, self.offset = stream, name, b"", 0

    def take(self) -> bytes:
        data, self.held = self.held or self.stream.read(READ_BYTES), b""
        self.offset += len(data)
        return data

    def back(self, data: bytes) -> None:
        self.held = data + self.held
        self.offset -= len(data)

    def at_end(self) -> bool:
        self.back(self.take())
        return not self.held


def _fields(lines: list[str], where: str) -> dict[str, str]:
    fields: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"{where}: malformed header line {line!r}")
        last = name.strip().lower()
        fields[last] = value.strip()
    return fields


def records(stream: BinaryIO, name: str = "") -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(header, block, offset) of each record: one gzip member each, framed by its content length.

    Decompression is incremental. Raises WarcError on a damaged member, a wrong version line, a
    length that does not fit, anything after the record, or a block digest that differs.
    """
    source = _Source(stream, name)
    while not source.at_end():
        offset = source.offset
        member = _Member(source)
        version, *lines = member.until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/1."):
            raise WarcError(f"{name}:{offset}: {version[:40]!r} is no WARC version")
        head = _fields(lines, f"{name}:{offset}")
        if not head.get("content-length", "").isdigit():
            raise WarcError(f"{name}:{offset}: no content length")
        block = member.exactly(int(head["content-length"]))
        if member.rest() != b"\r\n\r\n":
            raise WarcError(f"{name}:{offset}: the record does not end after its content length")
        if (stated := head.get("warc-block-digest")) and hashlib.sha256(block).digest() != _unlabelled(stated):
            raise WarcError(f"{name}:{offset}: block digest differs")
        yield head, block, offset


def parse(head: dict[str, str], block: bytes, name: str, offset: int) -> tuple:
    """The values of a RECORD row. A response's payload must match its digest and HTTP length."""
    http, _, payload = block.partition(b"\r\n\r\n")
    inner = _fields(http.decode("utf-8", "replace").split("\r\n")[1:], name)
    digest = _unlabelled(head["warc-payload-digest"])
    size = int(inner.get("content-length", len(payload)))
    if head["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).digest() != digest):
        raise WarcError(f"{name}:{offset}: payload digest or length differs")
    number = lambda key: int(head[key]) if key in head else None
    return (number("x-page-id"), head.get("warc-target-uri"), head["warc-type"], number("x-refers-to-page-id"), size, digest.hex(), payload if head["warc-type"] == "response" else None, name, offset)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, scratch: Scratch, name: str = "warc") -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) and returns the files' names.

    Of rows with equal payloads of MIN_REVISIT_BYTES or more, that with the smallest page_id is
    the response, and others revisit it; rows that repeat that page_id are responses too. A null
    html is an empty payload. Rows without page_id are responses, and nothing refers to them. White
    space in a URL is rewritten as a header line needs it (`_clean`); a URL or html of any length is
    stored whole. Without rows there are no files. Other columns are not read.

    Tasks write under names of their own attempt; the returned table lists those of the attempts
    that succeeded.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = scratch.save(rows.filter(f"length(payload) >= {MIN_REVISIT_BYTES} AND page_id IS NOT NULL").select("page_id", "digest", "url"), f"{name}-digests")
    first = large.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.max("page_id").alias("last")).filter("last > first.page_id")
    first = first.select("digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"))
    again = large.select("page_id", "digest").join(first, "digest").filter("page_id > refers_to").distinct()
    again = scratch.save(again, f"{name}-revisits").withColumn("spread", F.lit(0).cast("long"))
    # Rows without page_id match nothing; dealt out, they do not meet in one task if they are many.
    spread = F.when(F.col("page_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long"))
    plan = rows.withColumn("spread", spread).join(again, ["page_id", "digest", "spread"], "left").select("page_id", "url", "payload", "digest", "refers_to", "refers_url")
    folder = scratch.path(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, path = _filesystem(folder)
        files.create_dir(path, recursive=True)
        task = TaskContext.get()
        out, written, made = None, 0, []
        for batch in batches:
            for page, url, payload, digest, refers, refers_url in zip(*[c.to_pylist() for c in batch.columns]):
                if out is None or written >= ROLL_BYTES:
                    if out is not None:
                        out.close()
                    made.append(f"pages-{task.partitionId():06d}-{len(made):04d}-{task.taskAttemptId()}.warc.gz")
                    out, written = files.open_output_stream(f"{path}/{made[-1]}", compression=None), 0
                member = gzip_member(record_bytes(page, url, payload, bytes.fromhex(digest), refers, refers_url))
                out.write(member)
                written += len(member)
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{m}" for m in made], pa.string())], ["file"])

    return scratch.save(plan.mapInArrow(run, "file string"), f"{name}-files")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """RECORD rows of the files named in archives (file), each read in sequence and verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64())])
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                files, path = _filesystem(uri)
                rows, held = [], 0
                with files.open_input_stream(path, compression=None) as stream:
                    for head, block, offset in records(stream, uri):
                        row = parse(head, block, uri, offset)
                        rows.append(row if payloads else (*row[:6], None, *row[7:]))
                        held += len(row[6] or b"") * payloads + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema.names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema.names)

    n = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("file").repartition(n).mapInArrow(run, RECORD)
