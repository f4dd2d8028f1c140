"""WARC archives through Spark's own writers and readers, and a chunked record table.

Archives are gzipped text files written by Spark's text writer, so they land in
any store that Spark can write to; a gzipped file is read by one task in order.
Payloads over ``CHUNK`` bytes are written in HTTP's chunked transfer encoding, each chunk
a line of its own, so neither writing nor reading meets a longer line, whether or not
the payload has line feeds; digests are of the payload without the encoding. Reading
streams lines and never holds a record: it yields rows of record identifier and
chunk number that carry the digest so far. (A foreign archive's line without end is read
as one piece.)
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import spread
from .store import materialize

CHUNK = 1 << 20
ID = "urn:docloom:page:"
HEX, B32HEX, B32 = 16, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(col) -> F.Column:
    """Upper-case base32 SHA-1 of a binary column, in SQL functions."""
    h = F.sha1(col)
    return F.translate(F.concat(*(F.lpad(F.conv(F.substring(h, i, 5), HEX, 32), 4, "0") for i in range(1, 41, 5))), B32HEX, B32)


def _records(chunk: int, date: str):
    """Rows of text that the writer ends with a line feed each; together they are the records."""

    def rows(page_id, url, body: bytes, digest: str, kind: str, first) -> Iterator[bytes]:
        url = "".join(c if " " < c < "\x7f" or c > "\xa0" else "".join(f"%{x:02X}" for x in c.encode()) for c in url or "").encode("utf-8", "replace")
        cuts = range(0, len(body), chunk) if kind == "response" and len(body) > chunk else ()
        length = "Transfer-Encoding: chunked" if cuts else f"Content-Length: {len(body)}"
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{length}\r\n\r\n".encode()
        sizes = [min(chunk, len(body) - i) for i in cuts]
        kept = sum(len(f"{n:x}") + 4 + n for n in sizes) + 5 if cuts else len(body) if kind == "response" else 0
        head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{ID}{'' if page_id is None else page_id}>\r\nWARC-Date: {date}\r\nWARC-Payload-Digest: sha1:{digest}\r\n".encode()
        head += b"WARC-Target-URI: " + url + b"\r\n" if url else b""
        head += f"WARC-Refers-To: <{ID}{first}>\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n".encode() if kind == "revisit" else b""
        head += f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(http) + kept}\r\n\r\n".encode() + http
        for at, n in zip(cuts, sizes, strict=True):
            yield head + f"{n:x}\r".encode()
            yield body[at : at + n] + b"\r"
            head = b""
        yield b"0\r\n\r\n\r\n\r" if cuts else head + body[:kept] + b"\r\n\r"

    return rows


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, chunk: int = CHUNK, date: str = "1970-01-01T00:00:00Z") -> None:
    """One record per row of pages (page_id, url, html); html in UTF-8 is the payload, null is empty.

    Of records with equal payloads of at least ``min_bytes`` bytes, that with the
    smallest page_id is the response and the others are revisits of it; shorter ones
    are all responses. Rows that repeat a page_id with the same payload repeat its record.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    src = pages.select("page_id", "url", body.alias("body")).withColumns({"digest": base32_sha1(F.col("body")), "size": F.octet_length("body")})
    seen = materialize(src.select("page_id", "digest", "size"), "payloads")
    owner = seen.groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) & (F.col("size") >= min_bytes)).drop("n")
    # Copies of one payload, of an empty page say, don't meet in one task.
    revisit = spread(seen, owner, ["digest", "size"], ["page_id"]).filter(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "first").distinct()
    # Payloads move once, by page_id, which no group of copies can fill.
    src = src.drop("size").join(revisit, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")), "left").select("page_id", "url", "body", "digest", "first", F.col("again_digest").isNotNull().alias("again"))
    rows = _records(chunk, date)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for page_id, url, body, digest, first, again in zip(*(c for c in batch.columns), strict=True):
                for row in rows(page_id.as_py(), url.as_py(), body.as_py(), digest.as_py(), "revisit" if again.as_py() else "response", first.as_py()):
                    out.append(row)
                    size += len(row)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    src.mapInArrow(build, "value binary").select(F.col("value").cast("string").alias("value")).write.option("compression", "gzip").text(path)


class _Reader:
    """Takes lines (without the line feed) in order and yields chunk rows."""

    def __init__(self, chunk: int, with_data: bool):
        self.chunk, self.with_data, self.left, self.head, self.in_head = chunk, with_data, 0, {}, False

    def feed(self, line: bytes) -> Iterator[tuple]:
        if self.left > 0:
            piece = (line + b"\n")[: self.left]
            self.left -= len(piece)
            yield from self.block(piece)
            if not self.left:
                yield self.row(True)
        elif self.in_head:
            if line.rstrip(b"\r"):
                name, _, value = line.rstrip(b"\r").partition(b":")
                self.head[name.strip().lower()] = value.strip()
            else:
                self.in_head, self.left = False, int(self.head.get(b"content-length", 0))
                self.http, self.size, self.kept, self.no, self.sha, self.pieces = b"", 0, 0, 0, hashlib.sha1(), []
                self.chunked, self.need, self.skip, self.line, self.over = False, 0, 0, b"", False
                self.in_http = b"http" in self.head.get(b"content-type", b"")
                if not self.left:
                    yield self.row(True)
        elif line.startswith(b"WARC/"):
            self.head, self.in_head = {}, True

    def block(self, piece: bytes) -> Iterator[tuple]:
        if self.in_http:
            self.http += piece
            end = self.http.find(b"\r\n\r\n")
            if end < 0:
                return
            piece, self.http, self.in_http = self.http[end + 4 :], self.http[:end], False
            self.chunked = bool(re.search(rb"(?im)^transfer-encoding:.*\bchunked\s*$", self.http))
        for whole in self.plain(piece) if self.chunked else (piece,):
            yield from self.payload(whole)

    def plain(self, piece: bytes) -> Iterator[bytes]:
        """What is payload in a piece of a chunked body: sizes, line ends and what follows the last chunk go."""
        while piece and not self.over:
            if self.need:
                part, piece = piece[: self.need], piece[self.need :]
                self.need -= len(part)
                self.skip = 0 if self.need else 2
                yield part
            elif self.skip:
                self.skip, piece = max(0, self.skip - len(piece)), piece[self.skip :]
            else:
                line, end, piece = piece.partition(b"\n")
                self.line += line
                if end:
                    self.need, self.line = int(self.line.partition(b";")[0].strip() or b"0", 16), b""
                    self.over = not self.need

    def payload(self, piece: bytes) -> Iterator[tuple]:
        for i in range(0, len(piece), self.chunk):
            part = piece[i : i + self.chunk]
            self.sha.update(part)
            self.size += len(part)
            self.kept += len(part)
            if self.with_data:
                self.pieces.append(part)
            if self.kept >= self.chunk:
                yield self.row(False)

    def row(self, last: bool) -> tuple:
        clean = lambda k: self.head.get(k, b"").decode("utf-8", "replace")
        kind, size, digest = clean(b"warc-type"), self.size, base64.b32encode(self.sha.digest()).decode()
        if kind == "revisit":  # the payload is the other record's; this one tells its digest and length
            digest = clean(b"warc-payload-digest").rpartition(":")[2]
            size = next((int(v) for k, _, v in (x.partition(b":") for x in self.http.split(b"\r\n")) if k.lower() == b"content-length"), 0)
        out = (clean(b"warc-record-id").strip("<>"), self.no, kind, clean(b"warc-refers-to").strip("<>") or None, clean(b"warc-target-uri") or None, b"".join(self.pieces) if self.with_data else None, self.kept, size, digest, last)
        self.no, self.kept, self.pieces = self.no + 1, 0, []
        return out


SCHEMA = "record_id string, chunk_no int, record_type string, refers_to_id string, url string, data binary, chunk_bytes long, payload_bytes long, payload_digest string, last boolean"


def read_chunks(spark: SparkSession, path: str, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """Rows of (record_id, chunk_no): payload bytes and digest up to and with this chunk; ``last`` marks a record's end.

    ``data`` has the chunk's bytes (null without ``with_data``). Files must be gzipped, so that none is split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, out, size = _Reader(chunk, with_data), [], 0
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for line in batch.column(0):
                for row in reader.feed(line.as_py()):
                    out.append(row)
                    size += len(row[5] or b"") + 200
                    if size > 8 << 20:
                        yield flush()
                        out, size = [], 0
        if out:
            yield flush()

    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("value")).mapInArrow(run, SCHEMA)


def records(chunks: DataFrame) -> DataFrame:
    """One row per record from its last chunk: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(ID) + 1}) AS BIGINT)")
    return chunks.filter("last").select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to_id").alias("refers_to"))
