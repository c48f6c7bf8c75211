"""WARC archives of pages: one gzip member for each record, revisits for equal payloads, a sequential reader.

A payload is a page's html in UTF-8. Of pages with equal payloads of at least
``least_bytes`` bytes the one with the smallest id is written as a response, and
the others as revisits that name it and carry the length and digest of the whole
payload; smaller payloads are all responses. Payloads are equal if their SHA-1
digests are, the identity that the format itself uses.

Spark's text writer puts the members one behind the other and a zero byte behind
each. A member of less than 16 MB ends with a zero byte (the high byte of its
length), which is left to the writer; behind a longer one the byte is padding,
which gzip allows. So the files are plain archives on any store, written through
Spark's commit.

The reader passes each file once: members are inflated piece by piece, records
are framed by their content length, and digests are computed on the way and have
to agree with the headers.

Null html is empty; null and odd addresses are left out or percent-encoded. Null
ids count as greater than all others. Repeated rows are records of their own: all
rows of the smallest id are responses. Empty tables give archives without
records. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 64 << 10
PAYLOAD_CHUNK = 1 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _address(url: str | None) -> str | None:
    return re.sub(r"[^!-~]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), url) if url else None


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, response: tuple[int | None] | None = None) -> bytes:
    """A response with its payload, or a revisit of the page whose id is in ``response``."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if response is None:
        block += payload
    headers = {
        "WARC-Type": "response" if response is None else "revisit",
        "WARC-Record-ID": _urn(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": _address(url),
        "WARC-Payload-Digest": "sha1:" + base32_sha1(payload),
        "WARC-Block-Digest": "sha1:" + base32_sha1(block),
        "WARC-Profile": None if response is None else PROFILE,
        "WARC-Refers-To": None if response is None else _urn(response[0]),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _before_zero(data: bytes) -> bytes:
    """The member without the zero byte that the writer puts behind it anyway."""
    return data[:-1] if data[-1] == 0 else data


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> None:
    """Write every page to gzip archives in a new folder."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest")
    )
    # Pages are counted by digest in the map tasks, so a payload that many pages share is one row of each.
    first = (
        rows.where(F.octet_length("html") >= least_bytes)
        .groupBy(F.col("digest").alias("of"))
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    joined = rows.join(first, F.col("digest") == F.col("of"), "left").select(
        "page_id",
        "url",
        "html",
        "first_id",
        (F.col("of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))).alias("revisit"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(at, 256).to_pylist():
                    payload = r["html"].encode("utf-8", "surrogatepass")
                    response = (r["first_id"],) if r["revisit"] else None
                    out.append(_before_zero(member(record(r["page_id"], r["url"], payload, response))))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    values = joined.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    values.write.option("lineSep", "\0").text(folder)


class Stream:
    """Bytes of an archive, inflated member by member as they are asked for."""

    def __init__(self, data: memoryview) -> None:
        self.data, self.at = data, 0
        self.inflate = zlib.decompressobj(31)
        self.held = bytearray()
        self.begun = False

    def more(self) -> bool:
        """Inflate up to CHUNK bytes of the current member; false at its end."""
        if self.inflate.eof:
            return False
        tail = self.inflate.unconsumed_tail
        if not tail:
            tail = self.data[self.at : self.at + CHUNK]
            self.at += len(tail)
        if not len(tail):
            raise ValueError("the archive ends inside a record")
        self.held += self.inflate.decompress(tail, PAYLOAD_CHUNK)
        return True

    def next_member(self) -> bool:
        """Go to the next member; false at the end of the archive."""
        if self.begun:
            if not self.inflate.eof or self.held:
                raise ValueError("a member holds more than its record")
            self.at -= len(self.inflate.unused_data)
        while self.at < len(self.data) and self.data[self.at] == 0:
            self.at += 1
        self.inflate, self.begun = zlib.decompressobj(31), True
        return self.at < len(self.data)

    def until(self, mark: bytes) -> bytes:
        while (end := self.held.find(mark)) < 0:
            if not self.more():
                raise ValueError("a record has no end of its head")
        found = bytes(self.held[:end])
        del self.held[: end + len(mark)]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        """Exactly n bytes, in pieces."""
        while n:
            if not self.held and not self.more():
                raise ValueError("a record is shorter than its content length")
            piece = bytes(self.held[:n])
            del self.held[:n]
            n -= len(piece)
            if piece:
                yield piece

    def finish(self) -> None:
        """The two line ends behind a block, and the end of the member."""
        if b"".join(self.take(4)) != b"\r\n\r\n":
            raise ValueError("a record is longer than its content length")
        while not self.inflate.eof:
            if self.held or not self.more():
                break


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def read_archive(data: bytes, payloads: bool = False) -> Iterator[dict]:
    """The records of one archive in order; digests that disagree with the headers are an error."""
    stream = Stream(memoryview(data))
    while stream.next_member():
        head = stream.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = _fields(head)
        whole, body = hashlib.sha1(), hashlib.sha1()
        http, kept, n_body = b"", [], 0
        in_body = False
        for piece in stream.take(int(fields["content-length"])):
            whole.update(piece)
            if not in_body:
                http += piece
                start = http.find(b"\r\n\r\n")
                if start < 0:
                    continue
                http, piece, in_body = http[:start], http[start + 4 :], True
            body.update(piece)
            n_body += len(piece)
            if payloads:
                kept.append(piece)
        stream.finish()
        if fields["warc-block-digest"] != "sha1:" + base64.b32encode(whole.digest()).decode():
            raise ValueError(f"the block digest of {fields['warc-record-id']} is wrong")
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        response = fields["warc-type"] == "response"
        n_payload = int(_fields(http)["content-length"])
        if response and (n_payload != n_body or digest != base64.b32encode(body.digest()).decode()):
            raise ValueError(f"the payload of {fields['warc-record-id']} does not agree with its digest")
        yield {
            "page_id": _page(fields["warc-record-id"]),
            "payload_bytes": n_payload,
            "payload_digest": digest,
            "record_type": fields["warc-type"],
            "refers_to": _page(fields.get("warc-refers-to")),
            "url": fields.get("warc-target-uri"),
        } | ({"payload": b"".join(kept)} if payloads else {})


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
_READ = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("url", pa.string()),
    ]
)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of all archives in a folder; one file is one task's stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for content in batch.column(0):
                for found in read_archive(content.as_buffer().to_pybytes()):
                    held.append(found)
                    if len(held) >= 2000:
                        yield pa.RecordBatch.from_pylist(held, _READ)
                        held = []
        yield pa.RecordBatch.from_pylist(held, _READ)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("content").mapInArrow(run, READ)
