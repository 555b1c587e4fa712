"""WARC archives: writer, monolithic gzip normaliser with a sidecar offset index, and reader.

write_archives() puts rows into archives that are one gzip stream each (the monolithic form).  normalise() inflates such a
stream once, piece by piece, and rewrites every record as a gzip member of its own; sidecar() is the table of offsets and
lengths, a row for each record, by which any record can be read alone.  read_records() reads by it.

Archives are rows (name, content) of a Spark table: they go wherever Spark can write, never to an executor's own disk.
An archive is closed once it holds archive_bytes of records, which bounds the memory of writer, normaliser and reader.

Defined results: null html is an empty payload; null or odd urls are percent-escaped; a row without id is a revisit if its
payload has a response with an id, else a response; repeated rows with the winning id are all responses; an empty table
gives no archive.  Extra columns are ignored.
"""

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import Scratch, join_found, lean

#: Uncompressed bytes after which the writer closes an archive.
ARCHIVE_BYTES = 16 << 20
#: Bytes that the normaliser inflates at once.
STEP = 1 << 18
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def elect(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """id, url, payload (binary), refers_to: the largest id of those with an equal payload of least bytes or more."""
    rows = pages.select(
        F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("order"), F.col(url_col).alias("url"),
        F.coalesce(F.encode(html_col, "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    winners = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.max("order").alias("winner"), F.count("*").alias("n"))
    winners = Scratch(pages.sparkSession).table(winners.where("n > 1").select("digest", "winner"), "winners")  # a payload that is alone needs none
    joined = join_found(rows, winners, ["digest"])
    revisit = F.when(~F.col("order").eqNullSafe(F.col("winner")), F.col("winner").cast("string"))
    return joined.select("id", "url", "payload", revisit.alias("refers_to"))


def _record(ident: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    uri = re.sub(rb"[\x00-\x20\x7f-\xff]", lambda m: b"%%%02X" % m[0][0], (url or "about:blank").encode()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    kind = "revisit" if refers_to is not None else "response"
    more = f"WARC-Profile: {_PROFILE}\r\nWARC-Refers-To: <urn:page:{refers_to}>\r\n" if refers_to is not None else ""
    head = (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{'' if ident is None else ident}>\r\nWARC-Target-URI: {uri}\r\n"
        f"WARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:{digest}\r\n{more}"
        f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block + b"\r\n\r\n"


def write_archives(rows: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """rows as elect() makes them -> name, content: archives that are one gzip stream each."""

    def write(batches):
        from pyspark import TaskContext

        task, n, size, out, stream = TaskContext.get().partitionId(), 0, 0, [], None
        for b in batches:
            for r in b.to_pylist():
                record = _record(r["id"], r["url"], r["payload"], r["refers_to"])
                stream = stream or zlib.compressobj(6, zlib.DEFLATED, 31)
                out.append(stream.compress(record))
                size += len(record)
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_pydict({"name": [f"{task:06d}-{n:06d}.warc.gz"], "content": [b"".join([*out, stream.flush()])]})
                    n, size, out, stream = n + 1, 0, [], None
        if stream:
            yield pa.RecordBatch.from_pydict({"name": [f"{task:06d}-{n:06d}.warc.gz"], "content": [b"".join([*out, stream.flush()])]})

    return rows.select("id", "url", "payload", "refers_to").mapInArrow(lean(write), "name string, content binary")


def inflate(content: bytes):
    """Pieces of what one gzip stream, or several members in a row, hold."""
    stream, view = zlib.decompressobj(31), memoryview(content)
    for i in range(0, len(view), STEP):
        piece = view[i : i + STEP]
        while len(piece):
            yield stream.decompress(piece)
            piece = stream.unused_data
            if stream.eof:
                stream = zlib.decompressobj(31)


def split_records(pieces):
    """Whole records from pieces of a stream; raises ValueError if it ends within a record or is no WARC."""
    held = bytearray()
    need = 0
    for piece in pieces:
        held += piece
        while len(held) >= max(need, 1):
            end = held.find(b"\r\n\r\n")
            if end < 0:
                break
            length = re.search(rb"(?i)\r\nContent-Length:\s*(\d+)", bytes(held[:end]))
            if not held.startswith(b"WARC/") or not length:
                raise ValueError("not a WARC record")
            need = end + 8 + int(length[1])
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("the archive ends within a record")


def _headers(record: bytes) -> dict[str, str]:
    lines = record[: record.index(b"\r\n\r\n")].decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


_INDEX = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string())]))


def normalise(archives: DataFrame) -> DataFrame:
    """name, content -> name, content with one gzip member for each record, index: the sidecar."""

    def rewrite(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out, at, index = [], 0, []
                for record in split_records(inflate(content.as_py())):
                    member = zlib.compressobj(6, zlib.DEFLATED, 31)
                    packed = member.compress(record) + member.flush()
                    h = _headers(record)
                    index.append({"offset": at, "length": len(packed), "record_id": h.get("warc-record-id"), "type": h.get("warc-type"), "uri": h.get("warc-target-uri")})
                    out.append(packed)
                    at += len(packed)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(out)], pa.binary()), pa.array([index], _INDEX)], ["name", "content", "index"])

    return archives.select("name", "content").mapInArrow(lean(rewrite), "name string, content binary, index array<struct<offset:bigint,length:bigint,record_id:string,type:string,uri:string>>")


def sidecar(normalised: DataFrame) -> DataFrame:
    """The offset index: name, offset, length, record_id, type, uri; a row for each record."""
    return normalised.select("name", F.explode("index").alias("e")).select("name", "e.*")


def read_records(archives: DataFrame, index: DataFrame) -> DataFrame:
    """Normalised archives (name, content) and their sidecar, or a part of it -> id, uri, type, refers_to, payload (null for a
    revisit), payload_bytes, digest: each record of the index, read by its offset.  An archive's index is as bounded as it is."""
    entries = index.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "record_id"))).alias("index"))
    archives = archives.select("name", "content").join(entries, "name")

    def read(batches):
        for b in batches:
            for content, index in zip(b.column(0), b.column(1), strict=True):
                data, rows = content.as_py(), []
                for e in index.as_py():
                    (record,) = split_records(inflate(data[e["offset"] : e["offset"] + e["length"]]))
                    h = _headers(record)
                    block = record[record.index(b"\r\n\r\n") + 4 : -4]
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"(?i)\r\nContent-Length:\s*(\d+)", http)[1])
                    digest = h["warc-payload-digest"].removeprefix("sha1:")
                    if h["warc-type"] == "response":
                        if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"damaged payload in {e['record_id']}")
                    refers = h.get("warc-refers-to")
                    name = lambda x: x and (x.removeprefix("<urn:page:").removesuffix(">") or None)
                    rows.append((name(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], name(refers), payload if h["warc-type"] == "response" else None, size, digest))
                    if len(rows) == 500:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    def batch(rows):
        kinds = [pa.string()] * 4 + [pa.binary(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "uri", "type", "refers_to", "payload", "payload_bytes", "digest"])

    return archives.select("content", "index").mapInArrow(lean(read), "id string, uri string, type string, refers_to string, payload binary, payload_bytes long, digest string")
