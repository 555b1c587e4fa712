"""Binary journal segments: little-endian records with a CRC-32, read and written by Spark.

A record: int32 length of what follows; type byte (0 script, 1 invocation, 2 definition; bit 7: payloads are gzip, bit 6:
encrypted); int64 entry id; int64 time (.NET ticks of 100 ns since year 1 in the low 62 bits); for types 1 and 2 int32
action id; int32 length and payload; int32 length and exposed JSON; uint32 CRC-32 of all from the type byte on.

Segments are files journal_000001.bin, ... read through Spark's own binary reader, so any store will do; a segment is
one row, and its records are decoded where it lies.  Encrypted payloads are refused: no key is at hand.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {0: "SCRIPT", 1: "INVOCATION", 2: "DEFINE"}
COMPRESSED, ENCRYPTED, TYPE = 0x80, 0x40, 0x3F
TICKS = (1 << 62) - 1
EPOCH = datetime(1, 1, 1)
#: Bytes after which a writer begins a new segment.
SEGMENT = 4 << 20
FIELDS = "entry_id long, occurred_at timestamp_ntz, kind string, script string, action_id int, arguments string, define_text string, expose string"


class Damaged(ValueError):
    """A record's check sum or lengths are wrong."""


def encode(row: dict, compress: bool = False) -> bytes:
    kind = {v: k for k, v in KINDS.items()}[row["kind"]]
    text = row[("script", "arguments", "define_text")[kind]].encode()
    expose = (row.get("expose") or "").encode()
    if compress:
        text, expose = gzip.compress(text, mtime=0), gzip.compress(expose, mtime=0) if expose else b""
    ticks = (row["occurred_at"] - EPOCH) // timedelta(microseconds=1) * 10
    body = struct.pack("<Bqq", kind | (COMPRESSED if compress else 0), row["entry_id"], ticks)
    body += struct.pack("<i", row["action_id"]) if kind else b""
    body += struct.pack("<i", len(text)) + text + struct.pack("<i", len(expose)) + expose
    return struct.pack("<i", len(body) + 4) + body + struct.pack("<I", zlib.crc32(body))


def decode(data: bytes):
    """Rows of a segment.  A record that is cut off at the end is ignored (a crash while writing); damage raises."""
    at = 0
    while at + 4 <= len(data):
        (n,) = struct.unpack_from("<i", data, at)
        if n < 29 or n > len(data):
            raise Damaged(f"length {n} at {at}")
        if at + 4 + n > len(data):
            return
        body = data[at + 4 : at + n]
        if zlib.crc32(body) != struct.unpack_from("<I", data, at + n)[0]:
            raise Damaged(f"check sum at {at}")
        flags, entry_id, ticks = struct.unpack_from("<Bqq", body)
        kind, p, action = flags & TYPE, 17, None
        if flags & ENCRYPTED:
            raise Damaged("an encrypted payload")
        if kind:
            (action,) = struct.unpack_from("<i", body, p)
            p += 4
        parts = []
        for _ in range(2):
            (size,) = struct.unpack_from("<i", body, p)
            raw = body[p + 4 : p + 4 + size]
            parts.append((gzip.decompress(raw) if flags & COMPRESSED and raw else raw).decode())
            p += 4 + size
        row = {"entry_id": entry_id, "occurred_at": EPOCH + timedelta(microseconds=(ticks & TICKS) // 10), "kind": KINDS[kind], "script": None, "action_id": action, "arguments": None, "define_text": None, "expose": parts[1] or None}
        row[("script", "arguments", "define_text")[kind]] = parts[0]
        yield row
        at += 4 + n


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """All records of the segments in a folder."""
    return decode_segments(spark.read.format("binaryFile").option("pathGlobFilter", "journal_*.bin").load(path).select("content"))


def decode_segments(segments: DataFrame) -> DataFrame:
    kinds = [pa.int64(), pa.timestamp("us"), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
    names = ["entry_id", "occurred_at", "kind", "script", "action_id", "arguments", "define_text", "expose"]

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows = list(decode(content.as_py()))
                for i in range(0, len(rows), 10000):
                    part = rows[i : i + 10000]
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in part], k) for n, k in zip(names, kinds, strict=True)], names)

    return segments.select("content").mapInArrow(run, FIELDS)


def encode_segments(journal: DataFrame, segment_bytes: int = SEGMENT, compress: bool = False) -> DataFrame:
    """first_id, content: segments in ascending order of ids, each under segment_bytes (or of one record)."""
    columns = ["entry_id", "occurred_at", "kind", "script", "action_id", "arguments", "define_text", "expose"]

    def run(batches):
        first, held, size = None, [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["first_id", "content"])

        for b in batches:
            for row in b.to_pylist():
                record = encode(row, compress)
                if held and size + len(record) > segment_bytes:
                    yield made()
                    held, size = [], 0
                if not held:
                    first = row["entry_id"]
                held.append(record)
                size += len(record)
        if held:
            yield made()

    rows = journal.select(*columns).repartitionByRange("entry_id").sortWithinPartitions("entry_id")
    return rows.mapInArrow(run, "first_id long, content binary")


def seek_segments(segments: DataFrame, after: int) -> DataFrame:
    """Entries behind an id, from segments (first_id, content): only those from the last that begins at or before it are decoded."""
    start = segments.where(F.col("first_id") <= after + 1).agg(F.coalesce(F.max("first_id"), F.lit(0)).alias("start"))  # one row
    some = segments.join(F.broadcast(start), F.col("first_id") >= F.col("start")).select("content")
    return decode_segments(some).where(F.col("entry_id") > after)


def write_segments(journal: DataFrame, path: str, segment_bytes: int = SEGMENT, compress: bool = False) -> int:
    """Write segments as files of a folder, one after another, through Hadoop's file system; returns their number."""
    spark, n = journal.sparkSession, 0
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for row in encode_segments(journal, segment_bytes, compress).orderBy("first_id").toLocalIterator():  # one segment at a time
        n += 1
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{path}/journal_{n:06d}.bin"), True)
        out.write(bytearray(row["content"]))
        out.close()
    return n
