"""Media columns: signature sniffing with Aho-Corasick, format validators, type correction and carving.

One automaton finds every magic number in a value in one pass.  At each hit the validator of that format walks the
structure and confirms lengths (and PNG check sums); only confirmed spans count.  The span at 0 gives the true type, which
replaces a wrong declared one; further spans that lie in no confirmed one are embedded media and can be carved out.

Defined results: null bytes have no type and no span; equal bytes have equal results; extra columns are kept (those named
like an output are replaced); spans are ordered by start.
"""

import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Magic bytes and the format whose validator they call.
MAGIC = {
    b"RIFF": "riff", b"\x89PNG\r\n\x1a\n": "png", b"GIF87a": "gif", b"GIF89a": "gif", b"\xff\xd8\xff": "jpeg", b"BM": "bmp", b".snd": "au", b"P5": "pgm",
}
UNKNOWN = "application/octet-stream"


def _riff(d: bytes, at: int):
    if at + 12 > len(d):
        return None
    size, form = struct.unpack_from("<I4s", d, at + 4)
    end = at + 8 + size
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp"}.get(form)
    if not kind or end > len(d) or size < 4:
        return None
    p, body, fmt = at + 12, None, False
    while p + 8 <= end:
        name, n = struct.unpack_from("<4sI", d, p)
        if p + 8 + n > end:
            return None
        fmt |= name == b"fmt " and n >= 16
        if name in (b"data", b"VP8 ", b"VP8L", b"VP8X") and body is None:
            body = (p + 8, p + 8 + n)
        p += 8 + n + n % 2
    if body is None or (kind == "audio/wav" and not fmt) or p not in (end, end + 1):
        return None
    return kind, end, body


def _png(d: bytes, at: int):
    p, body = at + 8, None
    while p + 12 <= len(d):
        n, name = struct.unpack_from(">I4s", d, p)
        if p + 12 + n > len(d) or zlib.crc32(d[p + 4 : p + 8 + n]) != struct.unpack_from(">I", d, p + 8 + n)[0]:
            return None
        if p == at + 8 and (name != b"IHDR" or n != 13):
            return None
        body = body or ((p + 8, p + 8 + n) if name == b"IDAT" else None)
        p += 12 + n
        if name == b"IEND":
            return ("image/png", p, body) if body else None
    return None


def _gif(d: bytes, at: int):
    if at + 13 > len(d):
        return None
    p = at + 13 + (3 * 2 ** ((d[at + 10] & 7) + 1) if d[at + 10] & 128 else 0)
    body = None
    while p < len(d):
        mark = d[p]
        if mark == 0x3B:
            return ("image/gif", p + 1, body) if body else None
        if mark == 0x21:
            p += 2
        elif mark == 0x2C and p + 10 < len(d):
            p += 10 + (3 * 2 ** ((d[p + 9] & 7) + 1) if d[p + 9] & 128 else 0) + 1
            body = body or (p, p)
        else:
            return None
        while p < len(d) and d[p]:
            p += 1 + d[p]
        p += 1
    return None


def _jpeg(d: bytes, at: int):
    p, body = at + 2, None
    while p + 4 <= len(d):
        if d[p] != 0xFF:
            return None
        mark, n = d[p + 1], struct.unpack_from(">H", d, p + 2)[0]
        if mark in (0xD8, 0xD9) or not 0xC0 <= mark <= 0xFE or n < 2 or p + 2 + n > len(d):
            return None
        p += 2 + n
        if mark == 0xDA:
            end = d.find(b"\xff\xd9", p)
            return ("image/jpeg", end + 2, (p, end)) if end >= 0 else None
    return body


def _bmp(d: bytes, at: int):
    if at + 54 > len(d):
        return None
    size, _, start, head, w, h, planes, bits = struct.unpack_from("<IIIIiiHH", d, at + 2)
    rows = ((w * bits + 31) // 32) * 4 * abs(h)
    ok = planes == 1 and bits in (1, 4, 8, 16, 24, 32) and head >= 40 and w > 0 and h and start >= 14 + head and start + rows <= size and at + size <= len(d)
    return ("image/bmp", at + size, (at + start, at + start + rows)) if ok else None


def _au(d: bytes, at: int):
    if at + 24 > len(d):
        return None
    start, n, code, rate, channels = struct.unpack_from(">IIIII", d, at + 4)
    ok = start >= 24 and 1 <= code <= 27 and 0 < rate <= 1 << 20 and 0 < channels <= 64 and n > 0 and at + start + n <= len(d)
    return ("audio/basic", at + start + n, (at + start, at + start + n)) if ok else None


def _pgm(d: bytes, at: int):
    parts = d[at : at + 64].split(b"\n", 3)
    if len(parts) < 4 or parts[0] != b"P5" or parts[2] != b"255":
        return None
    size = parts[1].split(b" ")
    if len(size) != 2 or not all(x.isdigit() and len(x) < 12 for x in size) or not int(size[0]) * int(size[1]):
        return None
    start = at + sum(map(len, parts[:3])) + 3
    end = start + int(size[0]) * int(size[1])
    return ("image/x-portable-graymap", end, (start, end)) if end <= len(d) else None


VALIDATORS = {"riff": _riff, "png": _png, "gif": _gif, "jpeg": _jpeg, "bmp": _bmp, "au": _au, "pgm": _pgm}


def automaton():
    """Aho-Corasick over the magic bytes, each as one character."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, name in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic), name))
    found.make_automaton()
    return found


def find_media(data: bytes, words) -> list[dict]:
    """Confirmed spans, none within another: type, start, end, and the body (samples) from body_start to body_end."""
    spans, free = [], 0
    for last, (n, name) in words.iter(data.decode("latin-1")):
        at = last - n + 1
        if at >= free and (got := VALIDATORS[name](data, at)):
            kind, end, body = got
            spans.append({"type": kind, "start": at, "end": end, "body_start": body[0], "body_end": body[1]})
            free = end
    return spans


_SPAN = pa.struct([("type", pa.string())] + [(x, pa.int64()) for x in ("start", "end", "body_start", "body_end")])
_SPANS = "array<struct<type:string,start:bigint,end:bigint,body_start:bigint,body_end:bigint>>"


def sniff(media: DataFrame, bytes_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """Adds spans, true_type and corrected (whether the declared type was wrong)."""

    def spans(column: pa.Array) -> pa.Array:
        words = automaton()
        return pa.array((None if x is None else find_media(x, words) for x in (v.as_py() for v in column)), pa.list_(_SPAN))

    keep = [c for c in media.columns if c.lower() not in ("spans", "true_type", "corrected")]
    found = F.arrow_udf(spans, _SPANS)
    first = F.col("spans")[0]
    kind = F.when((F.size("spans") > 0) & (first["start"] == 0), first["type"]).when(F.col(bytes_col).isNotNull(), F.lit(UNKNOWN))
    with_spans = media.select(*[F.col(f"`{c}`") for c in keep]).withColumn("spans", found(F.col(bytes_col)))
    return with_spans.withColumn("true_type", kind).withColumn("corrected", ~F.col(declared_col).eqNullSafe(F.col("true_type")))


def carve(sniffed: DataFrame, bytes_col: str = "media") -> DataFrame:
    """One row for each confirmed span that does not begin the value, with its bytes in column carved."""
    keep = [F.col(f"`{c}`") for c in sniffed.columns if c not in ("spans", "carved", "span", bytes_col)]
    spans = F.filter("spans", lambda s: s["start"] > 0)
    return sniffed.select(*keep, bytes_col, F.explode(spans).alias("span")).select(*keep, "span", piece(F.col(bytes_col), F.col("span.start"), F.col("span.end")).alias("carved"))


def piece(data: Column, start: Column, end: Column) -> Column:
    return F.substring(data, (start + 1).cast("int"), (end - start).cast("int"))


def store_samples(rows: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Adds media and declared: the payload as 8-bit samples of a WAV, AU or PGM file (by its length), all declared as octets."""

    def store(column: pa.Array) -> pa.Array:
        return pa.array((None if x is None else contain(x) for x in (v.as_py() for v in column)), pa.binary())

    return rows.withColumn("media", F.arrow_udf(store, "binary")(F.col(payload_col))).withColumn("declared", F.lit(UNKNOWN))


def contain(payload: bytes) -> bytes:
    n = len(payload)
    match n // 64 % 3:
        case 0:
            return b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", n) + payload
        case 1:
            return b".snd" + struct.pack(">IIIII", 24, n, 2, 8000, 1) + payload
    return b"P5\n64 %d\n255\n" % (n // 64) + payload
