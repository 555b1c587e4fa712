"""Packing, chat formatting, media columns and WARC: exact round trips, with nulls, repeats, empty tables and odd texts."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logloom.llm import chat, media, packing, queries, warc
from logloom.llm.queries import HARD_CONVERSATION, digest_examples

TEXTS = [None, "", "a", "Hello world. " * 700, "x" * 5000, "ünï " * 300, "<|endoftext|> in a text", "same", "same", "word " * 1023, "z " * 300]


def paths():
    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("copies", [1, 60])
def test_packing_places_each_token_once(spark, copies):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS * copies)] + [(None, "no id", "y")]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(2), "doc_id", "text", *paths()).collect()
    slow = Tokenizer.from_file(paths()[0])
    by_doc, by_seq = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t, _ in rows:
        want = np.array(slow.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert b"".join(bytes(p.ids) for p in pieces) == want and {p.doc_tokens for p in pieces} == {len(want) // 4}
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
    padding = 0
    for s in by_seq.values():
        s = sorted(s, key=lambda r: r.offset)
        size = sum(r.length for r in s)
        assert [r.offset for r in s] == [sum(q.length for q in s[:k]) for k in range(len(s))] and size <= s[0].window <= 1024
        padding += 0 if size & (size - 1) == 0 else 1024 - size
    assert padding <= 2 * 1024
    assert len({s[0].step_group for s in by_seq.values()}) >= 1


def test_fast_ids_equal_the_library(spark):
    fast, slow = packing.tokenizer(*paths()), packing.tokenizer(paths()[0])
    odd = [" \n\t  x", "don't we'LL", "1234567 ½", "漢字かな交じり", "\u2028\u00a0 a", "🙂👍🏽 é́", "\x00\x01", "a" * 9000, " " * 9000 + "b", "_" * 50, "<|endoftext|>"]
    for t in odd + [t for t in TEXTS if t]:
        assert (fast(t) == slow(t)).all() and len(fast(t)) == len(slow(t)), t[:20]


def test_step_groups_are_even():
    w = [1024] * 500 + [512] * 40 + [128] * 77
    g = packing.step_groups(w)
    sums = [sum(x for x, y in zip(w, g, strict=True) if y == k) for k in set(g)]
    assert max(sums) - min(sums) <= 1024


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:\\c#", ""]), st.text(alphabet="\\#</turn>: \nac", max_size=25)), max_size=6))
def test_template_is_reversible(turns):
    examples = list(chat.expand(turns))
    if turns:
        assert chat.parse(examples[-1][0]) == turns
    replies = [(a, z, t) for t, a, z in examples if a >= 0]
    assert [chat.unescape(t[a:z]) for a, z, t in replies] == [t for r, t in turns if r == "assistant"]
    for k, (_, _, text) in enumerate(replies):
        assert sum(r == "assistant" for r, _ in chat.parse(text)) == k + 1


def test_chat_digests(spark):
    rows = [*HARD_CONVERSATION, (1, 1, "assistant", "b"), (1, 0, "user", None), (1, 2, None, "tail"), (2, 0, "user", "only"), (None, 5, "assistant", "q"), (2, 0, "user", "only")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, example string")
    got = {r.conv_id: r for r in digest_examples(chat.format_conversations(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\n\nassistant\nb\n\ntail\n") and got[1].loss_sha256 == sha("b")
    assert got[2].n_turns == 2 and got[2].loss_chars == 0 and got[None].loss_chars == 1
    assert got[-7].loss_sha256 == sha(HARD_CONVERSATION[1][3]) and got[-7].loss_chars == 26
    assert chat.format_conversations(df.limit(0)).count() == 0


def png() -> bytes:
    def chunk(name, data):
        return len(data).to_bytes(4, "big") + name + data + zlib.crc32(name + data).to_bytes(4, "big")

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes([0, 0, 0, 1, 0, 0, 0, 1, 8, 0, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_sniffing_corrects_and_carves(spark):
    gif = b"GIF89a\x01\x00\x01\x00\x00\x00\x00" + b",\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    jpeg = b"\xff\xd8\xff\xe0\x00\x10JFIF\x00" + bytes(9) + b"\xff\xda\x00\x04ab" + b"data" + b"\xff\xd9"
    bad_png = png()[:-5] + b"x" + png()[-4:]
    rows = [
        (0, png(), "image/png"), (1, media.contain(b"a" * 64), "image/png"), (2, b"xx" + png() + b"BM" + gif + jpeg, "text/plain"), (3, bad_png, "image/png"),
        (4, None, None), (5, b"", "x"), (6, media.contain(b"b" * 128), "audio/wav"), (7, b"RIFF" + b"\xff" * 20, "audio/wav"), (8, media.contain(b"P5" * 96), None),
    ]
    out = media.sniff(spark.createDataFrame([(*r, "c") for r in rows], "id int, media binary, declared string, carved string"))
    got = {r.id: r for r in out.collect()}
    assert [got[i].true_type for i in range(9)] == ["image/png", "audio/basic", media.UNKNOWN, media.UNKNOWN, None, media.UNKNOWN, "image/x-portable-graymap", media.UNKNOWN, "audio/wav"]
    assert [got[i].corrected for i in range(9)] == [False, True, True, True, False, True, True, True, True]
    assert [(r.id, bytes(r.carved)) for r in media.carve(out).orderBy("span.start").collect()] == [(2, png()), (2, gif), (2, jpeg)]
    for n in (64, 128, 192, 6400):
        data = bytes(i * 7 % 256 for i in range(n))
        (span,) = media.find_media(media.contain(data), media.automaton())[:1]
        assert media.contain(data)[span["body_start"] : span["body_end"]] == data


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é\r\n\r\nWARC/1.1\r\n", "x" * 100_000, "<p>a</p>"]
    rows = [(i, f"http://e.example/{i} ü\r\n" if i % 2 else None, h, b"p") for i, h in enumerate(html)] + [(5, None, html[5], b"p"), (None, "u", "<p>a</p>", b"p"), (None, "u", "lonely", b"p")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, payload binary")
    mono = warc.write_archives(warc.elect(df).coalesce(2), archive_bytes=50_000)
    archives = warc.normalise(mono).collect()
    for a in archives:
        for e in a["index"]:
            (rec,) = warc.split_records([zlib.decompress(bytes(a.content[e.offset : e.offset + e.length]), 31)])
            assert f"WARC-Type: {e.type}".encode() in rec
        assert sum(e.length for e in a["index"]) == len(a.content)
    assert len(archives) > 1
    normal = warc.normalise(mono)
    index = warc.sidecar(normal)
    assert index.columns == ["name", "offset", "length", "record_id", "type", "uri"] and index.count() == len(rows)
    got = sorted(((r.id, r.type, r.refers_to, r.payload_bytes, r.digest) for r in warc.read_records(normal, index).collect()), key=str)
    assert [r.type for r in warc.read_records(normal, index.where("record_id = '<urn:page:3>'")).collect()] == ["response"]
    last = {h or "": max(i for i, g in enumerate(html) if (g or "") == (h or "")) for h in html}
    want = []
    for i, _, h, _ in rows:
        raw = (h or "").encode()
        to = last.get(h or "")
        kind = "response" if to is None or i == to else "revisit"
        want.append((None if i is None else str(i), kind, str(to) if kind == "revisit" else None, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode()))
    assert got == sorted(want, key=str)
    none = warc.normalise(warc.write_archives(warc.elect(df.limit(0))))
    assert warc.read_records(none, warc.sidecar(none)).count() == 0
    with pytest.raises(ValueError):
        list(warc.split_records([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"]))
    assert F is not None


def test_op10_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{d}/pages.parquet").collect()]
    last = {}
    for i, raw in rows:
        last[raw] = max(i, last.get(raw, i))
    want = sorted((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if last[raw] == i else "revisit", None if last[raw] == i else last[raw]) for i, raw in rows)
    got = queries.op10_warc(spark, d).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect())) == want


def test_op5_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.op5_media(spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    by_text = {}
    for r in got:
        raw = rows[r.doc_id]
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = media.contain(padded)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        spans = media.find_media(stored, media.automaton())
        kinds = ";".join(f"{s['type']}@{s['start']}+{s['end'] - s['start']}" for s in spans)
        assert spans[0]["start"] == 0 and stored[spans[0]["body_start"] : spans[0]["body_end"]] == padded and kinds in r.feature
        assert by_text.setdefault(raw, r.feature) == r.feature


def test_op4_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    turns = {}
    for r in spark.read.parquet(f"{d}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    turns[-7] = [(r, t) for _, _, r, t in HARD_CONVERSATION]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for c, rows in turns.items():
        loss = "".join(t for r, t in rows if r == "assistant")
        want[c] = (len(rows), sha("".join(f"{r}\n{t}\n" for r, t in rows)), len(loss), sha(loss), sum(len(text) for text, _, _ in chat.expand(rows)))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in queries.op4_chat(spark, d).collect()}
    assert got == want


def test_op3_query_against_the_library(spark):
    d = "/root/testdata/sf0.001"
    slow = Tokenizer.from_file(paths()[0])
    rows = {r.doc_id: slow.encode(r.text or "", add_special_tokens=False).ids + [0] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    by_doc, by_seq = {}, {}
    for r in queries.op3_pack(spark, d).collect():
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(rows)
    for i, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            ids = np.array(rows[i][at : at + p.length], "<u4").tobytes()
            assert p.start == at and p.doc_tokens == len(rows[i]) and p.ids_crc32 == zlib.crc32(ids)
            at += p.length
        assert at == len(rows[i])
    for s in by_seq.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == [sum(q.length for q in s[:k]) for k in range(len(s))] and sum(p.length for p in s) <= 1024
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", *paths()).count() == 0


def test_media_of_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([(1, b"a" * 64, b"old", "text/x", 7)], "id int, payload binary, media binary, declared string, spans int")
    (r,) = media.sniff(media.store_samples(df)).collect()
    assert bytes(r.media) == media.contain(b"a" * 64) and r.id == 1
    assert media.sniff(media.store_samples(df.limit(0))).count() == 0
