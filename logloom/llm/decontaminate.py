"""Benchmark decontamination with training suffix arrays.

Each task turns the documents that it reads into one array of word numbers (words that no benchmark item has become 0,
which no match can span) and sorts the suffixes that can begin a match.  Every suffix of every benchmark item is then
binary-searched in that array; the ranges found are all verbatim occurrences of its leading window.  Occurrences on one
diagonal of document and item are joined into matches.  Where an item repeats a window the longest match of the two is
found by a binary search on its length instead, over hashes of all their ranges of that length, so that no pairs of
places are listed.  Of several longest matches the first in the document is given, and its first place in the item.

A benchmark of at most BLOCK_BYTES goes to the tasks at once; a larger one in blocks of that size, each with a scan of the
documents of which only what was hit is written and joined to the documents at the end.

Defined results: null texts have no words; items of fewer words than a window are one window, items without words none;
rows with one item_id are one item (a match lies in one of its texts); a null item_id is the item ""; repeated documents
each get their row; empty tables give no hits; extra columns pass through unless they bear the name of an output column.
"""

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import LOWER_BYTES, Scratch, free_name, join_found, lean
from logloom.llm.neardup import between, mix, running

WINDOW = 10
#: Bytes of benchmark text that one pass sends to the tasks.
BLOCK_BYTES = 8 << 20
#: Words of documents in one suffix array.
ARRAY_WORDS = 1 << 19
#: Lower-cased; what is no word character becomes a space.
WORD_BYTES = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in LOWER_BYTES)
#: The same words as a pattern of Java's.
WORD_PATTERN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
OURS = ("n_words", "hits", "matches")


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class TestWindows:
    """The distinct windows of a block of items, as word numbers, and the items that hold each."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        places: dict[tuple[int, ...], dict[int, int]] = {}
        self.names, self.texts, self.repeating = [], [], set()
        for k, (item, text) in enumerate(items):
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            self.names.append(item)
            self.texts.append(np.array(ids, np.uint64))
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                at = places.setdefault(tuple(ids[i : i + n]), {})
                if k in at:
                    self.repeating.add(k)
                else:
                    at[k] = i
        self.windows = list(places)
        self.places = [list(p.items()) for p in places.values()]  # text number and its first place there
        self.longest = max(map(len, self.windows), default=0)
        self.shortest = min(map(len, self.windows), default=0)
        self.bits = max(1, (len(self.vocabulary) + 1).bit_length())
        self.per_key = max(1, 62 // self.bits)
        self.n_keys = -(-self.longest // self.per_key)


def pack_keys(ids: np.ndarray, starts: np.ndarray, n_keys: int, per_key: int, bits: int, most: int) -> list[np.ndarray]:
    """Integers that order suffixes as their first most words do; ids has most zeros at its end."""
    keys = []
    for j in range(n_keys):
        key = np.zeros(len(starts), np.int64)
        for t in range(per_key):
            key <<= bits
            if j * per_key + t < most:
                key |= ids[starts + (j * per_key + t)]
        keys.append(key)
    return keys


def search(keys: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
    """For each wanted key, how many sorted keys are less (right: or equal): all binary searches at once."""
    n = len(keys[0])
    low, high = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), n, np.int64)
    while (open_ := low < high).any():
        mid = np.minimum((low + high) >> 1, n - 1)
        before = np.full(len(low), right)
        for k, w in zip(reversed(keys), reversed(wanted), strict=True):
            at = k[mid]
            before = (at < w) | ((at == w) & before)
        low, high = np.where(open_ & before, mid + 1, low), np.where(open_ & ~before, mid, high)
    return low


def occurrences(ids: np.ndarray, test: TestWindows) -> list[tuple[np.ndarray, np.ndarray]]:
    """(window number, position) of each occurrence in ids."""
    padded = np.concatenate([ids, np.zeros(test.longest + 1, np.int64)])
    gap = np.where(padded == 0, np.arange(len(padded)), len(padded))
    room = np.minimum.accumulate(gap[::-1])[::-1] - np.arange(len(padded))
    starts = np.nonzero(room[: len(ids)] >= test.shortest)[0]
    if not len(starts):
        return []
    keys = pack_keys(padded, starts, test.n_keys, test.per_key, test.bits, test.longest)
    order = np.lexsort(keys[::-1])  # the suffix array
    suffixes, keys = starts[order], [k[order] for k in keys]
    found = []
    lengths = np.array([len(w) for w in test.windows])
    for n in np.unique(lengths):
        which = np.nonzero(lengths == n)[0]
        flat = np.array([(*test.windows[i], *repeat(0, test.longest + 1 - n)) for i in which], np.int64).ravel()
        wanted = pack_keys(flat, np.arange(len(which)) * (test.longest + 1), test.n_keys, test.per_key, test.bits, test.longest)
        masks = pack_keys(np.array([*repeat((1 << test.bits) - 1, n), *repeat(0, test.longest + 1 - n)], np.int64), np.zeros(1, np.int64), test.n_keys, test.per_key, test.bits, test.longest)
        cut = [k & m[0] for k, m in zip(keys, masks, strict=True)]
        low, high = search(cut, wanted, False), search(cut, wanted, True)
        size = high - low
        flat_at = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        found.append((np.repeat(which, size), suffixes[flat_at]))
    return found


def longest_common(doc: np.ndarray, item: np.ndarray, least: int) -> tuple[int, int, int]:
    """First place in doc and in item, and length, of their longest common range of word numbers; one of least words exists."""
    sums = [running(mix(x.astype(np.uint64) + np.uint64(1))) for x in (doc, item)]
    ranges = lambda k, n: between(sums[k], np.arange(len(sums[k]) - n), np.arange(n, len(sums[k])))
    low, high = least, min(len(doc), len(item)) + 1
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if np.isin(ranges(0, mid), ranges(1, mid)).any() else (low, mid)
    mine, theirs = ranges(0, low), ranges(1, low)
    at = int(np.nonzero(np.isin(mine, theirs))[0][0])
    return at, int(np.nonzero(theirs == mine[at])[0][0]), low


def judge(texts: list[bytes | None], test: TestWindows):
    """For each text: its number of words, its hit ranges, and its longest match with each item."""
    get, parts, sizes = test.vocabulary.get, [], []
    for t in texts:
        w = words(t)
        parts.append(np.fromiter(map(get, w, repeat(0)), np.int64, len(w)))
        parts.append(np.zeros(1, np.int64))
        sizes.append(len(w))
    ids = np.concatenate(parts)
    begin = np.concatenate([[0], np.cumsum(np.array(sizes) + 1)])
    hits, matches = [[] for _ in texts], [{} for _ in texts]
    mark, lists = np.zeros(len(ids) + 1, np.int64), test.places
    rows = []
    for which, at in occurrences(ids, test) if test.windows else []:
        size = np.array([len(test.windows[i]) for i in range(len(test.windows))])[which]
        np.add.at(mark, at, 1)
        np.add.at(mark, at + size, -1)
        rows.append((which, at, size))
    if rows and sum(len(r[0]) for r in rows):
        which, at, size = (np.concatenate(c) for c in zip(*rows, strict=True))
        order = np.argsort(at, kind="stable")
        which, at, size = which[order], at[order], size[order]
        doc = np.searchsorted(begin, at, "right") - 1
        runs: dict[tuple[int, int], tuple[int, int, int]] = {}
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for w, p, n, d in zip(which.tolist(), at.tolist(), size.tolist(), doc.tolist(), strict=True):
            for k, q in lists[w]:
                start, place, length = runs.get((d, k), (-1, -1, 0))
                if start >= 0 and p - start == q - place and p <= start + length:
                    length = max(length, p + n - start)
                else:
                    start, place, length = p, q, n
                runs[d, k] = start, place, length
                if length > best.get((d, k), (0, 0, 0))[2]:
                    best[d, k] = start - int(begin[d]), place, length
        for (d, k), m in best.items():
            if k in test.repeating:
                m = longest_common(ids[begin[d] : begin[d + 1] - 1], test.texts[k], m[2])
            old = matches[d].get(test.names[k])
            if old is None or (-m[2], m[0]) < (-old[2], old[0]):
                matches[d][test.names[k]] = m
        on = np.concatenate([[0], (np.cumsum(mark)[:-1] > 0).astype(np.int8), [0]])
        turns = np.nonzero(np.diff(on))[0].reshape(-1, 2)
        for (a, z), d in zip(turns.tolist(), (np.searchsorted(begin, turns[:, 0], "right") - 1).tolist(), strict=True):
            hits[d].append((a - int(begin[d]), z - a))
    return sizes, hits, [[(item, *m) for item, m in sorted(x.items())] for x in matches]


_HITS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
_MATCHES = pa.list_(pa.struct([("item_id", pa.string()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("length", pa.int64())]))
_TYPES = "n_words long, hits array<struct<start:bigint,length:bigint>>, matches array<struct<item_id:string,doc_start:bigint,item_start:bigint,length:bigint>>"


def _ranges(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, length) as disjoint ranges."""
    out: list[tuple[int, int]] = []
    for a, n in sorted(hits):
        if out and a <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], a + n - out[-1][0]))
        else:
            out.append((a, n))
    return out


def _as_dicts(rows, kind):
    names = [f.name for f in kind.value_type]
    return pa.array([[dict(zip(names, x, strict=True)) for x in r] for r in rows], kind)


def find_overlaps(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, hits (disjoint ranges of hit words) and matches (the longest verbatim match with each item)."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    out = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in OURS])
    send = lambda mine: spark.sparkContext.broadcast([(r["item"], r["text"].encode()) for r in mine.collect()])
    if blocks == 1:
        return _pass(out, send(items), text_col, window)
    scratch, tk = Scratch(spark), free_name(out, "_tk")
    own = out.withColumn(tk, F.unhex(F.substring(F.sha2(F.coalesce(F.encode(text_col, "UTF-8"), F.lit(b"")), 256), 1, 32)))
    found = None
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        hit = _pass(own.select(text_col, tk), send(mine), text_col, window).where(F.size("hits") > 0)
        hit = scratch.table(hit.select(tk, "hits", "matches").dropDuplicates([tk]), f"block{block}")
        found = hit if found is None else found.union(hit)
    found = found.groupBy(tk).agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"))

    def tidy(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _as_dicts([_ranges([(h["start"], h["length"]) for h in r]) for r in b.column(1).to_pylist()], _HITS), b.column(2)], [tk, "hits", "matches"])

    kinds = _TYPES.partition(", ")[2]
    found = scratch.table(found.mapInArrow(lean(tidy), f"`{tk}` binary, {kinds}"), "found")
    joined = join_found(own, found, [tk])
    n_words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD_PATTERN)).cast("long")
    none = lambda c: F.coalesce(c, F.array().cast(found.schema[c].dataType)).alias(c)
    return joined.select(*out.columns, n_words.alias("n_words"), none("hits"), none("matches"))


def _pass(docs: DataFrame, sent, text_col: str, window: int) -> DataFrame:
    kept = docs.columns
    at = kept.index(text_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), _TYPES])

    def run(batches):
        test = None
        for whole in batches:
            test = test or TestWindows(sent.value, window)
            begin = 0
            while begin < whole.num_rows:
                texts, size, end = [], 0, begin
                while end < whole.num_rows and (end == begin or size < ARRAY_WORDS * 6):
                    t = whole.column(at)[end].as_py()
                    texts.append(t.encode() if t else None)
                    size += len(t or "")
                    end += 1
                b = whole.slice(begin, end - begin)
                n_words, hits, matches = judge(texts, test)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n_words, pa.int64()), _as_dicts(hits, _HITS), _as_dicts(matches, _MATCHES)], [*kept, *OURS])
                begin = end

    return docs.mapInArrow(lean(run), schema)


def n_hit(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda s, h: s + h["length"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, with their own columns only, that no window of an item occurs in."""
    found = find_overlaps(docs, benchmark, **options)
    return found.where(F.size("hits") == 0).select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in OURS])
