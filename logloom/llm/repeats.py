"""Removal of byte strings that occur twice, with suffix arrays built by linear grouping.

A string of LENGTH bytes that also starts elsewhere goes, in every place.  The text is never sorted as a whole:

1. Every window of LENGTH bytes names an anchor: the least hash of the core strings in it (winnowing), which only its
   content decides, so equal windows name equal anchors at equal offsets.  A run is the windows of one place with one anchor.
   Runs whose core occurs once in the corpus hold no repeat.  Runs that are equal as a whole are one class; a class of two
   or more is a repeat.
2. What is left, the ends of repeats, is cut into blocks of BLOCK window starts.  All windows of a block share all but
   BLOCK - 1 bytes on either side, so a block is at most 2 * BLOCK - 1 symbols: left bytes, one symbol for the shared
   part, right bytes.  Blocks with a shared part that occurs once are dropped.
3. The blocks of a task make one string, whose suffix array suffix_array() builds: groups of suffixes with one Lyndon
   prefix, taken in descending order, push the suffixes that their previous-smaller pointers name into new groups; then
   each group's order is emitted in one ascending pass.  Neighbours that agree in BLOCK symbols are equal windows.

Groups of more than SPLIT different blocks are not given to one task: their windows are counted one by one, summed before
they move.

Passages of WORDS words (runs of other bytes than white space, A-Z lower-cased) that another document holds too are
reported beside, not removed: the first step with words for bytes; at the ends of passages the hashes of single windows are
compared, core by core.

Texts move only where a filter of bounded size says that something was found for them; the others stay where they are read.

Defined results: null texts are empty; texts shorter than LENGTH lose nothing; repeated rows are repeats of each other, and
other documents to each other; rows with null or equal ids are told apart by their texts; an empty table gives no rows;
extra columns pass through unless they bear an output's name.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import LOWER_BYTES, Scratch, free_name, lean, may_be_in
from logloom.llm.neardup import _sliced, between, byte_values, mix, powers, range_hashes, running

LENGTH, SPREAD, BLOCK, SPLIT = 400, 192, 16, 4096
#: Words of a passage, and cores in one.
WORDS, WORD_SPREAD = 50, 40
#: Symbols hashed at once; positions in them fit the low bits of a key.
CHUNK_BITS = 20
#: Symbols of one suffix array.
STRING = 1 << 17
OURS = ("spans", "kept", "passages")
#: A-Z lower-cased, white space as a space.
_SPACED = bytes(32 if 9 <= b <= 13 else b for b in LOWER_BYTES)


def suffix_array(s: list[int]) -> list[int]:
    """Starts of the suffixes of s in ascending order; s ends with its one least symbol."""
    n = len(s)
    members: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        members.setdefault(c, []).append(i)
    order = sorted(members)
    lists = [members[c] for c in order]  # by group number; may hold suffixes that have left
    number = {c: g for g, c in enumerate(order)}
    group = [number[c] for c in s]
    below = list(range(-1, len(lists) - 1))  # linked list of groups
    above = [*range(1, len(lists)), -1]
    left = list(range(-1, n - 1))  # a suffix at or before i - 1 that may still be untaken
    taken = bytearray(n)
    previous = [-1] * n
    g = len(lists) - 1
    while g >= 0:
        now = lists[g] = [i for i in lists[g] if group[i] == g]
        for i in now:
            taken[i] = 1
        pushed: dict[int, int] = {}
        for i in now:
            j = i - 1
            if j >= 0 and taken[j]:
                while j >= 0 and taken[j]:
                    j = left[j]
                k = i - 1
                while k >= 0 and k != j and taken[k]:  # halve the way for the next search
                    left[k], k = j, left[k]
            previous[i] = j
            if j >= 0:
                pushed[j] = pushed.get(j, 0) + 1
        if pushed:
            split: dict[tuple[int, int], list[int]] = {}
            for j, times in pushed.items():
                split.setdefault((group[j], times), []).append(j)
            for old, times in sorted(split, key=lambda x: -x[1]):
                new, some = len(lists), split[old, times]
                lists.append(some)
                for j in some:
                    group[j] = new
                nxt = above[old]
                below.append(old)
                above.append(nxt)
                above[old] = new
                below[nxt] = new
        g = below[g]
    # Groups in ascending order give each its first place.
    places, at = [0] * len(lists), 0
    g = 0
    while g != -1:
        places[g] = at
        at += sum(1 for i in lists[g] if group[i] == g)
        g = above[g]
    out, placed = [-1] * n, bytearray(n)
    out[0], placed[n - 1] = n - 1, 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[places[g]] = j
            places[g] += 1
            placed[j] = 1
            j = previous[j]
    return out


def repeated_windows(blocks: list[tuple[int, bytes, bytes]], block: int = BLOCK) -> list[list[int]]:
    """blocks: (number of the shared part, left bytes, right bytes).  For each, which of its windows (by number of left
    bytes that they take) are equal to a window of another."""
    s, at = [], []
    for part, left, right in blocks:
        at.append(len(s))
        s += [c + 2 for c in left]
        s.append(258 + part)
        s += [c + 2 for c in right]
        s.append(1)
    s.append(0)
    order = np.array(suffix_array(s), np.int64)
    symbols = np.concatenate([np.array(s, np.int64), -np.arange(1, block + 1)])
    same = np.ones(len(order) - 1, bool)
    for t in range(block):
        column = symbols[order + t]
        same &= column[1:] == column[:-1]
    twice = np.zeros(len(s), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    # A window takes the last k of the left bytes, the shared part and block - 1 - k right bytes.
    return [[k for k in range(len(left) + 1) if block - 1 - k <= len(right) and twice[a + len(left) - k]] for a, (_, left, right) in zip(at, blocks, strict=True)]


def word_values(texts: list[bytes]) -> list[np.ndarray]:
    """A 64-bit hash of each word, text by text."""
    most = 1 << CHUNK_BITS
    who, held, size = [], [], 0
    numbers, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]

    def flush():
        nonlocal who, held, size
        data = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
        gap = (data == 32) | (data == 10)
        starts = np.nonzero(~gap & np.concatenate([[True], gap[:-1]]))[0]
        ends = np.nonzero(gap & ~np.concatenate([[True], gap[:-1]]))[0]
        numbers.append(np.array(who)[np.searchsorted(np.nonzero(data == 10)[0], starts)])
        values.append(range_hashes(data, starts, ends))
        who, held, size = [], [], 0

    for k, t in enumerate(texts):
        t, begin = t.translate(_SPACED), 0
        while begin < len(t):
            end = len(t)
            if end - begin > most:  # cut at a space
                end = t.rfind(b" ", begin, begin + most) + 1 or t.find(b" ", begin) + 1 or len(t)
            who.append(k)
            held.append(t[begin:end])
            size += end - begin
            begin = end
            if size > most:
                flush()
    if held:
        flush()
    counts = np.bincount(np.concatenate(numbers), minlength=len(texts))
    return np.split(np.concatenate(values), np.cumsum(counts)[:-1]) if texts else []


def runs(values: np.ndarray, edges: np.ndarray, length: int, spread: int):
    """For texts values[edges[k]:edges[k + 1]] (hashes of symbols) in a row: text number, anchor, first and last start, core
    hash, hash of all symbols of the run.  Positions are those in values, of fewer than 2**CHUNK_BITS symbols."""
    core = length - spread + 1
    n = len(values) - core + 1
    none = np.zeros(0, np.int64)
    if len(values) < length:
        return none, none, none, none, none, none
    total = running(values)
    h = mix((total[core:] - total[:-core]) * powers(n)[1])
    low = np.uint64((1 << CHUNK_BITS) - 1)
    key = np.full(-(-n // spread) * spread + spread, ~np.uint64(0))
    key[:n] = (h & ~low) | np.arange(n, dtype=np.uint64)
    grid = key.reshape(-1, spread)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    sizes = np.diff(edges)
    starts, text = np.arange(len(values) - length + 1), np.repeat(np.arange(len(sizes)), sizes)
    valid = starts + length <= np.repeat(edges[1:], sizes)[: len(starts)]
    starts, text = starts[valid], text[: len(starts)][valid]
    if not len(starts):
        return none, none, none, none, none, none
    anchor = (np.minimum(back[starts], ahead[starts + spread - 1]) & low).astype(np.int64)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    first = np.nonzero(new)[0]
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    a, i0, i1 = anchor[first], starts[first], starts[last]
    whole = mix(between(total, i0, i1 + length) ^ (a - i0).astype(np.uint64))
    return text[first], a, i0, i1, h[a].view(np.int64), whole.view(np.int64)


def _texts(column) -> list[bytes]:
    return [t.as_py() or b"" for t in column]


def _chunks(texts: list, length: int):
    """(numbers of texts, offsets of the pieces in them, pieces): together under 2**CHUNK_BITS symbols; long texts in pieces
    that overlap by length - 1."""
    who, where, pieces, size, most = [], [], [], 0, (1 << CHUNK_BITS) - 1
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), most - length + 1):
            piece = t[at : at + most]
            if size + len(piece) > most:
                yield who, where, pieces
                who, where, pieces, size = [], [], [], 0
            if len(piece) >= length:
                who.append(k)
                where.append(at)
                pieces.append(piece)
                size += len(piece)
    if pieces:
        yield who, where, pieces


_RUN = ["core", "whole", "words", "row", "tk", "a", "i0", "i1"]


def _all_runs(docs: DataFrame, sizes: tuple) -> DataFrame:
    """docs: raw, tk, row.  Runs of bytes and (words is true) of words; cores of the two never meet."""

    def run(batches):
        for b in _sliced(batches, 0):
            texts, keys, rows = _texts(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist()
            for words, (length, spread, *_) in enumerate(sizes):
                symbols = word_values(texts) if words else texts
                for who, where, pieces in _chunks(symbols, length):
                    edges = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
                    values = np.concatenate(pieces) if words else byte_values(np.frombuffer(b"".join(pieces), np.uint8))
                    text, a, i0, i1, core, whole = runs(values, edges, length, spread)
                    if words:
                        core = mix(core.view(np.uint64) ^ np.uint64(1)).view(np.int64)
                    shift = (np.array(where) - edges[:-1])[text]
                    mine = [who[k] for k in text.tolist()]
                    columns = [pa.array(core), pa.array(whole), pa.array(np.full(len(core), bool(words))), pa.array([rows[k] for k in mine], pa.int64()), pa.array([keys[k] for k in mine], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x + shift) for x in (a, i0, i1))], _RUN)

    long_enough = F.length("raw") >= min(sizes[0][0], 2 * sizes[1][0] - 1)
    return docs.select("raw", "tk", "row").where(long_enough).mapInArrow(lean(run), "core long, whole long, words boolean, row long, tk binary, a long, i0 long, i1 long")


_BLOCK = ["core", "part", "whole", "words", "number", "left", "right", "n", "row"]


def _blocks(texts: DataFrame, sizes: tuple) -> DataFrame:
    """texts: raw, some (array of runs).  A row for each block of each run of bytes: core, part (hash of the shared bytes and
    block number), whole, number, left, right, n, row.  A run of words is one such row, whose shared part is its core; left
    and right hold four bytes for each word."""
    (length, _, block), (n_words, word_spread) = sizes
    core_words = n_words - word_spread + 1

    def run(batches):
        for b in _sliced(batches, 0):
            out = []
            texts, wanted = _texts(b.column(0)), b.column(1).to_pylist()
            values = word_values([t if any(r["words"] for r in some) else b"" for t, some in zip(texts, wanted, strict=True)])
            for t, v, some in zip(texts, values, wanted, strict=True):
                v = v.astype("<u4")
                for r in some:
                    a, i0, i1 = r["a"], r["i0"], r["i1"]
                    if r["words"]:
                        out.append((r["core"], 0, r["whole"], True, 0, v[i0:a].tobytes(), v[a + core_words : i1 + n_words].tobytes(), r["n"], r["row"]))
                        continue
                    for number in range((a - i1) // block, (a - i0) // block + 1):
                        last = a - block * number  # the block's nominal last start
                        shared = t[last : last - block + 1 + length]
                        part = hashlib.blake2b(shared, digest_size=8, salt=number.to_bytes(8, "little")).digest()
                        left = t[max(i0, last - block + 1) : last]
                        right = t[last - block + 1 + length : min(i1, last) + length]
                        out.append((r["core"], int.from_bytes(part, "little", signed=True), r["whole"], False, number, left, right, r["n"], r["row"]))
                if len(out) > 20000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

    def batch(rows):
        kinds = [pa.int64()] * 3 + [pa.bool_(), pa.int64()] + [pa.binary()] * 2 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _BLOCK)

    return texts.select("raw", "some").mapInArrow(lean(run), "core long, part long, whole long, words boolean, number long, left binary, right binary, n long, row long")


def window_hashes(left: bytes, right: bytes, spread: int) -> tuple[int, np.ndarray]:
    """Hashes of the windows of a run of words, by how many words of left they take: the least number, and the hashes from it on."""
    x, y = np.frombuffer(left, "<u4"), np.frombuffer(right, "<u4")
    least = max(0, spread - 1 - len(y))
    takes = np.arange(least, len(x) + 1)
    total = running(mix(np.concatenate([x, np.zeros(1, "<u4"), y]).astype(np.uint64) + np.uint64(1)))
    return least, between(total, len(x) - takes, len(x) - takes + spread) ^ mix(takes.astype(np.uint64))


def _judge_words(runs_: DataFrame, spread: int) -> DataFrame:
    """core, whole, takes: windows that are in runs of two documents; the runs of a core are in one task."""

    def run(batches):
        now, held, out = None, [], []

        def judge():
            seen: dict[int, int] = {}
            for _, _, hashes, n, row in held:
                for h in hashes:
                    seen[h] = -1 if n > 1 or seen.get(h, row) != row else row
            out.extend((now, whole, least + k) for whole, least, hashes, _, _ in held for k, h in enumerate(hashes) if seen[h] < 0)

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], ["core", "whole", "takes"])

        for b in batches:
            for core, whole, left, right, n, row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if core != now:
                    judge()
                    now, held = core, []
                least, hashes = window_hashes(left, right, spread)
                held.append((whole, least, hashes.tolist(), n, row))
            if len(out) > 20000:
                yield batch()
                out = []
        judge()
        yield batch()

    return runs_.repartition("core").sortWithinPartitions("core").mapInArrow(lean(run), "core long, whole long, takes long")


def _count_words(runs_: DataFrame, spread: int) -> DataFrame:
    """The same for cores of many runs: each window on its own, counted."""

    def run(batches):
        for b in batches:
            for core, whole, left, right, n, row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                least, hashes = window_hashes(left, right, spread)
                size = len(hashes)
                columns = [np.full(size, core), np.full(size, whole), np.arange(least, least + size), hashes.view(np.int64), np.full(size, n), np.full(size, row)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["core", "whole", "takes", "h", "n", "row"])

    each = runs_.mapInArrow(lean(run), "core long, whole long, takes long, h long, n long, row long")
    twice = each.groupBy("core", "h").agg(((F.min("row") != F.max("row")) | (F.max("n") > 1)).alias("twice")).where("twice").select("core", "h")
    return each.join(twice, ["core", "h"], "left_semi").select("core", "whole", "takes")


def _judge_blocks(blocks: DataFrame, block: int) -> DataFrame:
    """blocks of at least two kinds for each (core, part): core, part, left, right, takes (left bytes of a repeated window)."""

    def run(batches):
        held, numbers, size = [], {}, 0

        def judge():
            nonlocal held, numbers, size
            rows = [(*h[:4], k) for h, takes in zip(held, repeated_windows([(numbers[h[:2]], h[2], h[3]) for h in held], block), strict=True) for k in takes]
            held, numbers, size = [], {}, 0
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["core", "part", "left", "right", "takes"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:2] not in numbers:
                    if size > STRING:
                        yield from judge()
                    numbers[row[:2]] = len(numbers)
                held.append(row)
                size += len(row[2]) + len(row[3]) + 2
        if held:
            yield from judge()

    rows = blocks.select("core", "part", "left", "right").repartition("core", "part").sortWithinPartitions("core", "part")
    return rows.mapInArrow(lean(run), "core long, part long, left binary, right binary, takes long")


def _count_windows(blocks: DataFrame, block: int) -> DataFrame:
    """The same for large groups: each window on its own, counted."""
    each = blocks.select("core", "part", "left", "right", F.explode(F.sequence(F.lit(0), F.length("left"))).alias("takes"))
    each = each.where(block - 1 - F.col("takes") <= F.length("right")).withColumn("takes", F.col("takes").cast("long"))
    mine = [F.col("core"), F.col("part"), F.col("takes"), F.expr("substring(left, length(left) - int(takes) + 1, int(takes))").alias("l"), F.substring("right", F.lit(1), (block - 1 - F.col("takes")).cast("int")).alias("r")]
    keyed = each.select(*mine, "left", "right")
    twice = keyed.groupBy("core", "part", "takes", "l", "r").count().where("count > 1").drop("count")
    return keyed.join(twice, ["core", "part", "takes", "l", "r"], "left_semi").select("core", "part", "left", "right", "takes")


def repeated_spans(docs: DataFrame, scratch: Scratch, sizes: tuple, split: int = SPLIT) -> DataFrame:
    """docs: raw (bytes), tk (their 16-byte key), row (their own number); sizes: length, spread and block for bytes, length and spread for words.

    tk, spans, passages: unsorted (start, end) of repeated bytes and of shared words; a row for each text with any."""
    length, block, spread = F.when(F.col("words"), sizes[1][0]).otherwise(sizes[0][0]), sizes[0][2], sizes[1][1]
    apart = F.min("row") != F.max("row")  # in two documents
    all_runs = scratch.table(_all_runs(docs, sizes), "runs")
    # A table of its own: a join of two shuffles is split where one core has many rows.
    cores = all_runs.groupBy("core").agg(F.count("*").alias("c"), (F.max("words") & ~apart).alias("alone")).where("c > 1 AND NOT alone")
    cores = scratch.table(cores.select("core"), "cores")
    again = scratch.table(all_runs.join(cores, "core", "left_semi"), "again")
    scratch.drop("runs")
    classes = again.groupBy("core", "whole", "words").agg(F.when(F.col("words"), F.when(apart, 2).otherwise(1)).otherwise(F.count("*")).cast("long").alias("n"), F.min(F.struct("tk", "a", "i0", "i1", "row")).alias("one"))
    classes = scratch.table(classes, "classes")
    # Classes that can share single windows with another class of their core; those of one run are to be judged.
    mixed = classes.groupBy("core").agg(F.count("*").alias("k"), F.min("n").alias("least")).where("k > 1 AND least = 1").select("core")
    open_ = classes.join(mixed, "core", "left_semi")
    wanted = open_.groupBy("one.tk").agg(F.collect_list(F.struct("core", "whole", "words", *[F.col(f"one.{c}").alias(c) for c in ("a", "i0", "i1", "row")], "n")).alias("some"))
    wanted = scratch.table(wanted, "wanted")
    texts = may_be_in(docs.select("raw", "tk"), "tk", wanted.select("tk"), "hit").where("hit").join(wanted, "tk")
    blocks = scratch.table(_blocks(texts, sizes).dropDuplicates(["core", "whole", "number"]), "blocks")
    key = ["core", "part", "left", "right"]
    kinds = scratch.table(blocks.where("NOT words").groupBy(*key).agg(F.sum("n").alias("n")), "kinds")
    groups = kinds.groupBy("core", "part").agg(F.count("*").alias("k"), F.min("n").alias("least"))
    several = groups.where("k > 1 AND least = 1")
    small = kinds.join(several.where(F.col("k") <= split).select("core", "part"), ["core", "part"], "left_semi")
    large = kinds.join(several.where(F.col("k") > split).select("core", "part"), ["core", "part"], "left_semi")
    takes = scratch.table(_judge_blocks(small, block).union(_count_windows(large, block)), "takes")
    word_runs = blocks.where("words").select("core", "whole", "left", "right", "n", "row")
    many = word_runs.groupBy("core").agg(F.count("*").alias("k")).where(F.col("k") > split).select("core")
    word_takes = _judge_words(word_runs.join(many, "core", "left_anti"), spread).union(_count_words(word_runs.join(many, "core", "left_semi"), spread))
    word_takes = word_takes.select("core", "whole", F.col("takes").alias("far"), F.col("takes").alias("near"))
    # First and last start of what is repeated, before the anchor: o = a - start.
    whole_blocks = blocks.where("NOT words").join(kinds.where("n > 1").select(*key), key, "left_semi").select(
        "core", "whole", (F.col("number") * block + F.length("left")).alias("far"), (F.col("number") * block).alias("near"))
    at = F.col("number") * block + F.col("takes")
    single = blocks.where("NOT words").join(takes, key).select("core", "whole", at.alias("far"), at.alias("near"))
    marks = whole_blocks.union(single).union(word_takes).groupBy("core", "whole").agg(F.collect_set(F.struct("far", "near")).alias("marks"))
    full = classes.where("n > 1").select("core", "whole", F.lit(True).alias("all"))
    marks = scratch.table(marks.join(full, ["core", "whole"], "full"), "marks")
    for done in ("classes", "wanted", "blocks", "kinds", "takes", "cores"):
        scratch.drop(done)
    hit = again.join(marks, ["core", "whole"])
    # near is the block's nominal last start; a run may end before it.
    starts = F.when(F.col("all"), F.array(F.struct(F.col("i0").alias("s"), (F.col("i1") + length).alias("e")))).otherwise(
        F.transform("marks", lambda m: F.struct((F.col("a") - m["far"]).alias("s"), (F.least(F.col("i1"), F.col("a") - m["near"]) + length).alias("e"))))
    each = hit.select("tk", "words", F.explode(starts).alias("x")).groupBy("tk")
    spans = each.agg(*[F.collect_set(F.when(F.col("words") == w, F.col("x"))).alias(c) for c, w in (("spans", False), ("passages", True))])
    spans = scratch.table(spans, "spans")
    for done in ("again", "marks"):
        scratch.drop(done)
    return spans


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, spread: int = SPREAD, block: int = BLOCK, split: int = SPLIT, words: int = WORDS, word_spread: int = WORD_SPREAD) -> DataFrame:
    """docs with spans (maximal removed runs of bytes), kept (the remaining bytes) and passages (maximal runs of words that
    are in a passage which another document holds; they are reported only)."""
    scratch = Scratch(docs.sparkSession)
    raw = F.coalesce(F.encode(text_col, "UTF-8"), F.lit(b""))
    key = F.unhex(F.substring(F.sha2(raw, 256), 1, 32))
    keyed = docs.select(raw.alias("raw"), key.alias("tk"), F.monotonically_increasing_id().alias("row"))
    found = repeated_spans(keyed, scratch, ((length, spread, block), (words, word_spread)), split)
    names = [c for c in docs.columns if c.lower() not in OURS]
    own = docs.select(*[F.col(f"`{c}`") for c in names])
    tk, hit, many, shared = (free_name(own, x) for x in ("_tk", "_hit", "_many", "_shared"))
    found = found.select(F.col("tk").alias(tk), F.col("spans").alias(many), F.col("passages").alias(shared))
    marked = may_be_in(own.withColumn(tk, key), tk, found.select(tk), hit)
    joined = marked.where(hit).join(found, tk, "left").select(*names, many, shared)
    at = names.index(text_col)
    types = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kind = "array<struct<start:bigint,end:bigint>>"

    def cut(batches):
        for whole in batches:
            for b in _sliced([whole], at):
                merged = lambda column: [merge([(x["s"], x["e"]) for x in some or []]) for some in column.to_pylist()]
                rest, gone, common = [], merged(b.column(len(names))), merged(b.column(len(names) + 1))
                for t, spans in zip(b.column(at), gone, strict=True):
                    t = (t.as_py() or "").encode()
                    rest.append(b"".join(t[z:s] for z, s in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(t)], strict=True)))
                as_dicts = lambda rows: pa.array([[{"start": s, "end": e} for s, e in r] for r in rows], types)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], as_dicts(gone), pa.array(rest, pa.binary()), as_dicts(common)], [*names, *OURS])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema), f"spans {kind}, kept binary, passages {kind}"])
    nothing = F.array().cast(kind)
    untouched = marked.where(~F.col(hit)).select(*names, nothing.alias("spans"), raw.alias("kept"), nothing.alias("passages"))
    return joined.mapInArrow(lean(cut), schema).unionByName(untouched)
