"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates.

1. Each document's set of 5-word shingles is hashed once; the hash's high bits choose one of BANDS * ROWS bins and the least
   hash in a bin is its value.  An empty bin copies the bin that its own probe sequence finds first (optimal densification).
2. Documents with equal sets are one class.  Classes that share a band meet in a bucket.
3. Candidates come in three rounds; each is confirmed on full sets, and only what still joins different components goes on.
   a. In the buckets of the first FIRST bands a star: the least member with each other one.
   b. In all buckets that hold several components: all pairs of a bucket of at most SMALL members, and in a larger one a
      star between the component with most members and the members of others.
   c. In larger buckets that still hold several components, members outside the bucket's largest one are joined exactly: two
      sets that are similar enough share one of their rarest shingles (a prefix), so no pair of a bucket is left out.
   A star has as many edges as members, so the pairs grow with the rows, whatever the size of a bucket.
4. Pairs whose signatures agree too little to be links are not confirmed.  Components are joined in each task by union-find
   and across tasks by large-star and small-star steps on tables in the shared folder.

At a similarity of 0.75 exactly a pair shares no band with a probability of 2e-5; at 0.8, 1e-7 (bins taken as independent).
A pair that shares one is a candidate or already in one component, however large the bucket.

Defined results: a document without words (or text) has an empty set and links with nothing; with fewer than five words its
whole sequence is the one shingle; rows without an id link with nothing, have no component and are kept; repeated rows have
equal sets, so one component; an empty table gives no rows; extra columns are ignored.  A percent under THRESHOLD is refused:
the bands are made for that similarity.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from logloom.llm.common import LOWER_BYTES, Scratch, lean, may_be_in

SHINGLE, BANDS, ROWS = 5, 40, 5
#: Bands of the first round, and members of a bucket whose pairs are all candidates.
FIRST, SMALL = 8, 9
THRESHOLD = 75  # per cent
#: Nodes that one task's union-find holds at once.
FOREST = 1 << 20
#: Bytes of text hashed at once, and words of one very long document.
CHUNK_BYTES, CHUNK_WORDS = 1 << 20, 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, n of each."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, b in (("up", _BASE), ("down", inverse)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def running(values: np.ndarray) -> np.ndarray:
    """Running sums of symbols' hashes, from which between() hashes any range."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values) + 1)[0][:-1], out=total[1:])
    return total


def between(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of symbols[start:end] for each pair."""
    return mix((total[ends] - total[starts]) * powers(len(total))[1][starts])


def byte_values(data: np.ndarray) -> np.ndarray:
    return mix(np.arange(256, dtype=np.uint64) + _BASE)[data]


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] (bytes) for each pair, from one running sum."""
    return between(running(byte_values(data)), starts, ends)


def _segments(texts: list[bytes | None]):
    """(document number, joined words, whether a segment has all words): long documents in overlapping pieces."""
    for i, t in enumerate(texts):
        w = t.translate(LOWER_BYTES).split() if t else []
        for k in range(0, max(1, len(w) - SHINGLE + 1) if w else 0, CHUNK_WORDS):
            yield i, b" ".join(w[k : k + CHUNK_WORDS + SHINGLE - 1])


def shingle_sets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and the number of each text's."""
    docs, hashes, held, size = [], [], [], 0

    def flush():
        nonlocal held, size
        data = np.frombuffer(b"\n".join([s for _, s in held]) + b"\n", np.uint8)
        ends = np.nonzero((data == 32) | (data == 10))[0]
        starts = np.concatenate([[0], ends[:-1] + 1])
        last = data[ends] == 10  # the last word of a segment
        seg = np.concatenate([[0], np.cumsum(last)[:-1]])
        count = np.bincount(seg, minlength=len(held))
        first = np.concatenate([[0], np.cumsum(count)[:-1]])
        full = np.nonzero(np.arange(len(ends)) + SHINGLE <= (first + count)[seg])[0]
        short = np.nonzero(count < SHINGLE)[0]
        a = np.concatenate([starts[full], starts[first[short]]])
        z = np.concatenate([ends[full + SHINGLE - 1], ends[first[short] + count[short] - 1]])
        docs.append(np.array([i for i, _ in held])[np.concatenate([seg[full], short])])
        hashes.append(range_hashes(data, a, z))
        held, size = [], 0

    for i, s in _segments(texts):
        held.append((i, s))
        size += len(s)
        if size > CHUNK_BYTES:
            flush()
    if held:
        flush()
    if not docs:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    d, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])
    return h[new], np.bincount(d[new], minlength=len(texts))


def set_keys(h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """16 bytes for each set, equal for equal sets only: two sums of its hashes."""
    edge = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros((len(n), 2), np.uint64)
    for c, v in enumerate((h, mix(h ^ _BASE))):
        total = np.concatenate([[np.uint64(0)], np.cumsum(v, dtype=np.uint64)])
        out[:, c] = total[edge[1:]] - total[edge[:-1]]
    return [row.tobytes() for row in out]


def signatures(h: np.ndarray, n: np.ndarray, bins: int = BANDS * ROWS) -> np.ndarray:
    """One row of bins for each nonempty set, in order."""
    n = n[n > 0]
    doc = np.repeat(np.arange(len(n)), n)
    at = doc * bins + (((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
    first = np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else np.zeros(0, bool)  # h ascends, so bins do
    sig, full = np.zeros(len(n) * bins, np.uint64), np.zeros(len(n) * bins, bool)
    sig[at[first]], full[at[first]] = h[first], True
    out = sig.copy()
    lone = np.nonzero(full.reshape(-1, bins).sum(axis=1) == 1)[0]
    out.reshape(-1, bins)[lone] = sig.reshape(-1, bins)[lone].max(axis=1, keepdims=True)
    todo = np.nonzero(~full & ~np.isin(np.arange(len(n)), lone).repeat(bins))[0]
    attempt = 0
    while len(todo):
        attempt += 1
        probe = (mix(np.arange(bins, dtype=np.uint64) + np.uint64(attempt << 20)) % np.uint64(bins)).astype(np.int64)
        source = todo // bins * bins + probe[todo % bins]
        hit = full[source]
        out[todo[hit]] = sig[source[hit]]
        todo = todo[~hit]
    return out.reshape(-1, bins)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    key = np.zeros((len(sig), bands), np.uint64) + mix(np.arange(bands, dtype=np.uint64))[None, :]
    for r in range(rows):
        key = mix(key ^ sig[:, r::rows][:, :bands])
    return key.view(np.int64)


def _sliced(batches, column: int = 1, most: int = 4 << 20):
    """Batches of at most most characters of text, but of one row at least."""
    for b in batches:
        size, begin = 0, 0
        for i, t in enumerate(b.column(column)):
            size += len(t.as_py() or "")
            if size > most:
                yield b.slice(begin, i + 1 - begin)
                size, begin = 0, i + 1
        if begin < b.num_rows:
            yield b.slice(begin)


def document_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n (set size), cid (16 bytes, equal for equal sets), bands, sig (the low byte of each bin)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in _sliced(batches):
            h, n = shingle_sets([t and t.encode() for t in b.column(1).to_pylist()])
            sigs = signatures(h, n) if len(h) else np.zeros((0, BANDS * ROWS), np.uint64)
            edges = pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]), pa.int32())
            bands = pa.ListArray.from_arrays(edges, pa.array(band_keys(sigs).ravel(), pa.int64()))
            low, at = (sigs & np.uint64(255)).astype(np.uint8), np.cumsum(n > 0) - 1
            sig = pa.array([low[k].tobytes() if m else None for k, m in zip(at.tolist(), n.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(set_keys(h, n), pa.binary()), bands, sig], ["id", "n", "cid", "bands", "sig"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"id {kind}, n long, cid binary, bands array<long>, sig binary")


def _full_sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """node, shingles for the wanted (node, cid, rep): sets anew from the texts of the representatives."""

    def run(batches):
        for b in _sliced(batches, 2):
            h, n = shingle_sets([t and t.encode() for t in b.column(2).to_pylist()])
            sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(h.view(np.int64), pa.int64()))
            right = pa.array([x == y.as_py() for x, y in zip(set_keys(h, n), b.column(1), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), sets], ["node", "shingles"]).filter(right)

    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text"))
    texts = may_be_in(texts, "rep", wanted.select("rep"), "hit").where("hit").join(wanted.select("node", "cid", "rep"), "rep")
    once = texts.select("node", "cid", "text").mapInArrow(lean(run), "node long, shingles array<long>")
    return once.groupBy("node").agg(F.first("shingles").alias("shingles"))  # repeated rows of one id


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b, shared) without those whose signatures agree far less than a link's would.

    Only between larger sets: the agreement of BANDS * ROWS bins is then within eight standard deviations of the similarity."""
    floor = percent / 100 - 8 * (percent / 100 * (1 - percent / 100) / (BANDS * ROWS)) ** 0.5

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (3, 4))
            small = np.minimum(b.column(5).to_numpy(), b.column(6).to_numpy()) < BANDS * ROWS
            good = small | ((x == y).mean(axis=1) >= floor)
            yield pa.RecordBatch.from_arrays(b.columns[:3], ["a", "b", "shared"]).filter(pa.array(good))

    side = lambda c: classes.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n").alias(f"n_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "shared", "sig_a", "sig_b", "n_a", "n_b")
    return joined.mapInArrow(lean(run), "a long, b long, shared long")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b")
    return joined.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _forest(edges: DataFrame) -> DataFrame:
    """u, v: edges from a node to a lesser one, with the components of edges (a, b); each task joins what it reads."""

    def run(batches):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = root[up]
                x = up
            return x

        def found():
            rows = [(x, r) for x in list(root) if (r := find(x)) != x]
            root.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["u", "v"])

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                u, v = find(u), find(v)
                root[max(u, v)] = min(u, v)
            if len(root) > FOREST:
                yield found()
        yield found()

    parts = 1 + edges.count() // max(FOREST, 1)  # as few as hold all edges: each joins more than any part of it would
    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(parts).mapInArrow(lean(run), "u long, v long").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root (the least node reachable) for each node of edges (a, b) that is not a root itself."""

    def write(df: DataFrame, turn: int) -> tuple[DataFrame, tuple]:
        seen = Observation()
        table = scratch.table(df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")), f"{name}_{turn}")
        return table, (seen.get["n"], seen.get["s"])

    now, seen = write(_forest(edges), 0)
    turn = 0
    while True:
        turn += 1
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_min.select("u", F.col("m").alias("v")))
        after, found = write(small.where("u <> v").distinct(), turn)
        scratch.drop(f"{name}_{turn - 1}")
        if found == seen:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now, seen = after, found


def _alike(a: str, b: str, percent: int):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _pairs(met: DataFrame) -> DataFrame:
    """a, b, shared (in how many buckets) of met: node, other."""
    return met.groupBy(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).agg(F.count("*").alias("shared"))


def _first_stars(buckets: DataFrame, percent: int) -> DataFrame:
    centres = buckets.groupBy("key").agg(F.min(F.struct("node", "n")).alias("c")).select("key", F.col("c.node").alias("other"), F.col("c.n").alias("n_other"))
    return _pairs(buckets.join(centres, "key").where((F.col("node") != F.col("other")) & _alike("n", "n_other", percent)))


def _main_roots(buckets: DataFrame) -> DataFrame:
    """key, size, main (the root of most members), other and n_other (the least of these), for buckets (key, node, n, root) of several roots."""
    by_root = buckets.groupBy("key", "root").agg(F.count("*").alias("k"), F.min(F.struct("node", "n")).alias("c"))
    main = F.max(F.struct("k", "root", "c")).alias("m")
    kinds = by_root.groupBy("key").agg(main, F.sum("k").alias("size"), F.count("*").alias("kinds")).where("kinds > 1")
    return kinds.select("key", "size", F.col("m.root").alias("main"), F.col("m.c.node").alias("other"), F.col("m.c.n").alias("n_other"))


def _second_pairs(buckets: DataFrame, mains: DataFrame, percent: int) -> DataFrame:
    small = mains.where(F.col("size") <= SMALL).select("key")
    some = buckets.join(small, "key")
    others = some.select("key", F.col("node").alias("other"), F.col("n").alias("n_other"), F.col("root").alias("r"))
    within = some.join(others, "key").where((F.col("node") < F.col("other")) & (F.col("root") != F.col("r")) & _alike("n", "n_other", percent)).select("node", "other")
    stars = buckets.join(mains.where(F.col("size") > SMALL), (buckets["key"] == mains["key"]) & (F.col("root") != F.col("main")) & _alike("n", "n_other", percent)).select("node", "other")
    return _pairs(within.union(stars))


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """token, node, n, left for the prefix of each of sets: two sets that are similar enough share a token of both prefixes.

    Tokens are ordered by the number of sets that hold them, so a prefix has what few sets share.  left counts the set's
    tokens from this one on that other sets hold too: no more can be shared by two sets whose first shared token it is."""
    tokens = sets.select("node", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("token"))
    held = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    met = tokens.join(held, "token").groupBy("node").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "token"))).alias("met"))
    least = F.floor((percent * F.col("n") + 99) / 100).cast("int")  # tokens shared with any set similar enough
    first = met.where(F.size("met") >= least).select("node", "n", F.size("met").alias("all"), F.slice("met", F.lit(1), F.size("met") - least + 1).alias("met"))
    return first.select("node", "n", "all", F.posexplode("met").alias("at", "t")).select(F.col("t.token").alias("token"), "node", "n", (F.col("all") - F.col("at")).alias("left"))


def _all_pairs(prefixes: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs of prefixes (with root and outside) of different roots, one of them outside at least, that may be similar
    enough; none that is goes missing."""
    a, b = (prefixes.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "n", "left", "root", "outside")]) for side in "ab")
    once = (F.col("root_a") != F.col("root_b")) & (~F.col("outside_b") | (F.col("node_a") < F.col("node_b")))
    enough = (100 + percent) * F.least("left_a", "left_b") >= percent * (F.col("n_a") + F.col("n_b"))
    met = a.where("outside_a").join(b, "token").where(once & _alike("n_a", "n_b", percent) & enough)
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = THRESHOLD) -> DataFrame:
    """docs' ids with n_shingles, component_id and kept: a row for each row of docs (id, n_shingles, component_id, kept)."""
    if percent < THRESHOLD:
        raise ValueError(f"the bands find pairs of {THRESHOLD} per cent and more")
    scratch = Scratch(docs.sparkSession)
    sets = scratch.table(document_sets(docs, id_col, text_col), "sets")
    some = sets.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = some.groupBy("cid").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = scratch.table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    can_link = 100 * F.col("n") >= percent * (F.col("n") + 1)  # a smaller set is similar enough to no other set
    buckets = classes.where(can_link).select("node", "n", F.posexplode("bands").alias("at", "key"))
    several = buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    shared = scratch.table(buckets.join(several, "key", "left_semi"), "buckets")  # most classes are alone in all their buckets
    links, roots, fulls, tested = None, None, [], None

    def full_sets(nodes: DataFrame, name: str) -> DataFrame:
        """node, shingles of nodes, at least; each set is made once."""
        new = nodes
        for f in fulls:
            new = new.join(f.select("node"), "node", "left_anti")
        wanted = scratch.table(classes.select("node", "cid", "rep").join(new, "node"), f"wanted_{name}")
        if not wanted.isEmpty():
            fulls.append(scratch.table(_full_sets(docs, id_col, text_col, wanted), f"full_{name}"))
        full = fulls[0]
        for f in fulls[1:]:
            full = full.union(f)
        return full

    def test(pairs: DataFrame, name: str, best_first: bool = False) -> None:
        """Confirm pairs (a, b, shared) that have not been.  best_first: the best partner of each class before all others, as what
        it joins needs no further test."""
        nonlocal links, roots, tested
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = rest = scratch.table(_likely(pairs, classes, percent), f"pairs_{name}")
        if best_first and not pairs.isEmpty():
            best = F.max_by("a", F.struct("shared", -F.col("a")))
            first = scratch.table(pairs.groupBy("b").agg(best.alias("a")).select("a", "b"), f"best_{name}")
            confirm(first, f"best_{name}")
            rest = scratch.table(apart(pairs.select("a", "b").join(first, ["a", "b"], "left_anti")), f"rest_{name}")
        if not rest.isEmpty():
            confirm(rest.select("a", "b"), f"rest_{name}")
        tested = pairs.select("a", "b") if tested is None else tested.union(pairs.select("a", "b"))

    def confirm(untested: DataFrame, name: str) -> None:
        nonlocal links, roots
        nodes = untested.select(F.col("a").alias("node")).union(untested.select(F.col("b").alias("node"))).distinct()
        good = scratch.table(_confirm(untested, full_sets(nodes, name), percent), f"links_{name}")
        if not good.isEmpty():
            links = good if links is None else links.union(good)
            roots = components(links, scratch, f"roots_{name}")

    def rooted(some: DataFrame) -> DataFrame:
        """some (with node) with the root of each node."""
        if roots is None:
            return some.withColumn("root", F.col("node"))
        return some.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def apart(some: DataFrame) -> DataFrame:
        """Those of some whose ends are in different components."""
        if roots is None:
            return some
        own = some.columns
        for side in "ab":
            mine = roots.select(F.col("node").alias(side), F.col("root").alias("r"))
            some = some.join(mine, side, "left").withColumn(f"r{side}", F.coalesce("r", side)).drop("r")
        return some.where("ra <> rb").select(*own)

    test(_first_stars(shared.where(F.col("at") < FIRST), percent), "a", best_first=True)
    now = scratch.table(rooted(shared), "now")
    test(_second_pairs(now, scratch.table(_main_roots(now), "mains"), percent), "b")
    # Large buckets of several components: members outside the main one meet all members of other components exactly.
    now = scratch.table(rooted(shared), "later")
    mains = scratch.table(_main_roots(now).where(F.col("size") > SMALL), "later_mains")
    if not mains.isEmpty():
        outside = now.join(mains, (now["key"] == mains["key"]) & (F.col("root") != F.col("main"))).select("node").distinct()
        inside = now.select("node", "root").distinct().join(mains.select(F.col("main").alias("root")).distinct(), "root", "left_semi").select("node")
        members = scratch.table(outside.withColumn("outside", F.lit(True)).union(inside.withColumn("outside", F.lit(False))).groupBy("node").agg(F.max("outside").alias("outside")), "members")
        prefixes = scratch.table(_prefixes(full_sets(members.select("node"), "members").join(members, "node"), percent), "prefixes")
        test(_all_pairs(rooted(prefixes.join(members, "node")), percent).withColumn("shared", F.lit(1).cast("long")), "c")
    labels = classes.select("cid", "node", "rep")
    if roots is not None:
        labels = rooted(labels)
        labels = labels.join(labels.groupBy("root").agg(F.min("rep").alias("least")), "root").select("cid", F.col("least").alias("rep"))
    labels = scratch.table(labels.select("cid", "rep"), "labels")
    own = F.when(F.col("n") == 0, F.col("id")).when(F.col("id").isNotNull(), F.col("rep"))
    return sets.select("id", "n", "cid").join(labels, "cid", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"),
    )
