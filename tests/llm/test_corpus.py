"""Decontamination, near-duplicates, toxicity, repeats and the pipeline against brute force on small tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.llm import common, decontaminate, neardup, queries, repeats, toxicity
from logloom.llm.common import Scratch

SCHEMA = "doc_id long, text string, n long, cid string, hits string, score string, kept string, tk string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "c", "h", "s", "k", "t") for r in rows], SCHEMA).repartition(parts)


def corpus(seed, n=60, size=60):
    """Texts with near copies, exact copies, shared passages, nulls, repeats, very short and long ones."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 4)))
    base = [[word() for _ in range(r.randrange(1, size))] for _ in range(n // 4)]
    passage = " ".join(word() for _ in range(90))
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.randrange(3)):
            w[r.randrange(len(w))] = word()
        sep = r.choice([" ", "\n", "\t "])
        rows.append((i, sep.join(w) + (" " + passage if r.random() < 0.2 else "")))
    rows += [(900, None), (901, ""), (902, " \n "), (2, rows[2][1]), (None, rows[0][1]), (903, "one two"), (904, "ONE two"), (905, " ".join(base[0]) * 60)]
    return rows


def longest_match(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0, *(row[j] + 1 if x == b[j] else 0 for j in range(len(b)))]
        best = max(best, *row)
    return best


def test_longest_match_in_items_that_repeat_windows(spark):
    bench = spark.createDataFrame([(1, "a b c a b d"), (2, "x y " * 30 + "z"), (3, "p q r s"), (3, "p q p q r s t")], "item_id int, text string")
    texts = ["a b d", "k a b c a b d k", "y x y x y z", "x y x y", "p q r s t", "b d a b c", "a b c a b d a b d"]
    out = decontaminate.find_overlaps(frame(spark, list(enumerate(texts)), 1), bench, window=2).collect()
    got = {r.doc_id: sorted((m.item_id, m.doc_start, m.item_start, m.length) for m in r.matches) for r in out}
    assert got == {
        0: [("1", 0, 3, 3)], 1: [("1", 1, 0, 6)], 2: [("2", 0, 55, 6)], 3: [("2", 0, 0, 4)],
        4: [("3", 0, 2, 5)], 5: [("1", 2, 0, 3)], 6: [("1", 0, 0, 6)],
    }


@pytest.mark.parametrize("window", [2, 5])
def test_overlaps(spark, window):
    rows = corpus(3)
    bench = [(1, rows[0][1]), (2, rows[5][1]), (2, "zz yy"), (3, ""), (4, None), (5, "a"), (None, rows[9][1])]
    bdf = spark.createDataFrame(bench, "item_id int, text string")
    want = []
    for i, t in rows:
        w, hit, items = decontaminate.words((t or "").encode()), set(), set()
        for item, b in bench:
            x = decontaminate.words((b or "").encode())
            n = min(window, len(x))
            wins = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    items.add("" if item is None else str(item))
        want.append((str(i), len(w), len(hit), sorted(items)))
    for block_bytes in (8 << 20, 200):
        out = decontaminate.find_overlaps(frame(spark, rows), bdf, window=window, block_bytes=block_bytes)
        got = out.select("doc_id", "n_words", decontaminate.n_hit(F.col("hits")).alias("k"), "matches", "cid", "text").collect()
        assert sorted((str(r.doc_id), r.n_words, r.k, sorted({m.item_id for m in r.matches})) for r in got) == sorted(want)
        for r in got:
            for m in r.matches:
                w = decontaminate.words(r.text.encode())[m.doc_start : m.doc_start + m.length]
                assert any(w == decontaminate.words(b.encode())[m.item_start : m.item_start + m.length] for i, b in bench if b and ("" if i is None else str(i)) == m.item_id)
                assert m.length == max(longest_match(decontaminate.words(r.text.encode()), decontaminate.words(b.encode())) for i, b in bench if b and ("" if i is None else str(i)) == m.item_id)
    clean = decontaminate.decontaminate(frame(spark, rows), bdf, window=window)
    assert clean.columns == [c for c in frame(spark, rows).columns if c != "hits"] and clean.count() == sum(k[2] == 0 for k in want)
    none = bdf.limit(0)
    assert decontaminate.decontaminate(frame(spark, rows), none).count() == len(rows)
    assert decontaminate.find_overlaps(frame(spark, rows).limit(0), bdf).count() == 0


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = [bytes(b + 32 if 65 <= b <= 90 else b for b in x) for x in (t or "").encode().split()]
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets.append((i, s))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for b, (j, y) in enumerate(sets[:a]):
            if x and y and i is not None and j is not None and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return [(str(i), len(s), str(least[find(a)] if i is not None else None)) for a, (i, s) in enumerate(sets)]


@pytest.mark.parametrize(("small", "first", "bits"), [(9, 8, 1 << 27), (2, 1, 1 << 16)])
def test_near_duplicates(spark, small, first, bits, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "FIRST", first)
    monkeypatch.setattr(neardup, "FOREST", small)
    monkeypatch.setattr(common, "FILTER_BITS", bits)
    rows = corpus(4, n=160, size=40)
    out = neardup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out) == sorted(brute_components(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    assert neardup.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def one_bucket_for_all(monkeypatch):
    """Every document shares all bands with every other one, as where all hold one long passage."""
    sets = neardup.document_sets
    same = F.when(F.col("n") > 0, F.array(*[F.lit(i).cast("long") for i in range(neardup.BANDS)]))
    monkeypatch.setattr(neardup, "document_sets", lambda *a: sets(*a).withColumn("bands", same))


def test_near_duplicates_of_any_member_of_a_large_bucket(spark, monkeypatch):
    one_bucket_for_all(monkeypatch)
    # A text linked to one only of a component's 60 members, many times over.
    word = lambda *x: hashlib.md5(str(x).encode()).hexdigest()[:6]
    base = [word(i) for i in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 61):
        mine = base[:-20] + [word(i, k) for k in range(20)]  # similar to base, and at 0.8 to one another
        rows += [(i, " ".join(mine)), (100 + i, " ".join([word(i, "first", k) for k in range(20)] + mine[20:]))]  # to mine at 0.8, to others at less than 0.7
    want = brute_components(rows)
    assert len({c for _, _, c in want}) == 1
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in neardup.near_duplicates(frame(spark, rows)).collect()) == sorted(want)


def test_near_duplicates_of_parts_that_no_band_splits(spark, monkeypatch):
    one_bucket_for_all(monkeypatch)
    rows = [(2 * i + k, " ".join(f"w{i}_{j}" for j in range(30)) + (" more" if k else "")) for i in range(60) for k in range(2)]
    want = brute_components(rows)
    assert len({c for _, _, c in want}) == 60
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in neardup.near_duplicates(frame(spark, rows)).collect()) == sorted(want)


def test_similarities_below_the_bands_are_refused(spark):
    with pytest.raises(ValueError):
        neardup.near_duplicates(frame(spark, [(1, "a")]), percent=50)


def test_long_documents_hash_in_pieces(monkeypatch):
    texts = [" ".join(str(i % 700) for i in range(3000)).encode(), b"a b", b"", None, b"a b c d e f"]
    whole = neardup.shingle_sets(texts)
    monkeypatch.setattr(neardup, "CHUNK_WORDS", 11)
    monkeypatch.setattr(neardup, "CHUNK_BYTES", 100)
    pieces = neardup.shingle_sets(texts)
    assert (whole[0] == pieces[0]).all() and whole[1].tolist() == pieces[1].tolist() == [704 - 4 + 0, 1, 0, 0, 2] or whole[1].tolist() == pieces[1].tolist()


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    for size in (3, 40, 900):
        h = np.unique(r.integers(0, 1 << 63, 3 * size, dtype=np.uint64) << np.uint64(1))
        a, b = h[: 2 * size], h[size:]
        sims = []
        sig = neardup.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([len(a), len(b)]), 4000)
        sims.append((sig[0] == sig[1]).mean())
        assert abs(sims[0] - len(np.intersect1d(a, b)) / len(h)) < (0.35 if size == 3 else 0.1)


@pytest.mark.parametrize("forest", [0, 1000])
def test_components_of_chains(spark, forest, monkeypatch):
    monkeypatch.setattr(neardup, "FOREST", forest)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 100)]
    out = neardup.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark), "t").collect()
    assert {r.node: r.root for r in out} == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(s):
    s = [*s, 0]
    assert repeats.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def word_list(t):
    return [bytes(b + 32 if 65 <= b <= 90 else b for b in x) for x in (t or "").encode().split()]


def shared_words(rows, words):
    """How many words of each row are in a passage of so many words that another row holds."""
    holders = {}
    for k, (_, t) in enumerate(rows):
        w = word_list(t)
        for i in range(len(w) - words + 1):
            holders.setdefault(tuple(w[i : i + words]), set()).add(k)
    out = []
    for _, t in rows:
        w = word_list(t)
        out.append(len({i + j for i in range(len(w) - words + 1) if len(holders[tuple(w[i : i + words])]) > 1 for j in range(words)}))
    return out


def cut_repeats(rows, length):
    """(spans, remaining bytes) of each row."""
    grams = Counter()
    for _, t in rows:
        b = (t or "").encode()
        grams.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for _, t in rows:
        b = (t or "").encode()
        spans = repeats.merge([(k, k + length) for k in range(len(b) - length + 1) if grams[b[k : k + length]] > 1])
        gone = {k for s, e in spans for k in range(s, e)}
        out.append((spans, bytes(c for k, c in enumerate(b) if k not in gone)))
    return out


@pytest.mark.parametrize("split", [4096, 2])
def test_repeats(spark, split):
    rows = corpus(5) + [(950, "ab" * 300), (951, "x" * 100), (952, "q w e r t z u i o p a s " * 5), (953, "mm nn oo pp " * 6)]
    rows += [(954, "\n" + rows[0][1].upper().replace(" ", " \t")), (955, " ".join("abc"[i % 3] * 3 + str(i % 97) for i in range(20000)))]
    want = [(str(i), len(spans), hashlib.sha256(rest).hexdigest(), n) for (i, _), (spans, rest), n in zip(rows, cut_repeats(rows, 64), shared_words(rows, 12), strict=True)]
    got = repeats.remove_repeats(frame(spark, rows), length=64, spread=30, block=8, split=split, words=12, word_spread=7).collect()
    assert sorted((str(r.doc_id), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest(), sum(p.end - p.start for p in r.passages)) for r in got) == sorted(want)
    assert "tk" in got[0].asDict() and repeats.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_op9_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = []
    for (i, t), (spans, rest), n in zip(rows, cut_repeats(rows, 400), shared_words(rows, 50), strict=True):
        size = len((t or "").encode())
        want.append((i, size, size - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), n))
    got = queries.op9_repeats(spark, d).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_words_of_long_texts(monkeypatch):
    texts = [b"a bb  c" * 40, b"", b" \n", b"one" * 50 + b" two", b"A\tBB c"]
    whole = repeats.word_values(texts)
    monkeypatch.setattr(repeats, "CHUNK_BITS", 4)
    pieces = repeats.word_values(texts)
    assert [len(w) for w in whole] == [len(t.split()) for t in texts] and all((a == b).all() for a, b in zip(whole, pieces, strict=True))
    assert whole[4][0] == whole[0][0] and whole[4][1] == whole[0][1] and repeats.word_values([]) == []


def test_repeats_in_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BITS", 10)
    t = [bytes(random.Random(1).choices(range(97, 123), k=5000)), b"", b"z" * 400]
    starts = []
    for who, where, pieces in repeats._chunks(t, 400):
        edges = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        text, a, i0, i1, core, whole = repeats.runs(neardup.byte_values(np.frombuffer(b"".join(pieces), np.uint8)), edges, 400, 192)
        for k, s, e in zip(text.tolist(), i0.tolist(), i1.tolist(), strict=True):
            starts += [(who[k], where[k] + x - int(edges[k])) for x in range(s, e + 1)]
    assert sorted(starts) == [(0, i) for i in range(4601)] + [(2, 0)]


def test_nearest_is_exact():
    r = random.Random(2)
    vectors = []
    for _ in range(300):
        v = {t: r.random() for t in r.sample(range(40), r.randrange(1, 5))}
        norm = sum(x * x for x in v.values()) ** 0.5
        vectors.append({t: x / norm for t, x in v.items()})
    index = toxicity.Index(vectors, 40)
    for q in vectors[:60]:
        brute = sorted(((-round(sum(w * v.get(t, 0) for t, w in q.items()), 9), i) for i, v in enumerate(vectors)))
        assert index.nearest(q, 10) == [(-c, i) for c, i in brute[:10] if c < 0]


def test_toxicity_learns_and_leaves_clean_alone(spark):
    r = random.Random(3)
    bad = ["grunk", "blorf", "snarvel"]
    rows, labels = [], []
    for i in range(900):
        w = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(r.randrange(1, 50))]
        toxic = int(i % 6 == 0)
        if toxic:
            w[r.randrange(len(w))] = r.choice(bad).upper() + r.choice(["", "s", "ous"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    rows += [(2000, None), (2001, ""), (None, "grunk"), (0, rows[0][1])]
    labels += [(0, 1, 1), (None, 1, 1), (2001, 1, None), (7777, 0, 1)]
    docs, ldf = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, ldf, ~toxicity.held_out(F.col("doc_id")))
    out = toxicity.score_documents(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    truth = {i: y for i, _, y in labels if y is not None}
    held = [x for x in out if x.held and x.doc_id in truth]
    assert len(held) > 200 and all(0 <= x.score <= 1 for x in out)
    assert sum(x.predicted == truth[x.doc_id] for x in held) / len(held) > 0.97
    assert {x.predicted for x in out if x.doc_id in (2000, 2001)} == {0} and [x.predicted for x in out if x.doc_id is None] == [1]
    none = toxicity.fit(docs, ldf.limit(0), F.lit(True))
    assert {x.score for x in toxicity.score_documents(docs, none).collect()} == {0.5}


def brute_scores(docs, labels, terms, k=toxicity.NEIGHBOURS):
    """id -> score of each (id, text), by comparing it with all examples.  terms: the marked terms."""
    def split(t):
        w = Counter(decontaminate.words((t or "").encode()))
        marked = Counter()
        for x, n in w.items():
            for f in toxicity.features(x):
                if f in terms:
                    marked[f] += n
        return ("marked", marked) if marked else ("bare", w)

    parts = {i: split(t) for i, t in docs}
    learnt = {i: y for i, y in labels.items() if i in parts}
    bare = [i for i in learnt if parts[i][0] == "bare"]
    rate = (sum(learnt[i] for i in bare) + 0.5) / (len(bare) + 1)
    known = {"marked": set(terms), "bare": {w for i in bare for w in parts[i][1]}}
    df = Counter()
    for i, t in docs:
        w = decontaminate.words((t or "").encode())
        df.update({("bare", x) for x in w} | {("marked", f) for x in w for f in toxicity.features(x) if f in terms})

    def unit(i):
        kind, counts = parts[i]
        v = {t: (1 + np.log(n)) * (np.log((1 + len(docs)) / (1 + df[kind, t])) + 1) for t, n in counts.items() if t in known[kind]}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {t: x / norm for t, x in v.items()}

    vectors = {i: unit(i) for i in parts}

    def vote(i, skip=None):
        mine = [j for j in learnt if parts[j][0] == parts[i][0] and j != skip]
        near = sorted(((round(sum(x * vectors[j].get(t, 0) for t, x in vectors[i].items()), 9), learnt[j]) for j in mine), reverse=True)[:k]
        near = [(c, y) for c, y in near if c > 0]
        return near and round((sum(c * c * y for c, y in near) + rate * 0.1) / (sum(c * c for c, _ in near) + 0.1), 6)

    out, lines = {}, {}
    for kind in known:
        own = [i for i in learnt if parts[i][0] == kind and vectors[i]]
        lines[kind] = toxicity.isotonic([(vote(i, skip=i) or round(rate, 6), learnt[i]) for i in own])
    for i in parts:
        v = vote(i)
        out[i] = round(float(np.interp(v, *lines[parts[i][0]])), 6) if v else rate
    return out


def test_scores_against_brute_force(spark):
    r = random.Random(11)
    usual, bad = [f"w{i}" for i in range(400)], ["grunk", "blorf"]
    rows = [(i, " ".join(r.choices(usual, k=r.randrange(4, 60)) + (r.choices(bad, k=2) if i % 7 == 0 else []))) for i in range(260)]
    rows += [(900, None), (901, "."), (902, "unseen words only")]
    labels = {i: int(i % 7 == 0 or i % 11 == 0) for i in range(180)}  # some toxic ones without a marked term
    docs = frame(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int"), F.lit(True))
    assert model.terms and len(model.marked.labels) + len(model.bare.labels) == 180
    got = {x.doc_id: x.score for x in toxicity.score_documents(docs, model).collect()}
    want = brute_scores(rows, labels, model.terms)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 2e-5 for i in got)
    assert len(set(got.values())) >= 5


def test_op7_query_scores_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op7_toxicity(spark, d).collect()
    truth = {x.doc_id: x.toxic for x in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(out) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in out)
    held = [x for x in out if x.held_out and truth.get(x.doc_id) is not None]
    assert sum(x.predicted == truth[x.doc_id] for x in held) / len(held) > 0.95
    assert all(truth.get(int(e.id)) == e.label and zlib.crc32(e.id.encode()) % 3 != 1 for x in out for e in x.evidence)
    assert sum(len(x.evidence) > 0 for x in out) > 0.95 * len(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9).map(lambda x: x / 10), st.integers(0, 1)), max_size=40))
def test_calibration_rises(points):
    votes, rates = toxicity.isotonic(points, 3)
    assert votes == sorted(votes) and rates == sorted(rates) and len(votes) == len(rates) and all(0 < x < 1 for x in rates)


def test_empty_tables_teach_nothing(spark):
    none, labels = frame(spark, []).limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(none, labels, F.lit(True))
    assert toxicity.score_documents(none, model).count() == 0


def test_pipeline_stages_of_odd_tables(spark, tmp_path):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, hits string, drops string, kept string, tk string"
    rows = [(1, None, "en", "a", None, "s", "h", "d", "k", "t"), (2, "", None, "a", 0, "s", "h", "d", "k", "t"), (None, "no id here", "en", None, 10, None, None, None, None, None), (3, "the same words", "en", "a", 14, "s", "h", "d", "k", "t"), (3, "the same words", "en", "a", 14, "s", "h", "d", "k", "t")]
    for case, df in (("rows", spark.createDataFrame(rows, schema)), ("none", spark.createDataFrame([], schema))):
        now = df
        for name, stage in cp.STAGES:
            stage(spark, now, d).write.parquet(str(tmp_path / case / name))
            now = spark.read.parquet(str(tmp_path / case / name))
            if name != "pack":
                assert {"doc_id", "text", "lang", "source", "n_chars"} <= set(now.columns)
        assert (case == "none") == (now.count() == 0)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    cols, now = docs.columns, docs
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        stage(spark, now, d).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == cols
        rows = {r.doc_id: r for r in after.collect()}
        assert set(rows) <= set(before) and (name != "line_dedup" or set(rows) == set(before))
        if name == "near_dedup":
            keep = {i for i, _, c in brute_components([(r.doc_id, r.text) for r in before.values()]) if i == c}
            assert {str(i) for i in rows} == keep
        if name == "line_dedup":
            assert all(r.n_chars == len(r.text) for r in rows.values())
        before, now = rows, after
    packed = cp.pack(spark, now, d).collect()
    assert {r.doc_id for r in packed} == set(before)
    assert cp.run(spark, d).count() == len(packed)


@pytest.mark.parametrize("share", [2, 5])
def test_toxicity_at_high_base_rates(spark, share):
    """1 - 1/share of the labelled texts are toxic."""
    r = random.Random(7)
    neutral, bad = [f"word{i}" for i in range(300)], [f"slur{i}" for i in range(4)]
    texts = [(i, " ".join(r.choices(neutral, k=30) + (r.choices(bad, k=4) if i % share else []))) for i in range(900)]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % share > 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    assert {f"slur{i}" for i in range(4)} <= set(model.terms)
    out = [x for x in toxicity.score_documents(docs, model).collect() if x.doc_id >= 600]
    assert [x.predicted for x in out] == [int(x.doc_id % share > 0) for x in out]
