"""Toxicity by nearest labelled examples: exact TF-IDF cosine over block-max inverted indexes.

Fitting takes at most EXAMPLES labelled documents (a documented bound; the least hashes of their ids).  Words and word
beginnings that occur in clearly more toxic examples than expected become the marked terms, at most TERMS of them.  A
document with a marked term is compared over these with the examples that have one; any other document over its words with
at most PLAIN examples that have none (their whole vocabulary).  Document frequencies of both are counted over all documents.
Examples and documents are TF-IDF vectors of unit length; words that no example has are no dimensions.

An index holds its examples in blocks of BLOCK, alike ones together.  Each term has, for each block, its greatest weight:
their sum bounds the cosine in a block.  The blocks with the greatest bounds are scored first, then all whose bound is not
below the k-th best found: so the K nearest are exact.  Their votes, weighted by cosine, are calibrated by isotonic regression
on leave-one-out votes of the examples of that index.  A document without any word of the examples gets the rate of the
unmarked ones.

Defined results: null and empty texts have no term; rows without a label, or with an id that has no document, teach nothing;
of several labels for one id the greatest counts; without examples every score is 0.5; ties between examples go to the
lower number; repeated rows get equal scores; extra columns pass through unless they bear an output's name.
"""

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import Scratch, lean
from logloom.llm.decontaminate import words
from logloom.llm.neardup import _sliced

#: Bounds of fitting: labelled documents, marked terms, and examples without one in the index of whole vocabularies.
EXAMPLES, TERMS, PLAIN = 20_000, 4_096, 512
#: A term occurs in so many examples at least, has so many times the odds to be in a toxic one, and so great a chi-square.
LEAST_DOCS, LIFT, CHI2 = 5, 3.0, 20.0
BEGINNINGS = range(3, 9)
BLOCK, NEIGHBOURS, REJECT = 64, 25, 0.7
#: Blocks that a search scores before it looks at bounds again, and cases of one step of the calibration at least.
FIRST, STEP = 4, 10
OURS = ("score", "predicted", "evidence")


def features(word: bytes) -> list[str]:
    """The word and its beginnings (marked by a star)."""
    w = word.decode(errors="replace")
    return [w, *(w[:n] + "*" for n in BEGINNINGS if n < len(w))]


class _Terms(dict):
    """word -> numbers of its marked terms; filled as words are seen, emptied when large."""

    def __init__(self, terms: dict[str, int], plain: dict[bytes, int]):
        self.terms, self.plain, self.words = terms, plain, frozenset(plain)
        self.heads = {t.encode()[:3] for t in terms}  # most words begin like no term

    def __missing__(self, word: bytes):
        if len(self) > 1 << 15:
            self.clear()
        found = self[word] = tuple(t for f in features(word) if (t := self.terms.get(f)) is not None)
        return found

    def marked(self, counts: dict[bytes, int]) -> dict[int, int]:
        """How often each marked term occurs."""
        out: dict[int, int] = {}
        heads = self.heads
        for w in counts:
            if w[:3] in heads:
                for t in self[w]:
                    out[t] = out.get(t, 0) + counts[w]
        return out


def vectors(text: bytes | None, terms: _Terms) -> tuple[dict[int, int], dict[int, int]]:
    """How often each marked term occurs and, if there is none, each plain word."""
    counts = Counter(words(text))
    if marked := terms.marked(counts):
        return marked, {}
    plain = terms.plain
    return marked, {i: n for w, n in counts.items() if (i := plain.get(w)) is not None}


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for each range, in a row."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


class Index:
    """Block-max inverted index over unit vectors: postings in the order of (term, example), and for each (term, block) that has
    any their range and greatest weight."""

    def __init__(self, vectors: list[dict[int, float]], n_terms: int):
        self.size, self.blocks = len(vectors), max(1, -(-len(vectors) // BLOCK))
        doc = np.repeat(np.arange(self.size), [len(v) for v in vectors]).astype(np.int64)
        term = np.fromiter((t for v in vectors for t in v), np.int64, len(doc))
        weight = np.fromiter((w for v in vectors for w in v.values()), np.float64, len(doc))
        order = np.lexsort((doc, term))
        self.doc, term, self.weight = doc[order], term[order], weight[order]
        key = term * self.blocks + self.doc // BLOCK
        self.begin = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.zeros(0, np.int64)
        self.length = np.diff(np.append(self.begin, len(key)))
        self.block = key[self.begin] % self.blocks
        self.most = np.maximum.reduceat(self.weight, self.begin) if len(key) else np.zeros(0)
        self.edges = np.searchsorted(key[self.begin] // self.blocks, np.arange(n_terms + 1))

    def nearest(self, query: dict[int, float], k: int, skip: int = -1) -> list[tuple[float, int]]:
        """The k greatest cosines above 0 and their examples, ties to the lower number."""
        terms, q = np.fromiter(query, np.int64, len(query)), np.fromiter(query.values(), np.float64, len(query))
        size = self.edges[terms + 1] - self.edges[terms]
        held = _ranges(self.edges[terms], size)
        if not len(held):
            return []
        q, block = np.repeat(q, size), self.block[held]
        bound = np.bincount(block, q * self.most[held], self.blocks)
        score, todo = np.zeros(self.size), np.zeros(self.blocks, bool)
        todo[np.argsort(-bound, kind="stable")[:FIRST]] = True
        done = ~(bound > 0)
        while True:
            todo &= ~done
            some = todo[block]
            length = self.length[held[some]]
            at = _ranges(self.begin[held[some]], length)
            score += np.bincount(self.doc[at], np.repeat(q[some], length) * self.weight[at], self.size)
            done |= todo
            if 0 <= skip < self.size:
                score[skip] = 0
            least = np.partition(score, self.size - k)[self.size - k] if self.size > k else 0
            todo = ~done & (bound >= least - 1e-9)
            if not todo.any():
                break
        score = np.round(score, 9)
        found = np.nonzero((score > 0) & (score >= round(float(least), 9)))[0]
        best = found[np.lexsort((found, -score[found]))][:k]
        return [(float(score[i]), int(i)) for i in best]


def isotonic(points: list[tuple[float, int]], least: int = STEP) -> tuple[list[float], list[float]]:
    """Pool adjacent violators: votes and rates between which a rising line is drawn.  A pool has least cases at least, or its
    rate would be noise; it is level, and smoothed by half a case of either kind."""
    pools: list[list[float]] = []  # least and greatest vote, cases, toxic cases
    for x, y in sorted(points):
        if pools and pools[-1][1] == x:
            pools[-1][2] += 1
            pools[-1][3] += y
        else:
            pools.append([x, x, 1, y])
    merged: list[list[float]] = []
    for p in pools:
        merged.append(list(p))
        while len(merged) > 1 and (merged[-2][2] < least or merged[-2][3] * merged[-1][2] >= merged[-1][3] * merged[-2][2]):
            _, high, n, y = merged.pop()
            merged[-1][1] = high
            merged[-1][2] += n
            merged[-1][3] += y
    rates = [(p[3] + 0.5) / (p[2] + 1) for p in merged]
    rates = np.maximum.accumulate(rates).tolist() if rates else []
    return [v for p in merged for v in p[:2]], [r for r in rates for _ in range(2)]


class Space:
    """Examples of one index and their calibration."""

    def __init__(self, idf: np.ndarray, examples: list[tuple[object, dict[int, int], int]], rate: float):
        self.idf, self.rate = idf, rate
        weighted = [(self.weigh(v), y, i) for i, v, y in examples]
        weighted.sort(key=lambda e: sorted(((-w, t) for t, w in e[0].items()))[:3])  # alike ones into one block
        self.labels, self.ids = np.array([y for _, y, _ in weighted], np.int64), [i for _, _, i in weighted]
        self.index = Index([v for v, _, _ in weighted], len(idf))
        self.votes, self.rates = isotonic([(self.vote(self.index.nearest(v, NEIGHBOURS, skip=n)), y) for n, (v, y, _) in enumerate(weighted)])

    def weigh(self, counts: dict[int, int]) -> dict[int, float]:
        terms = np.fromiter(counts, np.int64, len(counts))
        w = (1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))) * self.idf[terms]
        norm = math.sqrt(float(w @ w))
        return dict(zip(terms.tolist(), (w / norm).tolist(), strict=True)) if norm else {}

    def vote(self, near: list[tuple[float, int]]) -> float:
        total = sum(c * c for c, _ in near)
        return round((sum(c * c * int(self.labels[i]) for c, i in near) + self.rate * 0.1) / (total + 0.1), 6)

    def score(self, counts: dict[int, int]) -> tuple[float, list[tuple[float, int]]]:
        """The calibrated score and the nearest examples."""
        near = self.index.nearest(self.weigh(counts), NEIGHBOURS) if counts and len(self.labels) else []
        if not near:
            return self.rate, []
        return round(float(np.interp(self.vote(near), self.votes, self.rates)), 6), near


class Model:
    """terms and plain: the numbers of marked terms and of words; marked and bare: the examples with and without a marked term."""

    def __init__(self, terms: dict[str, int], plain: dict[bytes, int], idf: tuple[np.ndarray, np.ndarray], marked: list, bare: list, none_rate: float):
        self.terms, self.plain, self.none_rate = terms, plain, none_rate
        self.marked, self.bare = Space(idf[0], marked, none_rate), Space(idf[1], bare, none_rate)

    def score(self, text: bytes | None, known: _Terms) -> tuple[float, list[tuple[object, float, int]]]:
        """The score of a text, and its nearest examples: id, cosine, label."""
        marked, plain = vectors(text, known)
        space = self.marked if marked and len(self.marked.labels) else self.bare
        score, near = space.score(marked if space is self.marked else plain)
        return score, [(space.ids[i], c, int(space.labels[i])) for c, i in near]


def _terms(examples: DataFrame) -> dict[str, int]:
    """Terms of the labelled texts, by chi-square; counts are summed in the cluster."""

    def count(batches):
        some, toxic = Counter(), Counter()
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = {f for w in set(words((text or "").encode())) for f in features(w)}
                some.update(found)
                if label:
                    toxic.update(found)
            if len(some) > 1 << 20:
                yield pa.RecordBatch.from_pydict({"term": list(some), "n": list(some.values()), "y": [toxic[t] for t in some]})
                some, toxic = Counter(), Counter()
        if some:
            yield pa.RecordBatch.from_pydict({"term": list(some), "n": list(some.values()), "y": [toxic[t] for t in some]})

    total, positive = examples.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not positive or positive == total:
        return {}
    rate = positive / total
    counts = examples.select("text", "label").mapInArrow(lean(count), "term string, n long, y long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    gap = F.col("y") - F.col("n") * rate
    chi2 = gap * gap / (F.col("n") * rate * (1 - rate))
    lifted = F.col("y") * (1 - rate) >= LIFT * rate * (F.col("n") - F.col("y"))  # odds, not shares: a share cannot be LIFT times a rate above 1 / LIFT
    good = counts.where((F.col("n") >= LEAST_DOCS) & lifted & (chi2 >= CHI2)).select("term", chi2.alias("chi2"))
    return {r["term"]: i for i, r in enumerate(good.orderBy(F.col("chi2").desc(), "term").limit(TERMS).collect())}


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES, plain: int = PLAIN) -> Model:
    """may_learn: over id_col, the labelled rows that may be learnt from."""
    spark = docs.sparkSession
    known = labels.where(may_learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    some = known.orderBy(F.xxhash64("id"), "id").limit(examples)
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")
    scratch = Scratch(spark)
    joined = scratch.table(joined, "labelled")  # read twice; as bounded as examples
    terms = _terms(joined)
    sent = spark.sparkContext.broadcast(terms)

    def read(batches):
        """Marked terms of every example, and the words of those that have none."""
        known_terms = _Terms(sent.value, {})
        for b in _sliced(batches):
            found = [vectors(t and t.encode(), known_terms)[0] for t in b.column(1).to_pylist()]
            spare = [None if v else [] if not t else list(Counter(words(t.encode())).items()) for v, t in zip(found, b.column(1).to_pylist(), strict=True)]
            lists = [[list(v) for v in found], [list(v.values()) for v in found], [None if s is None else [w for w, _ in s] for s in spare], [None if s is None else [n for _, n in s] for s in spare]]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.int32()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(x, pa.list_(k)) for x, k in zip(lists, kinds, strict=True))], ["id", "label", "terms", "counts", "words", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = joined.select("id", "text", "label").mapInArrow(lean(read), f"id {kind}, label int, terms array<int>, counts array<int>, words array<binary>, times array<int>")
    rows = scratch.table(rows, "examples")
    marked = [(r["id"], dict(zip(r["terms"], r["counts"], strict=True)), r["label"]) for r in rows.where("size(terms) > 0").select("id", "label", "terms", "counts").collect()]
    marked.sort(key=lambda r: (str(r[0]), sorted(r[1].items())))
    bare = rows.where("size(terms) = 0")
    n_bare, y_bare = bare.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    chosen = bare.where(F.size("words") > 0).orderBy(F.xxhash64("id"), "id").limit(plain).select("id", "label", "words", "times").collect()
    chosen.sort(key=lambda r: (str(r["id"]), r["times"]))
    vocabulary = {w: i for i, w in enumerate(sorted({bytes(w) for r in chosen for w in r["words"]}))}
    spare = [(r["id"], {vocabulary[bytes(w)]: n for w, n in zip(r["words"], r["times"], strict=True)}, r["label"]) for r in chosen]
    both = spark.sparkContext.broadcast((terms, vocabulary))
    scratch.close()

    def frequencies(batches):
        known_terms, n, some, plain = _Terms(*both.value), 0, Counter(), Counter()
        for b in batches:
            for t in b.column(0):
                t = t.as_py()
                n += 1
                held = dict.fromkeys(words(t and t.encode()), 1)
                some.update(known_terms.marked(held).keys())
                plain.update(known_terms.words.intersection(held))
        numbers = [-1, *some, *(vocabulary[w] + len(terms) for w in plain)]
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([n, *some.values(), *plain.values()], pa.int64())], ["term", "n"])

    df, n_docs = np.zeros(len(terms) + len(vocabulary)), 0
    if len(df):
        for r in docs.select(text_col).mapInArrow(lean(frequencies), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            if r["term"] < 0:
                n_docs = r["n"]
            else:
                df[r["term"]] = r["n"]
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    return Model(terms, vocabulary, (idf[: len(terms)], idf[len(terms) :]), marked, spare, (y_bare + 0.5) / (n_bare + 1))


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", evidence: int = 3) -> DataFrame:
    """docs with score, predicted (1 from REJECT on) and evidence: the nearest examples' id, cosine and label."""
    kept = [c for c in docs.columns if c.lower() not in OURS]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    at, sent = kept.index(text_col), docs.sparkSession.sparkContext.broadcast(model)
    types = pa.list_(pa.struct([("id", pa.string()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches):
        terms, model, known = None, None, {}
        for whole in batches:
            if model is None:
                model = sent.value
                terms = _Terms(model.terms, model.plain)
            for b in _sliced([whole], at):
                scores, why = [], []
                for t in b.column(at):
                    t = t.as_py()
                    raw = t and t.encode()
                    key = hashlib.blake2b(raw or b"", digest_size=16).digest()  # copies are scored once
                    if key not in known:
                        if len(known) > 1 << 12:
                            known.clear()
                        score, near = model.score(raw, terms)
                        known[key] = score, [{"id": str(i), "cosine": c, "label": y} for i, c, y in near[:evidence]]
                    scores.append(known[key][0])
                    why.append(known[key][1])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array([int(s >= REJECT) for s in scores], pa.int32()), pa.array(why, types)], [*kept, *OURS])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double, predicted int, evidence array<struct<id:string,cosine:double,label:int>>"])
    return docs.mapInArrow(lean(run), schema)


def held_out(id_col: Column) -> Column:
    """Rows that labels are never learnt from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))
