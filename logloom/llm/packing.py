"""Hierarchical multi-length packing of token sequences.

Documents are routed to the shortest window (128, 256, 512, 1024) that holds what is left of them after whole 1024-token
windows.  Each tier is packed, longest first; gaps are filled from the shorter tiers with the longest piece that fits, and
the last gap by cutting a piece, so windows come out exactly full.  What is still open when a task ends is joined into
windows of 1024 and then of 512, 256 and 128; only the rest, one window for each task, has padding.  Windows of a batch
are dealt to step groups so that the groups have nearly equal token counts.

Each task packs what it reads; nothing is shuffled, and memory holds one Arrow batch of tokens.

Defined results: null text is empty, so it is the end id alone; null ids and repeated rows are packed like others, and a
piece then names its document by the same id; an empty table gives no piece; extra columns are ignored.
"""

import base64
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logloom.llm.common import lean

WINDOW = 1024
TIERS = (128, 256, 512, 1024)
#: Tokens for a step group, nearly.
STEP_TOKENS = 1 << 16
END_ID = 0
SPECIAL = "<|endoftext|>"
#: Runs without a space that are longer go to the library whose merging is not quadratic in them.
LONG_RUN = 2000
_FIELDS = [("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("window", pa.int64()), ("step_group", pa.int64())]


def tokenizer(json_path: str | None = None, ranks_path: str | None = None):
    """text -> ids as numpy uint32, as tokenizers gives them for the json file.

    With ranks_path, the same vocabulary's ranks, tiktoken does the work several times faster with the same ids; texts with
    the special token or with very long runs go to tokenizers all the same."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path or P.path("byte_bpe_50k.json"))
    exact = lambda t: np.array(slow.encode(t, add_special_tokens=False).ids, np.uint32)
    if ranks_path is None:
        return exact
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(t: str) -> np.ndarray:
        if SPECIAL in t or (len(t) > LONG_RUN and (max(map(len, t.split()), default=0) > LONG_RUN or " " * LONG_RUN in t or "\n" * LONG_RUN in t)):
            return exact(t)
        return np.array(fast.encode_ordinary(t), np.uint32)

    return encode


class Packer:
    """Packs (document, start, length) pieces into windows; documents are numbers that the caller understands."""

    def __init__(self):
        self.windows: list[tuple[int, list[tuple[int, int, int]]]] = []
        self.pool: list[tuple[int, int, int]] = []  # (length, document, start), ascending: pieces shorter than WINDOW

    def add(self, doc: int, tokens: int) -> None:
        whole = tokens // WINDOW * WINDOW
        self.windows += [(WINDOW, [(doc, s, WINDOW)]) for s in range(0, whole, WINDOW)]
        if tokens > whole:
            self.pool.append((tokens - whole, doc, whole))

    def _fill(self, gap: int, into: list[tuple[int, int, int]], below: int) -> int:
        """Fill gap from pieces of at most below tokens; returns what stays open."""
        while gap:
            i = bisect_right(self.pool, (min(gap, below), 1 << 62, 0)) - 1
            if i >= 0:
                n, doc, start = self.pool.pop(i)
                into.append((doc, start, n))
                gap -= n
            elif self.pool and self.pool[0][0] <= below:
                n, doc, start = self.pool.pop(0)
                into.append((doc, start, gap))
                insort(self.pool, (n - gap, doc, start + gap))
                gap = 0
            else:
                break
        return gap

    def pack(self) -> None:
        """Close all windows that can be filled exactly; the rest stays in the pool."""
        self.pool.sort()
        open_: list[tuple[int, int, int]] = []
        for tier in reversed(TIERS):
            low = tier // 2 if tier > TIERS[0] else 0
            while self.pool and self.pool[-1][0] > low:
                n, doc, start = self.pool.pop()
                into = [(doc, start, n)]
                if (left := self._fill(tier - n, into, low or tier)) == 0:
                    self.windows.append((tier, into))
                else:
                    open_ += [(n, doc, start) for doc, start, n in into]
                    if left and not any(p[0] <= (low or tier) for p in self.pool[:1]):
                        while self.pool and self.pool[-1][0] > low:
                            open_.append(self.pool.pop())
        self.pool = open_

    def finish(self) -> None:
        """Join what is open into exact windows; the last one may have padding."""
        rest = sorted(self.pool, key=lambda p: (p[1], p[2]))
        self.pool = []
        total = sum(p[0] for p in rest)
        for tier in reversed(TIERS):
            while total >= tier:
                into, room = [], tier
                while room:
                    n, doc, start = rest.pop()
                    into.append((doc, start, min(n, room)))
                    if n > room:
                        rest.append((n - room, doc, start + room))
                    room -= min(n, room)
                self.windows.append((tier, into))
                total -= tier
        if rest:
            self.windows.append((WINDOW, [(doc, start, n) for n, doc, start in rest]))


def step_groups(windows: list[int]) -> list[int]:
    """A group for each window so that sums of windows are nearly equal: longest first, dealt in turn to and fro."""
    n = max(1, -(-sum(windows) // STEP_TOKENS))
    out = [0] * len(windows)
    for k, i in enumerate(sorted(range(len(windows)), key=lambda i: -windows[i])):
        lap, at = divmod(k, n)
        out[i] = at if lap % 2 == 0 else n - 1 - at
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset, window, step_group: a row for each piece."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        encode, packer = None, Packer()
        base = TaskContext.get().partitionId() << 33
        known: dict[int, tuple[object, np.ndarray]] = {}
        n_docs = n_windows = n_groups = 0

        def flush(id_type):
            nonlocal n_windows, n_groups
            groups = step_groups([w for w, _ in packer.windows])
            rows, gone = [], {}
            for (window, pieces), group in zip(packer.windows, groups, strict=True):
                offset = 0
                for doc, start, n in pieces:
                    ident, ids = known[doc]
                    rows.append((ident, start, n, ids[start : start + n].tobytes(), len(ids), base + n_windows, offset, window, base + n_groups + group))
                    offset += n
                    gone[doc] = gone.get(doc, 0) + n
                n_windows += 1
            n_groups += max(groups, default=-1) + 1
            packer.windows = []
            held = {p[1] for p in packer.pool}
            for doc in [d for d in known if d not in held]:
                del known[doc]
            for i in range(0, len(rows), 20000):
                cols = zip(*rows[i : i + 20000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [id_type, *(t for _, t in _FIELDS)], strict=True)], [id_col, *(n for n, _ in _FIELDS)])

        id_type = None
        for b in batches:
            encode = encode or tokenizer(json_path, ranks_path)
            id_type = b.column(0).type
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                for ident, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    t = text.as_py()
                    known[n_docs] = (ident, np.append(encode(t), np.uint32(END_ID)) if t else np.array([END_ID], np.uint32))
                    packer.add(n_docs, len(known[n_docs][1]))
                    n_docs += 1
                packer.pack()
                yield from flush(id_type)
        packer.finish()
        if packer.windows:
            yield from flush(id_type)

    more = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window long, step_group long"
    return docs.select(id_col, text_col).mapInArrow(lean(run), f"`{id_col}` {kind}, {more}")
