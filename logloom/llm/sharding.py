"""Minimax contiguous sharding over ordered atomic groups [DataFrame functions only].

Rows with equal texts form one atomic group.  Groups stand in corpus order (smallest id first, then digest) and are cut
into contiguous shards so that the largest shard is as small as possible.  The smallest feasible capacity is found by
binary search; each trial runs the greedy check "take groups while they fit".

The greedy check needs one question answered: which is the last group end at or before x?  All group ends live in a
distributed table; the driver holds only histogram bins of it (FIRST_BINS, then BINS more for each bin that a trial
could not decide), so its memory has a bound that does not depend on the number of groups.

Defined results: a null text counts as an empty one, so both are one group and have size 1 each; null ids sort first; repeated rows each keep their row; an empty table gives no rows; extra columns pass through unless they
bear the name of an output column, in which case the output column wins.
"""

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import Scratch

#: Histogram bins for the first pass, and for each bin that is refined: a bound on what the driver collects at once.
FIRST_BINS, BINS = 1 << 16, 4096


class _Ends:
    """Bounds for 'the last group end at or before x', from bins (lo, hi] with the least and greatest end in each."""

    def __init__(self, table: DataFrame, total: int):
        self.table, self.total = table, total
        self.bins: list[tuple[int, int, int, int]] = []  # lo, hi, least end, greatest end; only bins with ends
        self._refine([(0, total)], FIRST_BINS)

    def _refine(self, spans: list[tuple[int, int]], bins: int = BINS) -> None:
        which, width = None, None
        for i, (lo, hi) in enumerate(spans):
            step = max(1, -(-(hi - lo) // bins))
            inside = (F.col("end") > lo) & (F.col("end") <= hi)
            cell = F.floor((F.col("end") - lo - 1) / step)
            which = F.when(inside, F.lit(i)) if which is None else which.when(inside, F.lit(i))
            width = F.when(inside, cell) if width is None else width.when(inside, cell)
        least, most = min(s[0] for s in spans), max(s[1] for s in spans)
        found = (
            self.table.where((F.col("end") > least) & (F.col("end") <= most))
            .select(which.alias("span"), width.alias("cell"), "end")
            .where(F.col("span").isNotNull())
            .groupBy("span", "cell").agg(F.min("end").alias("a"), F.max("end").alias("b")).collect()
        )
        self.bins = [b for b in self.bins if (b[0], b[1]) not in set(spans)]
        for r in found:
            lo, hi = spans[r["span"]]
            step = max(1, -(-(hi - lo) // bins))
            start = lo + r["cell"] * step
            self.bins.append((start, min(hi, start + step), r["a"], r["b"]))
        self.bins.sort()
        self.least = [b[2] for b in self.bins]

    def last(self, x: int) -> tuple[int, int, tuple[int, int] | None]:
        """Least and greatest possible answer, and the bin to refine if they differ."""
        i = bisect_right(self.least, x) - 1
        if i < 0:
            return 0, 0, None
        lo, hi, a, b = self.bins[i]
        return (b, b, None) if b <= x else (a, a, None) if x == a else (a, x, (lo, hi))

    def cuts(self, capacity: int, shards: int) -> list[int] | None:
        """Where the greedy check cuts, or None if capacity is too small.  Refines bins until it can tell."""
        while True:
            doubt, low, at, exact = set(), 0, 0, []
            for _ in range(shards):
                a, _, unsure = self.last(low + capacity)
                _, at, unsure2 = self.last(min(self.total, at + capacity))
                doubt |= {u for u in (unsure, unsure2) if u}
                exact.append(a)
                low = a
            if at < self.total:
                return None
            if not doubt:
                return exact
            if low >= self.total and all(self.last(x + capacity)[2] is None for x in [0, *exact[:-1]]):
                return exact
            self._refine(sorted(doubt))


def minimax_cuts(ends: DataFrame, total: int, shards: int) -> list[int]:
    """ends: one row for each group with its cumulative size, column end.  Returns shards ascending cut positions."""
    if not total:
        return [0] * shards
    known = _Ends(ends, total)
    biggest = ends.agg(F.max("size")).first()[0]
    low, high = max(-(-total // shards), biggest), -(-total // shards) + biggest
    best = None
    while low < high:
        mid = (low + high) // 2
        if (cuts := known.cuts(mid, shards)) is not None:
            best, high = (mid, cuts), mid
        else:
            low = mid + 1
    return best[1] if best and best[0] == low else known.cuts(low, shards)


def _offsets(parts: DataFrame, n: str, by: list[Column]) -> DataFrame:
    """parts: one row for each partition (and shard): what stands before each, a running sum over that small table."""
    w = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("before", F.coalesce(F.sum(n).over(w), F.lit(0)))


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in each shard) and grown_shard (null)."""
    scratch = Scratch(docs.sparkSession)
    ours = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    extra = [c for c in docs.columns if c.lower() not in ours | {id_col.lower(), text_col.lower()}]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.struct(*[F.col(f"`{c}`") for c in extra]).alias("extra") if extra else F.lit(None).alias("extra"),
    )
    order = ["first", "digest"]
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size"), F.min(F.struct(F.col("id").isNotNull(), "id")).alias("first"))
    ranged = scratch.table(groups.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "groups")
    before = _offsets(ranged.groupBy("part").agg(F.sum("size").alias("n")), "n", [])
    running = F.sum("size").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ends = scratch.table(
        ranged.withColumn("run", running).join(before.select("part", "before"), "part")
        .select("digest", "size", (F.col("run") + F.col("before")).cast("long").alias("end")), "ends",
    )
    total = ends.agg(F.max("end")).first()[0] or 0
    shard = F.lit(0)
    for cut in minimax_cuts(ends, total, shards)[:-1]:
        shard = shard + F.when(F.col("end") > cut, 1).otherwise(0)
    placed = rows.join(ends.select("digest", "end", shard.cast("int").alias("shard")), "digest")
    place = ["shard", "end", F.col("id").asc_nulls_first(), "crc"]
    laid = scratch.table(placed.drop("digest").repartitionByRange(*place).withColumn("part", F.spark_partition_id()), "placed")
    before = _offsets(laid.groupBy("part", "shard").agg(F.count("*").alias("n")), "n", [F.col("shard")]).select("part", "shard", "before")
    rank = F.row_number().over(Window.partitionBy("part", "shard").orderBy("end", F.col("id").asc_nulls_first(), "crc"))
    out = laid.withColumn("rank", rank).join(before, ["part", "shard"])
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("rank") - 1 + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        *[F.col("extra")[c].alias(c) for c in extra],
    )
