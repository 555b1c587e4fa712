"""Line de-duplication by range-partitioned hashes [DataFrame functions only].

Lines go out as hashes only.  They are range-partitioned and sorted by (hash, document, position), so a key that a third
of all lines share is spread over many partitions.  Each partition streams: a row whose hash differs from the row before
starts a key, and its document is the first that holds the key.  For a key that began in an earlier partition a table with
one row for each partition says where.  The result is a sparse bitmap for each document (64-line words with a dropped
line; all other words keep everything), not text; apply_bitmap() cuts the text.

Defined results: a null or empty text is one empty line; rows with the same id are one document and never lose lines to
each other; null ids count as one document that sorts first; repeated rows get equal results; an empty table gives no rows.
Working columns have their own names, so extra columns of any name do no harm.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import Scratch, free_name, join_found, lower_ascii

SPACE = "\t\n\x0b\x0c\r "
#: Keys with fewer code points stay.
MIN_KEY = 10


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY, scratch: Scratch | None = None) -> DataFrame:
    """One row for each (document, text) that loses lines: id, text_hash, drops array<struct<word, bits>>, n_dropped."""
    scratch = scratch or Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_key)
    hashed = keyed.select(F.struct(F.xxhash64("key").alias("a"), F.xxhash64(F.lit("b"), F.col("key")).alias("b")).alias("h"), "id", "text_hash", "pos")
    hashed = scratch.table(hashed.hint("rebalance"), "hashes")  # range partitioning reads its input twice
    order = ["h", F.col("id").asc_nulls_first(), "text_hash", "pos"]
    laid = scratch.table(hashed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "lines")
    doc = F.struct(F.col("id").isNotNull().alias("some"), "id")
    ends = laid.groupBy("part").agg(F.min(F.struct("h", doc.alias("doc"))).alias("low"), F.max("h").alias("last_h"))
    # One row for each partition: of the partitions that the low key of this one spans, the first document stands in the earliest.
    tails = laid.join(F.broadcast(ends.select("part", "last_h")), "part").where(F.col("h") == F.col("last_h"))  # as many rows as partitions
    tails = tails.groupBy(F.col("h").alias("low_h")).agg(F.min(doc).alias("carried"))
    carried = ends.select("part", F.col("low.h").alias("low_h")).join(tails, "low_h", "left")
    w = Window.partitionBy("part").orderBy(*order)
    started = laid.withColumn("starts", F.lag("h").over(w).isNull() | (F.lag("h").over(w) != F.col("h"))).withColumn("doc", doc)
    seen = F.last(F.when(F.col("starts"), F.col("doc")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    known = started.withColumn("seen", seen).join(F.broadcast(carried), "part", "left")
    first = F.when(F.col("h") == F.col("low_h"), F.coalesce(F.least("carried", "seen"), F.col("seen"))).otherwise(F.col("seen"))
    dropped = known.where(first < F.col("doc"))
    words = dropped.groupBy("id", "text_hash", F.expr("int(pos div 64)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(pos % 64))")).alias("bits"))
    return words.groupBy("id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("drops"), F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"))


def apply_bitmap(text: Column, drops: Column) -> Column:
    """text without the lines whose bits are set in drops (null: nothing to drop).  Each line is looked at once: what lies
    between two words of the bitmap stays as it is."""

    def kept(lines: Column) -> Column:
        def part(d: Column, i: Column) -> Column:
            begin = F.when(i == 0, F.lit(1)).otherwise(F.get(drops, i - 1)["word"] * 64 + 65)
            judged = F.filter(F.slice(lines, d["word"] * 64 + 1, F.lit(64)), lambda _, at: F.getbit(d["bits"], at) == 0)
            return F.concat(F.slice(lines, begin, d["word"] * 64 + 1 - begin), judged)

        rest = F.slice(lines, F.element_at(drops, -1)["word"] * 64 + 65, F.size(lines))
        return F.concat(F.flatten(F.transform(drops, part)), rest)

    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    once = F.transform(F.array(lines), kept)[0]  # the lines are split once, not for each use
    return F.when(drops.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(once, "\n"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_key: int = MIN_KEY, scratch: Scratch | None = None) -> DataFrame:
    """docs with two more columns: drops (the bitmap, null if nothing goes) and n_dropped."""
    scratch = scratch or Scratch(docs.sparkSession)
    maps = scratch.table(drop_bitmaps(docs, id_col, text_col, min_key, scratch), "bitmaps")
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("drops", "n_dropped")])
    text_hash = free_name(own, "_text_hash")
    keyed = own.withColumn(text_hash, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    joined = join_found(keyed, maps.withColumnsRenamed({"id": id_col, "text_hash": text_hash}), [text_hash, id_col])
    return joined.withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0).cast("long"))).drop(text_hash)
