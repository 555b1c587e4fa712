"""Shared helpers: tables in the cluster's shared folder, byte-wise text rules, clash-free column names."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A-Z lower-cased, every other byte as it is.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where that is unset and all of Spark is one process (tests), a new one that
    is set for this session.  A cluster without the setting has no folder that all its machines see: an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder there that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: The default codec holds memory outside the heap for each column read.  Where the folder is on a mounted disk, the plain
#: local file system is used: the checked one starts two processes for each file that an executor writes.
_WRITE = {"compression": "zstd", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


_made: list[list[Scratch]] = []


@contextmanager
def cleaned():
    """Closes each Scratch that is made within, at the end: for steps whose results are written before."""
    _made.append([])
    try:
        yield
    finally:
        for scratch in _made.pop():
            scratch.close()


class Scratch:
    """Parquet tables in the shared folder that cut lineage: a lost executor costs a reread, not a recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        if _made:
            _made[-1].append(self)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """df, written once and read back.  name may be used once for each Scratch."""
        df.write.options(**_WRITE).parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, name: str) -> None:
        """Delete a table that nothing will read again."""
        self._delete(f"{self.root}/{name}")

    def close(self) -> None:
        """Delete all tables; only after what was derived from them has been written."""
        self._delete(self.root)


def lean(run):
    """A function over batches that gives what it has freed back to the system at its end: workers wait long between tasks."""

    def all_of(batches):
        import ctypes
        import gc

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return all_of


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, UPPER.lower())


def free_name(df: DataFrame, want: str) -> str:
    """want, with underscores in front until no column of df has that name (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while want.lower() in taken:
        want = "_" + want
    return want


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of a key filter, and of each of its pieces.
FILTER_BITS, PIECE_BITS = 1 << 26, 1 << 15


def _place(key: Column) -> tuple[Column, Column]:
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS).cast("long"))
    return (at / PIECE_BITS).cast("int"), at % PIECE_BITS


def may_be_in(df: DataFrame, key: str, keys: DataFrame, flag: str) -> DataFrame:
    """df with flag: false only where key is surely not among keys (which has a column of that name).

    The filter sent to the tasks has FILTER_BITS bits (8 MB) at most.  Past some hundred million keys it fills up and more
    rows than needed are flagged; none is missed."""
    piece, bits = free_name(df, "_piece"), free_name(df, "_bits")
    number, at = _place(F.col(key))
    pieces = keys.select(number.alias(piece), at.alias("at")).groupBy(piece).agg(F.bitmap_construct_agg("at").alias(bits))
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return df.withColumn(piece, number).join(F.broadcast(pieces), piece, "left").withColumn(flag, hit).drop(piece, bits)


def join_found(df: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """df, left-joined null-safely with found on keys.  Rows that a filter on the first key rules out are not moved."""
    hit = free_name(df, "_hit")
    marked = may_be_in(df, keys[0], found.select(keys[0]), hit)
    theirs = {k: free_name(df, f"_found_{k}") for k in keys}
    renamed = found.withColumnsRenamed(theirs)
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(t)) for k, t in theirs.items()])
    more = [c for c in found.columns if c not in keys]
    near = marked.where(hit).drop(hit).join(renamed, same, "left").drop(*theirs.values())
    far = marked.where(~F.col(hit)).select(*[F.col(f"`{c}`") for c in df.columns], *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in more])
    return near.unionByName(far)
