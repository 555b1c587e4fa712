"""Journals in SQL databases, through JDBC: one table (id, OccurredAt, Script, Action, Arguments, Skip) with id as its key.

A row with a script only is a script, one with both a definition (its text is the script), one with an action only an
invocation; Skip marks elided entries.  Reads are split by ranges of id and what is filtered by id or Skip is filtered
by the database.  Any database whose driver is on Spark's class path will do; names are quoted by its dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.journal import classify

COLUMNS = ["id", "OccurredAt", "Script", "Action", "Arguments", "Skip"]


def read_journal(spark: SparkSession, url: str, table: str, after: int = 0, raw: bool = False, partitions: int = 8, properties: dict[str, str] | None = None) -> DataFrame:
    """Entries behind an id: entry_id, occurred_at, kind, script, action_id, arguments, define_text; elided ones only if raw."""
    options = properties or {}
    whole = spark.read.jdbc(url, table, properties=options)
    named = {c.lower(): c for c in whole.columns}  # databases fold the case of names
    ends = whole.select(named["id"]).agg(F.min(named["id"]), F.max(named["id"])).first()
    if ends[0] is None:
        rows = whole
    else:
        low = max(int(ends[0]), after + 1)
        rows = spark.read.jdbc(url, table, column=named["id"], lowerBound=low, upperBound=max(int(ends[1]), low) + 1, numPartitions=partitions, properties=options)
    rows = rows.select(*[F.col(named[c.lower()]).alias(c) for c in COLUMNS]).where(F.col("id") > after)
    rows = rows if raw else rows.where(F.col("Skip") == 0)
    plain = rows.select(F.col("id").cast("long").alias("entry_id"), F.col("OccurredAt").cast("timestamp_ntz").alias("occurred_at"), F.col("Script").alias("script"), F.col("Action").cast("int").alias("action_id"), F.col("Arguments").alias("arguments"))
    defines = F.col("kind") == "DEFINE"
    return classify(plain).select(
        "entry_id", "occurred_at", "kind", F.when(~defines, F.col("script")).alias("script"), "action_id", "arguments", F.when(defines, F.col("script")).alias("define_text"),
    )


def write_journal(journal: DataFrame, url: str, table: str, elided: DataFrame | None = None, properties: dict[str, str] | None = None) -> None:
    """Append entries, those of elided with Skip set; the table's key refuses ids that are there already."""
    marks = (journal.select("entry_id").limit(0) if elided is None else elided.select("entry_id")).distinct().withColumn("__skip", F.lit(1))
    rows = journal.join(marks, "entry_id", "left").select(
        F.col("entry_id").alias("id"), F.col("occurred_at").cast("timestamp").alias("OccurredAt"), F.coalesce("script", "define_text").alias("Script"),
        F.col("action_id").alias("Action"), F.col("arguments").alias("Arguments"), F.coalesce("__skip", F.lit(0)).alias("Skip"),
    )
    rows.write.jdbc(url, table, mode="append", properties=properties or {})
