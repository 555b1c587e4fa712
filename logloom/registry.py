"""Where queries are registered, with SQL that says the same, and what they share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: events as a journal, in SQL: one stream (e) and one for each user (u).
E = "SELECT event_id + 1 AS entry_id, ts AS occurred_at, user_id, event_type AS member, value, CAST(json_extract(props, '$.k') AS INT) AS k, props FROM events"
U = f"SELECT row_number() OVER (PARTITION BY user_id ORDER BY entry_id) AS entry_id, occurred_at, user_id, member, value, k FROM ({E})"
WITH = f"WITH e AS ({E}), u AS ({U})"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a new local one only where none is set and all of Spark is one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder there that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")
