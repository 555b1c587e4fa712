"""A journal on disk: versioned Parquet files and manifests.

A commit writes files to a directory of its own, then publishes a numbered manifest by a rename that fails if the number
is taken.  Readers use the newest manifest; a crash before the rename leaves files that no manifest names.  A manifest
may change several tables at once: marks and their checkpoint, or outgoing messages and their cursor, become visible
together.  Paths go through Hadoop's file systems, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from logloom.operators import journal as J
from logloom.sources.journals import JOURNAL

#: Tables of a store and their columns.
TABLES: dict[str, StructType | str] = {
    "journal": JOURNAL,
    "elision": "entry_id long, reaction_id string",
    "checkpoint": "reaction_id string, seek_level int, detected long, confirmed long",
    "frontier": "reaction_id string, high_water long, closed_frontier long",
    "materialized": "entry_id long, reaction_id string, destination string",
    "destination": "destination string, registered_at long, last_confirmed long",
    "outbox": "anchor_entry_id long, destination string, payload string, idempotency_key string, trigger_entry_id long",
    "delivered": "idempotency_key string",
    "playbill": "entry_id long, schema_name string, params string",
    "playbill_schema": "schema_name string, declarations string",
    "follower": "follower_id string, entry_id long",
}


class Conflict(RuntimeError):
    """Another writer has published this version."""


class JournalStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = lambda p: self._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # Manifests
    def version(self) -> int:
        at = self._path(f"{self.root}/_manifests")
        if not self._fs.exists(at):
            return 0
        return max([int(s.getPath().getName()) for s in self._fs.listStatus(at) if s.getPath().getName().isdigit()], default=0)

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        v = self.version() if version is None else version
        if v == 0:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/_manifests/{v:010d}"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _publish(self, base: int, content: dict) -> int:
        folder = f"{self.root}/_manifests"
        self._fs.mkdirs(self._path(folder))
        draft, final = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/{base + 1:010d}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise Conflict(f"version {base + 1} exists")
        return base + 1

    def commit(self, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None) -> int:
        """Publish new rows and whole new tables in one step."""
        base = self.version()
        content = {k: list(v) for k, v in self.manifest(base).items()}
        for changes, whole in ((append or {}, False), (replace or {}, True)):
            for name, df in changes.items():
                path = f"{name}/{uuid.uuid4().hex}"
                columns = self.schema(name).fieldNames()
                df.select(*columns).write.parquet(f"{self.root}/{path}")
                content[name] = [path] if whole else [*content.get(name, []), path]
        return self._publish(base, content)

    def schema(self, name: str) -> StructType:
        s = TABLES[name]
        return s if isinstance(s, StructType) else _parse_datatype_string(s)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        paths = self.manifest(version).get(name, [])
        if not paths:
            return self.spark.createDataFrame([], self.schema(name))
        return self.spark.read.schema(self.schema(name)).parquet(*[f"{self.root}/{p}" for p in paths])

    # Operators with a place to keep their results
    def scan(self, after: int = 0, raw: bool = False) -> DataFrame:
        return J.scan(self.read("journal"), after, None if raw else self.read("elision"))

    def last_id(self) -> int:
        return self.read("journal").agg(F.coalesce(F.max("entry_id"), F.lit(0))).first()[0]

    def append(self, rows: DataFrame) -> int:
        """Append rows of a journal; their ids must be behind the last one."""
        least = rows.agg(F.min("entry_id")).first()[0]
        if least is not None and least <= self.last_id():
            raise ValueError("ids ascend")
        return self.commit(append={"journal": rows})

    def append_define_and_call(self, define: DataFrame, call: DataFrame) -> int:
        """A definition and its first invocation: both or neither."""
        return self.append(define.unionByName(call))

    def elide(self, marks: DataFrame, checkpoint: DataFrame | None = None, expected: DataFrame | None = None) -> int:
        """New marks and the reaction's checkpoint in one commit; expected: what the checkpoint must have been."""
        if expected is not None:
            names = expected.select("reaction_id").distinct()
            now = self.read("checkpoint").join(names, "reaction_id", "left_semi")
            if not now.exceptAll(expected.select(*now.columns)).isEmpty() or not expected.select(*now.columns).exceptAll(now).isEmpty():
                raise Conflict("the checkpoint has moved")
        new = marks.select("entry_id", "reaction_id").distinct().join(self.read("elision"), ["entry_id", "reaction_id"], "left_anti")
        merged = None if checkpoint is None else {"checkpoint": J.upsert(self.read("checkpoint"), checkpoint, ["reaction_id", "seek_level"], "detected")}
        return self.commit(append={"elision": new}, replace=merged)

    def distill(self, until: int | None = None, forced: bool = False) -> int:
        """Rewrite the journal without elided entries and clear their marks.  Destinations must have confirmed until."""
        end = self.last_id() if until is None else until
        if not forced and not J.may_distill(self.read("destination"), F.lit(end)).first()[0]:
            raise PermissionError("a destination has not confirmed")
        journal, marks = self.read("journal"), self.read("elision")
        kept = J.distill(journal, marks.where(F.col("entry_id") <= end))
        return self.commit(replace={"journal": kept, "elision": J.clear_markers(marks, kept)})

    def register(self, destination: str) -> bool:
        """A new destination whose watermark starts at the head; False if it is there already."""
        known = self.read("destination")
        if not known.where(F.col("destination") == destination).isEmpty():
            return False
        at = self.last_id()
        self.commit(append={"destination": self.spark.createDataFrame([(destination, at, at)], self.schema("destination"))})
        return True

    def deregister(self, destination: str) -> None:
        self.commit(replace={"destination": self.read("destination").where(F.col("destination") != destination)})

    def confirm(self, destination: str, entry_id: int) -> None:
        new = self.spark.createDataFrame([(destination, entry_id)], "destination string, entry_id long")
        self.commit(replace={"destination": J.confirm(self.read("destination"), new)})

    def sync(self, destination: str, sink) -> int:
        """Give sink what is behind the destination's watermark, then raise it; returns the new watermark."""
        at = self.read("destination").where(F.col("destination") == destination).first()
        if at is None:
            raise KeyError(destination)
        rows = self.read("journal").where(F.col("entry_id") > at["last_confirmed"])
        sink(rows)
        head = rows.agg(F.max("entry_id")).first()[0]
        if head is not None:
            self.confirm(destination, head)
        return head or at["last_confirmed"]

    def record_outbox(self, messages: DataFrame, checkpoint: DataFrame | None = None) -> int:
        """Messages with new keys, and the cursor that led to them, in one commit."""
        new = messages.join(self.read("outbox").select("idempotency_key"), "idempotency_key", "left_anti")
        merged = None if checkpoint is None else {"checkpoint": J.upsert(self.read("checkpoint"), checkpoint, ["reaction_id", "seek_level"], "detected")}
        return self.commit(append={"outbox": new}, replace=merged)

    def dispatch(self, sink) -> int:
        """Deliver pending messages in order, then record them: at least once."""
        rows = J.pending(self.read("outbox"), self.read("delivered")).orderBy("trigger_entry_id", "idempotency_key")
        sink(rows)
        return self.commit(append={"delivered": rows.select("idempotency_key")})

    def shadow(self, root: str, until: int | None = None) -> JournalStore:
        """A copy up to an entry, elided entries left out: for dry runs."""
        other = JournalStore(self.spark, root)
        rows = self.scan()
        other.commit(append={"journal": rows if until is None else rows.where(F.col("entry_id") <= until)})
        return other

    def archive(self, start, end, path: str) -> None:
        J.archive(self.read("journal"), F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")).write.parquet(path)

    def record_playbill(self, schema_name: str, declarations: str, rows: DataFrame) -> int:
        """Audit rows (entry_id, params) under a registered schema; another text for a known name is an error."""
        known = self.read("playbill_schema").where(F.col("schema_name") == schema_name).first()
        if known and known["declarations"] != declarations:
            raise ValueError(f"the schema {schema_name} has drifted")
        new = rows.dropDuplicates(["entry_id"]).join(self.read("playbill").select("entry_id"), "entry_id", "left_anti").withColumn("schema_name", F.lit(schema_name))
        changes = {"playbill": new}
        if not known:
            changes["playbill_schema"] = self.spark.createDataFrame([(schema_name, declarations)], self.schema("playbill_schema"))
        return self.commit(append=changes)

    def read_playbill(self, schema_name: str) -> DataFrame:
        """Audit rows of a schema as its declared columns; an unknown schema is an error."""
        known = self.read("playbill_schema").where(F.col("schema_name") == schema_name).first()
        if known is None:
            raise KeyError(schema_name)
        rows = self.read("playbill").where(F.col("schema_name") == schema_name)
        return rows.select("entry_id", F.from_json("params", known["declarations"]).alias("p")).select("entry_id", "p.*")

    def distill_playbill(self) -> int:
        """Drop audit rows whose entry is no longer in the journal."""
        return self.commit(replace={"playbill": self.read("playbill").join(self.read("journal").select("entry_id"), "entry_id", "left_semi")})

    def archive_playbill(self, until: int, path: str) -> int:
        """Move audit rows up to an entry out of the store, to path."""
        rows = self.read("playbill")
        rows.where(F.col("entry_id") <= until).write.parquet(path)
        return self.commit(replace={"playbill": rows.where(F.col("entry_id") > until)})

    def would_skip(self, marks: DataFrame) -> DataFrame:
        """What marks would newly elide, without a commit: entry_id, reaction_id."""
        live = self.scan().select("entry_id")
        return marks.select("entry_id", "reaction_id").distinct().join(live, "entry_id", "left_semi")
