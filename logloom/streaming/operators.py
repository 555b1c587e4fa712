"""Structured Streaming forms: stateful sequence detection, journal replication, windows and de-duplication.

State is kept for each actor and restored from the query's checkpoint, so a restart neither rereads nor refires.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType, _parse_datatype_string

from logloom.functions.match import match
from logloom.plans.reaction import Reaction
from logloom.streaming.engine import Matcher

STATE = StructType([StructField("state", BinaryType())])
MATCH = "actor string, levels string, chain string, trigger_entry_id long, trigger_at timestamp_ntz, bindings string"


def detect_stream(spec: Reaction, stream: DataFrame) -> DataFrame:
    """Matches of spec on a stream of actor, entry_id, occurred_at, calls; one row for each match as it completes.

    Rows of a micro-batch are sorted by entry_id for each actor; entries not behind the last one seen are dropped, as
    order is that of entry_id."""
    import pandas as pd

    columns = ["actor", "levels", "chain", "trigger_entry_id", "trigger_at", "bindings"]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        matcher = Matcher(spec)
        if state.exists:
            matcher.restore(pickle.loads(state.get[0]))
        rows = pd.concat(list(frames)).sort_values("entry_id", kind="stable")
        found = []
        for r in rows.itertuples(index=False):
            calls = [_plain(c) for c in r.calls]
            for m in matcher.take({"entry_id": int(r.entry_id), "occurred_at": r.occurred_at.to_pydatetime() if hasattr(r.occurred_at, "to_pydatetime") else r.occurred_at, "calls": calls, **{c: getattr(r, c) for c in ("expose", "script") if hasattr(r, c)}}):
                names = {k: v for k, v in m.items() if k not in ("levels", "chain", "trigger_entry_id", "trigger_at")}
                found.append((key[0], ",".join(map(str, m["levels"])), ",".join(map(str, m["chain"])), m["trigger_entry_id"], m["trigger_at"], ";".join(f"{k}={v}" for k, v in sorted(names.items()))))
        state.update((pickle.dumps(matcher.state()),))
        yield pd.DataFrame(found, columns=columns)

    return stream.groupBy("actor").applyInPandasWithState(run, _parse_datatype_string(MATCH), STATE, "append", "NoTimeout")


def _plain(value):
    """Rows and arrays of a pandas batch as dicts and lists."""
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if hasattr(value, "tolist") and not isinstance(value, (str, bytes)):
        return [_plain(v) for v in value.tolist()]
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def dedup_stream(stream: DataFrame, ttl: timedelta, key: str = "message_id") -> DataFrame:
    """The first message of an id within ttl of event time (built in; an id seen again later passes again)."""
    return stream.withWatermark("occurred_at", f"{int(ttl.total_seconds())} seconds").dropDuplicatesWithinWatermark([key])


def counts(stream: DataFrame, span: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Entries for each window of event time and member."""
    return stream.withWatermark("occurred_at", late).groupBy(F.window("occurred_at", span, slide), "member").agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Entries for each session of an actor: runs without a longer gap."""
    return stream.withWatermark("occurred_at", late).groupBy(F.session_window("occurred_at", gap), "actor").agg(F.count("*").alias("n"))


def replicate(stream: DataFrame, append: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """A streaming query that hands each micro-batch to append(batch, number), which must ignore a number it has had.

    once: read what is there and stop (a job); otherwise go on polling (a cue)."""
    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


@dataclass(frozen=True)
class Rule:
    """What a follower does: then(rows, batch number) is called with the rows of a micro-batch that match, if there are any.

    A batch may come again after a crash, with the same number, so then() must be able to repeat itself."""

    name: str
    pattern: str
    then: Callable[[DataFrame, int], None]


def follow(stream: DataFrame, rules: list[Rule], checkpoint: str, once: bool = True):
    """A streaming query that calls each rule with what it matches; its checkpoint is the follower's place in the journal."""

    def each(batch: DataFrame, number: int) -> None:
        for rule in rules:
            found = match(batch, rule.pattern)
            if not found.isEmpty():
                rule.then(found, number)

    return replicate(stream, each, checkpoint, once)
