"""Relational operators on journals: scans, elision, compaction, destinations, outbox, registry, folds.

Everything is a DataFrame to a DataFrame; sources/store.py gives the same operators a place on disk with commits.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Entries that a join takes as one key.
STRETCH = 1 << 16


# Scans
def scan(journal: DataFrame, after: int = 0, elided: DataFrame | None = None) -> DataFrame:
    """Entries behind after that are not elided; order is that of entry_id."""
    found = journal.where(F.col("entry_id") > after)
    return found if elided is None else found.join(elided.select("entry_id"), "entry_id", "left_anti")


def with_expose(journal: DataFrame, expose: DataFrame) -> DataFrame:
    """The side table of exposed JSON, joined from the left."""
    return journal.join(expose.select("entry_id", "expose"), "entry_id", "left")


def classify(journal: DataFrame) -> DataFrame:
    """kind by which texts are there: a script without an action is SCRIPT, both DEFINE, an action alone INVOCATION."""
    script, action = F.col("script").isNotNull(), F.col("action_id").isNotNull()
    return journal.withColumn("kind", F.when(script & ~action, "SCRIPT").when(script & action, "DEFINE").when(action, "INVOCATION"))


def archive(journal: DataFrame, start: Column, end: Column) -> DataFrame:
    """Entries from start up to, without, end."""
    return journal.where((F.col("occurred_at") >= start) & (F.col("occurred_at") < end))


def trim(journal: DataFrame, elided: DataFrame, until: Column) -> DataFrame:
    """The journal without elided entries up to a date."""
    old = journal.where(F.col("occurred_at") <= until).join(elided.select("entry_id"), "entry_id", "left_semi").select("entry_id")
    return journal.join(old, "entry_id", "left_anti")


def recent_days(days: DataFrame, percent: float, run: int) -> DataFrame:
    """days: age (days since the last use) and n.  Ages from the most recent on, up to the run-th day in a row that adds
    less than percent of all so far.  days has one row for each age, so its windows are small."""
    w = Window.orderBy("age")
    low = 100 * F.col("n") < percent * F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    island = F.sum((~F.col("low")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    streak = F.sum(F.col("low").cast("int")).over(Window.partitionBy("island").orderBy("age").rowsBetween(Window.unboundedPreceding, 0))
    stopped = F.max((F.col("streak") >= run).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = days.withColumn("low", low).withColumn("island", island).withColumn("streak", streak).withColumn("stopped", F.coalesce(stopped, F.lit(0)))
    return marked.where("stopped = 0").select(*days.columns)


# Elision and compaction
def elide(matches: DataFrame, reaction_id: str, seeks: tuple[int, ...] = ()) -> DataFrame:
    """Marks (entry_id, reaction_id) of the chains of matches, or of the given levels only."""
    ids = F.array(*[F.element_at("levels", s + 1) for s in seeks]) if seeks else F.col("chain")
    return matches.select(F.explode(ids).alias("entry_id")).distinct().withColumn("reaction_id", F.lit(reaction_id))


def distill(journal: DataFrame, elided: DataFrame) -> DataFrame:
    """The journal without elided entries, but with its last one."""
    last = journal.agg(F.max("entry_id").alias("entry_id"))
    gone = elided.select("entry_id").distinct().join(last, "entry_id", "left_anti")
    return journal.join(gone, "entry_id", "left_anti")


def may_distill(destinations: DataFrame, until: Column) -> DataFrame:
    """One row, allowed: every destination has confirmed until; without destinations it is allowed."""
    return destinations.agg(F.coalesce(F.min("last_confirmed") >= until, F.lit(True)).alias("allowed"))


def clear_markers(elided: DataFrame, distilled: DataFrame) -> DataFrame:
    return elided.join(distilled.select("entry_id"), "entry_id", "left_semi")


def orphans(side: DataFrame, journal: DataFrame) -> DataFrame:
    """Rows of a side log whose entry is no longer in the journal."""
    return side.join(journal.select("entry_id"), "entry_id", "left_anti")


def impact(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that only one of two runs has: side ('lost' or 'new')."""
    return before.exceptAll(after).withColumn("side", F.lit("lost")).unionByName(after.exceptAll(before).withColumn("side", F.lit("new")))


# Destinations
def mark(matches: DataFrame, reaction_id: str, destination: str, marked: DataFrame | None = None) -> DataFrame:
    """Markers (entry_id, destination) that are not there yet."""
    new = matches.select(F.explode("chain").alias("entry_id")).distinct().withColumn("reaction_id", F.lit(reaction_id)).withColumn("destination", F.lit(destination))
    return new if marked is None else new.join(marked.select("entry_id", "destination"), ["entry_id", "destination"], "left_anti")


def confirm(destinations: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Watermarks raised by confirmations (destination, entry_id); they never fall."""
    top = confirmations.groupBy("destination").agg(F.max("entry_id").alias("__c"))
    return destinations.join(top, "destination", "left").withColumn("last_confirmed", F.greatest("last_confirmed", F.coalesce("__c", "last_confirmed"))).drop("__c")


def unread(journal: DataFrame, destinations: DataFrame) -> DataFrame:
    """For each destination the entries behind its watermark.  Each destination meets the stretches of ids from its watermark
    on, so the join has a key, however many destinations there are."""
    head = journal.agg(F.floor(F.max("entry_id") / STRETCH).alias("__head"))  # one row
    each = F.explode(F.sequence(F.least(F.floor(F.col("last_confirmed") / STRETCH), F.col("__head")), F.col("__head")))
    wanted = destinations.select("destination", "last_confirmed").join(head).where("__head IS NOT NULL").select("destination", "last_confirmed", each.alias("__stretch"))
    keyed = journal.withColumn("__stretch", F.floor(F.col("entry_id") / STRETCH))
    return keyed.join(wanted, "__stretch").where(F.col("entry_id") > F.col("last_confirmed")).drop("last_confirmed", "__stretch")


# Outbox
def outbox(matches: DataFrame, reaction_id: str, destination: str, payload: Column, known: DataFrame | None = None) -> DataFrame:
    """A row for each new idempotency key reaction:anchor:level."""
    key = F.concat_ws(":", F.lit(reaction_id), F.element_at("levels", 1), F.size("levels") - 1)
    rows = matches.select(F.element_at("levels", 1).alias("anchor_entry_id"), F.lit(destination).alias("destination"), payload.alias("payload"), key.alias("idempotency_key"), "trigger_entry_id", "actor")
    first = F.row_number().over(Window.partitionBy("idempotency_key").orderBy("trigger_entry_id", "actor"))
    once = rows.withColumn("__n", first).where("__n = 1").drop("__n", "actor")
    return once if known is None else once.join(known.select("idempotency_key"), "idempotency_key", "left_anti")


def pending(box: DataFrame, delivered: DataFrame) -> DataFrame:
    return box.join(delivered.select("idempotency_key"), "idempotency_key", "left_anti")


def upsert(table: DataFrame, rows: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Keyed merge: rows replace those of the same key; without order the first stays (insert or ignore)."""
    both = table.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
    by = [F.col("__new").desc(), F.col(order).desc()] if order else [F.col("__new")]
    return both.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).where("__n = 1").drop("__n", "__new")


# Programs
def shape(script: Column) -> Column:
    """A script with its literals, comments and runs of spaces taken out: what promotion counts."""
    bare = F.regexp_replace(script, r"//[^\n]*|(?s)/\*.*?\*/", " ")
    bare = F.regexp_replace(bare, r"'(?:[^'\\]|\\.)*'", "?")
    bare = F.regexp_replace(bare, r"\b\d{1,2}/\d{1,2}/\d{4}( \d{1,2}:\d{2}:\d{2})?", "?")
    bare = F.regexp_replace(bare, r"(?<![A-Za-z_0-9#@])\d+(\.\d+)?[mMdD]?", "?")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def literals(script: Column) -> Column:
    """The literals that shape() takes out, in order."""
    return F.regexp_extract_all(script, F.lit(r"('(?:[^'\\]|\\.)*'|\b\d{1,2}/\d{1,2}/\d{4}(?: \d{1,2}:\d{2}:\d{2})?|(?<![A-Za-z_0-9#@])\d+(?:\.\d+)?[mMdD]?)"), F.lit(1))


def promote(scripts: DataFrame, threshold: int = 10, script: str = "script") -> DataFrame:
    """scripts with shape, sighting (from 1), kind, args: from sighting threshold + 1 on (threshold 1: from the first) an
    entry invokes the action of its shape; the first such entry also defines it."""
    w = Window.partitionBy("shape").orderBy("entry_id")
    seen = scripts.withColumn("shape", shape(F.col(script))).withColumn("sighting", F.row_number().over(w).cast("long"))
    cut = threshold + 1 if threshold > 1 else 1
    kind = F.when(F.col("sighting") < cut, "SCRIPT").when(F.col("sighting") == cut, "DEFINE").otherwise("INVOCATION")
    return seen.withColumn("kind", kind).withColumn("args", F.when(F.col("sighting") >= cut, F.concat_ws(",", literals(F.col(script)))))


def invocations(defines: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls with the definition of their action that was the last before them: one pass over both in order, no join."""
    d = defines.select("action_id", "entry_id", F.struct(F.col("entry_id").alias("define_id"), "define_text").alias("__define"), F.lit(None).cast(calls.select(F.struct("*")).schema[0].dataType).alias("__call"))
    c = calls.select("action_id", "entry_id", F.lit(None).cast(d.schema["__define"].dataType).alias("__define"), F.struct(*[F.col(x) for x in calls.columns]).alias("__call"))
    w = Window.partitionBy("action_id").orderBy("entry_id", F.col("__define").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    held = d.unionByName(c).withColumn("__last", F.last("__define", ignorenulls=True).over(w))
    return held.where("__call IS NOT NULL AND __last IS NOT NULL").select("__call.*", "__last.define_id", "__last.define_text")


def upgrades(entries: DataFrame) -> DataFrame:
    """name, body: one row for each name, its first entry, and whether a later body differs (an error)."""
    return entries.groupBy("name").agg(F.min("entry_id").alias("entry_id"), F.min_by("body", "entry_id").alias("body"), (F.count_distinct("body") > 1).alias("drift"))


def last_values(assignments: DataFrame, by: list[str]) -> DataFrame:
    """State after replay where the fold keeps the last value: symbol -> value."""
    return assignments.groupBy(*by).agg(F.max("entry_id").alias("entry_id"), F.max_by("value", "entry_id").alias("value"))


def fold(entries: DataFrame, key: list[str], step, start, schema: str) -> DataFrame:
    """An ordered, non-commutative fold for each key: step(state, row) -> state; state is a dict with the columns of schema.

    Rows are dealt by key, sorted and streamed, so a task holds one state at a time, whatever the number of entries."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = _parse_datatype_string(schema)
    target = to_arrow_schema(out)

    def run(batches):
        now, state, done = None, None, []
        for b in batches:
            for row in b.to_pylist():
                k = tuple(row[c] for c in key)
                if k != now:
                    if now is not None:
                        done.append({**dict(zip(key, now, strict=True)), **state})
                    now, state = k, dict(start)
                state = step(state, row)
            if len(done) > 10000:
                yield pa.RecordBatch.from_pylist(done, schema=target)
                done = []
        if now is not None:
            done.append({**dict(zip(key, now, strict=True)), **state})
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=target)

    return entries.repartition(*key).sortWithinPartitions(*key, "entry_id").mapInArrow(run, out)


def funnel(levels: list[DataFrame]) -> DataFrame:
    """How many rows each level has: level, n."""
    counts = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("level"), "n") for k, d in enumerate(levels)]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


# Messages
def ledger(tells: DataFrame, acks: DataFrame, failures: DataFrame) -> DataFrame:
    """envelope_id, told_at, acked_at, failed_at, state: the first tell of each envelope, the first ack behind it, the first
    failure behind it; a failure loses to an ack."""
    first = tells.groupBy("envelope_id").agg(F.min("entry_id").alias("told_at"))

    def behind(what: DataFrame, name: str) -> DataFrame:
        w = what.select("envelope_id", F.col("entry_id").alias(name))
        return first.join(w, "envelope_id").where(F.col(name) > F.col("told_at")).groupBy("envelope_id").agg(F.min(name).alias(name))

    out = first.join(behind(acks, "acked_at"), "envelope_id", "left").join(behind(failures, "failed_at"), "envelope_id", "left")
    return out.withColumn("state", F.when(F.col("acked_at").isNotNull(), "acked").when(F.col("failed_at").isNotNull(), "failed").otherwise("pending"))


def causation(tells: DataFrame, journal: DataFrame, check: Column) -> DataFrame:
    """tells (entry_id, cause_id) with caused: whether the entry that they name is in the journal and passes check there.
    Also a message whose own id is implicit is checked."""
    causes = journal.where(check).select(F.col("entry_id").alias("cause_id"), F.lit(True).alias("caused")).distinct()
    return tells.join(causes, "cause_id", "left").withColumn("caused", F.coalesce("caused", F.lit(False)))


def saga_check(verbs: DataFrame, by: str = "actor") -> DataFrame:
    """verbs (start, step, compensate, close) with the state before each and whether it is legal.

    A saga starts once, and the first close behind its start ends it; illegal verbs change nothing."""
    start = verbs.where("verb = 'start'").groupBy(by).agg(F.min("entry_id").alias("__s"))
    close = verbs.where("verb = 'close'").join(start, by).where(F.col("entry_id") > F.col("__s")).groupBy(by).agg(F.min("entry_id").alias("__c"))
    known = verbs.join(start, by, "left").join(close, by, "left")
    e, s, c = F.col("entry_id"), F.col("__s"), F.col("__c")
    state = F.when(s.isNull() | (e <= s), "none").when(c.isNull() | (e <= c), "open").otherwise("closed")
    legal = F.when(F.col("verb") == "start", e.eqNullSafe(s)).otherwise(state == "open")
    return known.withColumn("state", state).withColumn("legal", legal).drop("__s", "__c")


def dedup_window(messages: DataFrame, ttl: timedelta, key: str = "message_id") -> DataFrame:
    """messages with accepted: the first of an id, and each that comes ttl or more after the last accepted one.

    Whether a message is accepted depends on the last accepted one, so each id is an ordered fold; ids are dealt and streamed."""
    import pyarrow as pa

    seconds = ttl.total_seconds()
    columns = messages.columns
    at, when = columns.index(key), columns.index("occurred_at")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in messages.schema), "accepted boolean"])

    def run(batches):
        now, last = None, None
        for b in batches:
            out = []
            for k, t in zip(b.column(at).to_pylist(), b.column(when).to_pylist(), strict=True):
                ok = k != now or last is None or (t - last).total_seconds() >= seconds
                now, last = k, t if ok else last
                out.append(ok)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*columns, "accepted"])

    return messages.repartition(key).sortWithinPartitions(key, "entry_id").mapInArrow(run, schema)


def idle(entries: DataFrame, now: Column, span: timedelta) -> DataFrame:
    """Actors whose last entry is older than span: actor, last_at, n."""
    return entries.groupBy("actor").agg(F.max("occurred_at").alias("last_at"), F.count("*").alias("n")).where(F.col("last_at") < now - F.lit(span))


def closed_frontier(nodes: DataFrame, fired: DataFrame, high_water: DataFrame) -> DataFrame:
    """One row: high_water, and the entry before the oldest anchor that has not fired (or high_water if none is open)."""
    open_ = nodes.select("actor", F.element_at("levels", 1).alias("anchor")).join(fired.select("actor", F.element_at("levels", 1).alias("anchor")).distinct(), ["actor", "anchor"], "left_anti")
    oldest = open_.agg(F.min("anchor").alias("oldest"))
    return high_water.crossJoin(oldest).select("high_water", F.least("high_water", F.coalesce(F.col("oldest") - 1, F.col("high_water"))).alias("closed_frontier"))  # one row each


def fnv1a64(text: Column) -> Column:
    """FNV-1a, 64 bits, over UTF-8: multiplication modulo 2**64 in 32-bit halves, so that nothing overflows."""
    low, prime_low = F.lit(0xFFFFFFFF).cast("long"), F.lit(0x1B3).cast("long")  # the prime is 2**40 + 0x1b3

    def step(state: Column, byte: Column) -> Column:
        lo, hi = state["lo"].bitwiseXOR(byte), state["hi"]
        product = lo * prime_low
        carry = F.shiftrightunsigned(product, 32)
        high = (hi * prime_low + carry + F.shiftleft(lo.bitwiseAND(F.lit(0xFFFFFF).cast("long")), 8)).bitwiseAND(low)
        return F.struct(product.bitwiseAND(low).alias("lo"), high.alias("hi"))

    hexed = F.hex(F.encode(text, "UTF-8"))
    bytes_ = F.transform(F.sequence(F.lit(1), (F.length(hexed) / 2).cast("int")), lambda i: F.conv(F.substring(hexed, (i * 2 - 1).cast("int"), F.lit(2)), 16, 10).cast("long"))
    bytes_ = F.when(F.length(hexed) > 0, bytes_).otherwise(F.expr("cast(array() as array<bigint>)"))
    start = F.struct(F.lit(0x84222325).cast("long").alias("lo"), F.lit(0xCBF29CE4).cast("long").alias("hi"))
    done = lambda s: F.lower(F.concat(F.lpad(F.hex(s["hi"]), 8, "0"), F.lpad(F.hex(s["lo"]), 8, "0")))
    return F.aggregate(bytes_, start, step, done)


# Documents
def check_rows(df: DataFrame, checks: list[tuple[Column, str, str]], key: list[str]) -> DataFrame:
    """One row for each failed check: key, severity, message."""
    out = None
    for ok, severity, message in checks:
        bad = df.where(~F.coalesce(ok, F.lit(False))).select(*key, F.lit(severity).alias("severity"), F.lit(message).alias("message"))
        out = bad if out is None else out.unionByName(bad)
    return out


# Registry, order and sagas
def active(reactions: DataFrame, now: Column, role: str) -> DataFrame:
    """Reactions that may run: active, not expired, and for this role (director, cast) or for the whole company."""
    alive = F.coalesce(F.col("active"), F.lit(True)) & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return reactions.where(alive & F.col("activation").isin("company", role))


def unconfirmed(checkpoints: DataFrame) -> DataFrame:
    """Checkpoints that an action has detected but not confirmed: reported, never retried."""
    return checkpoints.where(F.col("detected") > F.col("confirmed")).withColumn("gap", F.col("detected") - F.col("confirmed"))


def gaps(journal: DataFrame, by: str = "actor") -> DataFrame:
    """Places where ids are missing or times run back: entry_id, missing, backwards."""
    w = Window.partitionBy(by).orderBy("entry_id")
    missing = F.col("entry_id") - F.lag("entry_id").over(w) - 1
    back = F.col("occurred_at") < F.lag("occurred_at").over(w)
    marked = journal.select(by, "entry_id", F.coalesce(missing, F.lit(0)).alias("missing"), F.coalesce(back, F.lit(False)).alias("backwards"))
    return marked.where((F.col("missing") > 0) | F.col("backwards"))


def steps_once(steps: DataFrame, key: list[str]) -> DataFrame:
    """The first entry of each (saga, key, step): a step runs once."""
    return steps.groupBy(*key).agg(F.min("entry_id").alias("entry_id"))


def closed_trajectories(verbs: DataFrame, by: str = "actor") -> DataFrame:
    """Entries that a legal close elides: all legal verbs of its saga."""
    checked = saga_check(verbs, by)
    closed = checked.where("legal AND verb = 'close'").select(by)
    return checked.where("legal").join(closed, by, "left_semi").select(by, "entry_id")
