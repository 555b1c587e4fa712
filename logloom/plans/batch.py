"""Reactions as relational plans.

A journal has entry_id (order), occurred_at, optionally actor (an independent stream each) and calls (facts).  Levels join
on the actor and on every equality of "where", which Catalyst takes as hash keys; windows become bucketed range joins.
Quantifiers are windows and aggregates, an exact count needs the first entry behind its window
(an as-of join by a running minimum), coverage is relational division.

Result: actor, levels (entry of each level), chain (all entries, ascending in each level), trigger_entry_id,
trigger_at, and a column for each captured name (later levels override earlier ones).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.expr import Compiler, Typed, type_of
from logloom.functions.match import match
from logloom.lang import syntax as S
from logloom.lang.patterns import parse_pattern, unifying
from logloom.plans.reaction import Reaction, Seek

_OWN = ["actor", "entry_id", "occurred_at"]


def with_actor(journal: DataFrame) -> DataFrame:
    return journal if "actor" in journal.columns else journal.withColumn("actor", F.lit(""))


def level(journal: DataFrame, seek: Seek) -> DataFrame:
    """Entries that fit a seek: actor, entry_id, occurred_at and captures.  Several patterns must all fit one entry."""
    if seek.source is not None:
        return with_actor(seek.source)
    out = None
    for p in seek.patterns:
        found = match(journal, p)
        caught = [c for c in found.columns if c not in journal.columns or c.lower() not in {x.lower() for x in journal.columns}]
        found = found.select(*_OWN, *caught)
        out = found if out is None else out.join(found.select("actor", "entry_id", *[c for c in caught if c not in out.columns]), ["actor", "entry_id"])
    return out


def _names(parent: DataFrame | None, event: DataFrame, event_prefix: str) -> dict[str, Typed]:
    """What "where" can see: captures of the event before those of its parents, @Now, @EntryId, Seek.@Now, Seek.@EntryId."""
    out: dict[str, Typed] = {}
    kinds = lambda df: {f.name: type_of(f.dataType.simpleString()) for f in df.schema}
    if parent is not None:
        for c, k in kinds(parent).items():
            if c.startswith("c_"):
                out[c[2:]] = Typed(F.col(c), k)
        out["seek.@now"], out["seek.@entryid"] = Typed(F.col("node_at"), "datetime"), Typed(F.col("node_id"), "long")
    for c, k in kinds(event).items():
        if c not in _OWN:
            out[c.lower()] = Typed(F.col(event_prefix + c), k)
    out["@now"] = out["now"] = Typed(F.col(event_prefix + "occurred_at"), "datetime")
    out["@entryid"] = Typed(F.col(event_prefix + "entry_id"), "long")
    return out


def _condition(seek: Seek, names: dict[str, Typed]) -> list[Column]:
    """The conjuncts of "where".  a == b of plain names compiles to a two-valued equality, which a join takes as a key."""
    return [Compiler(names).typed(c).col for c in S.conjuncts(S.parse_expression(seek.where))] if seek.where else []


def _joined(parents: DataFrame, events: DataFrame, seek: Seek, how_anchor: str = "anchor", first: str = "node_id", inclusive: bool = False) -> DataFrame:
    """Pairs of a live parent and a later event that passes window and "where"; event columns are prefixed e_."""
    e = events.select(*[F.col(c).alias("e_" + c) for c in events.columns])
    after = F.col("e_entry_id") >= F.col(first) if inclusive else F.col("e_entry_id") > F.col(first)
    on = [F.col("actor") == F.col("e_actor"), after, *_condition(seek, _names(parents, events, "e_"))]
    same = {n for p in seek.patterns for n in unifying(parse_pattern(p)) if f"c_{n}" in parents.columns}
    on += [F.lower(F.col(f"c_{n}").cast("string")) == F.lower(F.col(f"e_{n}").cast("string")) for n in sorted(same)]
    if how_anchor:
        if seek.entries is not None:
            on.append(F.col("e_entry_id") - F.col(f"{how_anchor}_id") <= seek.entries)
        if seek.time is not None:
            on.append(F.col("e_occurred_at") - F.col(f"{how_anchor}_at") <= F.lit(seek.time))
    if how_anchor and (seek.entries or seek.time):
        # A range join: each parent meets its own bucket of entries (or of time) and the next, beside any other key, so that
        # neither one actor nor one key brings all its history together.
        if seek.entries:
            mine, theirs = (F.floor(c / seek.entries) for c in (F.col(f"{how_anchor}_id"), F.col("e_entry_id")))
        else:
            span = int(seek.time.total_seconds() * 1_000_000) or 1
            mine, theirs = (F.floor(_micros(c) / span) for c in (F.col(f"{how_anchor}_at"), F.col("e_occurred_at")))
        parents = parents.withColumn("bucket", F.explode(F.array(mine, mine + 1)))
        on.append(F.col("bucket") == F.col("e_bucket"))
        return parents.join(e.withColumn("e_bucket", theirs), _all(on)).drop("bucket", "e_bucket")
    return parents.join(e, _all(on))


def _micros(at: Column) -> Column:
    """Microseconds since 1970 of a time without a zone, whatever the session's zone."""
    days = F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return (days * 86400 + F.hour(at) * 3600 + F.minute(at) * 60) * 1_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")


def _all(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _captures(parents: DataFrame | None, events: DataFrame, prefix: str) -> list[Column]:
    mine = {f"c_{c.lower()}": F.col(prefix + c) for c in events.columns if c not in _OWN}
    before = {c: F.col(c) for c in (parents.columns if parents is not None else []) if c.startswith("c_")}
    return [v.alias(k) for k, v in (before | mine).items()]


#: Entries, and microseconds, that a running minimum sees at once.
STRETCH_IDS, STRETCH_MICROS = 1 << 16, 3_600_000_000


def first_after(parents: DataFrame, journal: DataFrame, limit: Column, by: str = "entry_id", equal: bool = False) -> DataFrame:
    """parents with closing_id and closing_at: the first entry of the actor whose by is greater than limit (equal: or the
    same); rows without one go.

    A running minimum within stretches of each actor's stream, and one over the stretches for what a later one holds: no
    range join, and no task that sees a whole stream."""
    marks = parents.withColumn("__limit", limit).withColumn("__row", F.struct(*[F.col(c) for c in parents.columns]))
    mine = marks.select("actor", F.col("__limit").alias("at"), F.lit(1 if equal else 0).alias("kind"), F.col("__row").alias("row"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("timestamp_ntz").alias("when"))
    theirs = journal.select("actor", F.col(by).alias("at"), F.lit(0 if equal else 1).alias("kind"), F.lit(None).cast(marks.schema["__row"].dataType).alias("row"), F.col("entry_id").alias("id"), F.col("occurred_at").alias("when"))
    stretch = F.floor((F.col("at") / STRETCH_IDS) if by == "entry_id" else (_micros(F.col("at")) / STRETCH_MICROS))
    both = mine.unionByName(theirs).withColumn("stretch", stretch).withColumn("event", F.when(F.col("id").isNotNull(), F.struct("id", "when")))
    w = Window.partitionBy("actor", "stretch").orderBy(F.col("at").desc(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("near", F.min("event").over(w)).where(F.col("row").isNotNull()).select("actor", "stretch", "row", "near")
    later = Window.partitionBy("actor").orderBy(F.col("stretch").desc()).rowsBetween(Window.unboundedPreceding, -1)
    stretches = both.groupBy("actor", "stretch").agg(F.min("event").alias("first")).withColumn("far", F.min("first").over(later)).drop("first")
    found = found.join(stretches, ["actor", "stretch"]).withColumn("next", F.coalesce("near", "far")).where("next IS NOT NULL")
    return found.select("row.*", F.col("next.id").alias("closing_id"), F.col("next.when").alias("closing_at"))


def _root(events: DataFrame, seek: Seek) -> DataFrame:
    found = events
    for c in _condition(seek, _names(None, events, "")):
        found = found.where(c)
    caught = _captures(None, events, "")
    if not seek.many:
        return found.select("actor", F.array("entry_id").alias("levels"), F.array("entry_id").alias("chain"), F.col("entry_id").alias("node_id"), F.col("occurred_at").alias("node_at"), F.col("entry_id").alias("anchor_id"), F.col("occurred_at").alias("anchor_at"), *caught)
    return found.select(*_OWN, *caught)


def _fires_many(accumulated: DataFrame, key: list[str], n: int, stale: int | None) -> DataFrame:
    """accumulated: e_entry_id, e_occurred_at and key.  One row for each firing: the first n ids, the captures of the first."""
    w = Window.partitionBy(*key).orderBy("e_entry_id")
    rows = accumulated
    group = list(key)
    if stale is not None:  # an idle leaf is dropped and may start anew
        gap = F.col("e_entry_id") - F.lag("e_entry_id").over(w) > stale
        rows = rows.withColumn("__gap", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("__lap", F.sum("__gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        group.append("__lap")
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy("e_entry_id"))).where(F.col("__n") <= n)
    rest = [c for c in accumulated.columns if c not in key and not c.startswith("e_")]
    out = rows.groupBy(*group).agg(
        F.count("*").alias("__k"), F.sort_array(F.collect_list("e_entry_id")).alias("ids"), F.min("e_entry_id").alias("first_id"), F.max(F.struct("e_entry_id", "e_occurred_at")).alias("__last"),
        *[F.min_by(c, "e_entry_id").alias(c) for c in rest],
    )
    return out.where(F.col("__k") == n).select(*key, *rest, "ids", "first_id", F.col("__last.e_entry_id").alias("fired_id"), F.col("__last.e_occurred_at").alias("fired_at"))


def _accumulated_before(accumulated: DataFrame, pairs: DataFrame, key: list[str], n: int) -> DataFrame:
    """pairs of a many-node and a later event, with the node's ids up to that event (at least n), by one ordered window."""
    a = accumulated.select(*key, F.col("e_entry_id").alias("at"), F.lit(0).alias("kind"), F.col("e_entry_id").alias("id"), F.col("e_occurred_at").alias("when"), F.lit(None).cast(pairs.select(F.struct("*")).schema[0].dataType).alias("row"))
    b = pairs.select(*key, F.col("e_entry_id").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("timestamp_ntz").alias("when"), F.struct("*").alias("row"))
    w = Window.partitionBy(*key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("ids", F.collect_list("id").over(w)).withColumn("last", F.max(F.struct("id", "when")).over(w))
    found = found.where(F.col("row").isNotNull() & (F.size("ids") >= n))
    return found.select("row.*", "ids", F.col("last.id").alias("last_id"), F.col("last.when").alias("last_at"))


def _event(parents: DataFrame, events: DataFrame, joined: DataFrame) -> DataFrame:
    """joined pairs as nodes of the next level."""
    return joined.select(
        "actor", F.array_append("levels", F.col("e_entry_id")).alias("levels"), F.array_append("chain", F.col("e_entry_id")).alias("chain"),
        F.col("e_entry_id").alias("node_id"), F.col("e_occurred_at").alias("node_at"), F.col("e_entry_id").alias("anchor_id"), F.col("e_occurred_at").alias("anchor_at"),
        *_captures(parents, events, "e_"),
    )


_KEY = ["actor", "levels"]


def detect(spec: Reaction, journal: DataFrame) -> DataFrame:
    """All complete matches of spec."""
    spec.check()
    journal = with_actor(journal)
    seeks = spec.seeks
    events = [level(journal, s) for s in seeks]
    last = len(seeks) - 1
    nodes: DataFrame | None = None
    pending: tuple[DataFrame, int] | None = None  # what an open many-level accumulates, and how much it needs
    if seeks[0].many:
        root, empty = _root(events[0], seeks[0]), F.expr("cast(array() as array<bigint>)")
        acc = root.select("actor", empty.alias("levels"), empty.alias("chain"), F.col("entry_id").alias("e_entry_id"), F.col("occurred_at").alias("e_occurred_at"), *[c for c in root.columns if c.startswith("c_")])
        if last == 0:
            return _result(_many_leaf(acc, seeks[0], spec))
        pending = acc, seeks[0].at_least
        nodes = _many_nodes(acc)
    else:
        nodes = _root(events[0], seeks[0])
    for k in range(1, last + 1):
        seek, ev = seeks[k], events[k]
        if seek.exactly is not None:
            nodes = _exact(nodes, ev, seek, journal)
            pending = None
            if k == last and not seek.final:
                nodes = nodes.where(F.lit(False))
            continue
        if pending is not None:
            acc, n = pending
            pairs = _joined(nodes, ev, seek, how_anchor="")
            pairs = _accumulated_before(_keyed(acc), _keyed(pairs), ["__key"], n)
            if seek.entries is not None:
                pairs = pairs.where(F.col("e_entry_id") - F.col("last_id") <= seek.entries)
            if seek.time is not None:
                pairs = pairs.where(F.col("e_occurred_at") - F.col("last_at") <= F.lit(seek.time))
            pairs = pairs.withColumn("chain", F.concat("chain", "ids")).drop("__key")
            if seeks[k - 1].accumulate:
                pairs = pairs.withColumn(f"c_{seeks[k - 1].accumulate.lower()}", F.col("ids"))
            pending = None
        else:
            exclusive = "closing_id" not in nodes.columns
            pairs = _joined(nodes, ev, seek, first="node_id" if exclusive else "closing_id", inclusive=not exclusive)
        if seek.many:
            keep = [c for c in nodes.columns if c.startswith("c_")]
            new = {f"c_{c.lower()}" for c in ev.columns if c not in _OWN}
            acc = pairs.select("actor", "levels", "chain", "e_entry_id", "e_occurred_at", *[c for c in keep if c not in new], *[F.col("e_" + c).alias(f"c_{c.lower()}") for c in ev.columns if c not in _OWN])
            if k == last and spec.for_each:
                return _result(_coverage(nodes, acc, spec, seek, journal))
            if k == last:
                return _result(_many_leaf(acc, seek, spec))
            pending = acc, seek.at_least
            nodes = _many_nodes(acc)
        else:
            nodes = _event(nodes, ev, pairs)
    return _result(nodes)


def _keyed(df: DataFrame) -> DataFrame:
    """A many-node is its actor and the levels before it (pairs carry the node's own level already)."""
    own = F.col("levels") if "mark" not in df.columns else F.slice("levels", 1, F.size("levels") - 1)
    return df.withColumn("__key", F.struct("actor", own.alias("levels")))


def _many_nodes(acc: DataFrame) -> DataFrame:
    """One node for each parent: its first entry gives its place and its captures."""
    caught = [c for c in acc.columns if c.startswith("c_")]
    first = acc.groupBy("actor", "levels").agg(F.first("chain").alias("chain"), F.min(F.struct("e_entry_id", "e_occurred_at")).alias("__f"), *[F.min_by(c, "e_entry_id").alias(c) for c in caught])
    return first.select("actor", F.array_append("levels", F.col("__f.e_entry_id")).alias("levels"), "chain", F.col("__f.e_entry_id").alias("node_id"), F.col("__f.e_occurred_at").alias("node_at"), F.col("__f.e_entry_id").alias("anchor_id"), F.col("__f.e_occurred_at").alias("anchor_at"), *caught, F.lit(True).alias("mark"))


def _many_leaf(acc: DataFrame, seek: Seek, spec: Reaction) -> DataFrame:
    fired = _fires_many(acc, _KEY, seek.at_least, spec.stale_after)
    caught = [c for c in fired.columns if c.startswith("c_")]
    return fired.select("actor", F.array_append("levels", F.col("first_id")).alias("levels"), F.concat("chain", "ids").alias("chain"), F.col("fired_id").alias("node_id"), F.col("fired_at").alias("node_at"), *caught, *([F.col("ids").alias(f"c_{seek.accumulate.lower()}")] if seek.accumulate else []))


def _exact(nodes: DataFrame, ev: DataFrame, seek: Seek, journal: DataFrame) -> DataFrame:
    """Nodes with exactly n matches in the window, decided by the first entry behind it."""
    found = _joined(nodes.select("actor", "levels", "node_id", "node_at", "anchor_id", "anchor_at", *[c for c in nodes.columns if c.startswith("c_")]), ev, seek)
    counts = found.groupBy("actor", "levels").agg(F.count("*").alias("__k"), F.sort_array(F.collect_list("e_entry_id")).alias("__ids"), F.max(F.struct("e_entry_id", "e_occurred_at")).alias("__last"))
    if seek.exactly == 0:
        left = nodes.join(counts.select("actor", "levels"), _KEY, "left_anti").withColumn("__ids", F.expr("cast(array() as array<bigint>)"))
        left = left.withColumn("__first", F.element_at("levels", -1))
    else:
        left = nodes.join(counts.where(F.col("__k") == seek.exactly), _KEY).withColumn("__first", F.element_at("__ids", 1))
    if seek.entries is not None:
        closed = first_after(left, journal, F.col("anchor_id") + seek.entries)
    else:
        closed = first_after(left, journal, F.col("anchor_at") + F.lit(seek.time), by="occurred_at")
    ids = F.col("__ids")
    at = F.when(F.size(ids) > 0, F.col("__last.e_occurred_at")).otherwise(F.col("anchor_at")) if seek.exactly else F.col("anchor_at")
    last = F.when(F.size(ids) > 0, F.element_at(ids, -1)).otherwise(F.col("anchor_id")) if seek.exactly else F.col("anchor_id")
    return closed.select(
        "actor", F.array_append("levels", F.col("__first")).alias("levels"), F.concat("chain", ids).alias("chain"), F.col("closing_id").alias("node_id"), F.col("closing_at").alias("node_at"),
        last.alias("anchor_id"), at.alias("anchor_at"), *[c for c in nodes.columns if c.startswith("c_")], "closing_id",
    )


def obligations(nodes: DataFrame, spec: Reaction) -> DataFrame:
    """actor, anchor and a struct key for each distinct tuple of the product.  Zipped arrays must have equal lengths."""
    out = nodes
    for i, (names, arrays) in enumerate(spec.for_each.factors):
        if len(arrays) > 1:
            same = _all([F.size(f"c_{a}") == F.size(f"c_{arrays[0]}") for a in arrays[1:]])
            out = out.where(F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("zipped arrays differ in length")).cast("boolean")))
        out = out.withColumn(f"__z{i}", F.explode(F.arrays_zip(*[F.col(f"c_{a}").alias(n) for n, a in zip(names, arrays, strict=True)])))
    key = F.struct(*[F.col(f"__z{i}")[n].cast("string").alias(n) for i, (names, _) in enumerate(spec.for_each.factors) for n in names])
    return out.select("actor", F.element_at("levels", 1).alias("anchor"), key.alias("tuple")).distinct()


def _coverage(nodes: DataFrame, acc: DataFrame, spec: Reaction, seek: Seek, journal: DataFrame) -> DataFrame:
    """Anchors whose every tuple is met by an event of the closing leg: division by the product of their arrays.

    The first event of a tuple counts, for the oldest node that takes it; the node that takes the last tuple fires, with
    the events that it took."""
    names = [n for f, _ in spec.for_each.factors for n in f]
    key = F.struct(*[F.col(f"c_{n}").cast("string").alias(n) for n in names])
    met = acc.groupBy("actor", F.element_at("levels", 1).alias("anchor"), key.alias("tuple")).agg(F.min(F.struct("e_entry_id", "e_occurred_at", "levels")).alias("m"))
    judged = obligations(nodes, spec).join(met, ["actor", "anchor", "tuple"], "left").groupBy("actor", "anchor")
    judged = judged.agg(F.count("*").alias("all"), F.count("m").alias("done"), F.max("m").alias("last"), F.collect_list("m").alias("took"))
    mine = F.array_sort(F.array_distinct(F.transform(F.filter("took", lambda m: m["levels"] == F.col("last.levels")), lambda m: m["e_entry_id"])))
    done = judged.where(F.col("all") == F.col("done")).select("actor", F.col("last.levels").alias("levels"), mine.alias("ids"), F.col("last.e_entry_id").alias("fired_id"), F.col("last.e_occurred_at").alias("fired_at"))
    done = nodes.join(done, _KEY)
    if seek.aged:
        done = first_after(done, journal, F.col("fired_at") + F.lit(seek.aged), by="occurred_at", equal=True).withColumn("fired_id", F.col("closing_id")).withColumn("fired_at", F.col("closing_at"))
    return done.select("actor", F.array_append("levels", F.element_at("ids", 1)).alias("levels"), F.concat("chain", "ids").alias("chain"), F.col("fired_id").alias("node_id"), F.col("fired_at").alias("node_at"), *[c for c in nodes.columns if c.startswith("c_")])


def _result(nodes: DataFrame) -> DataFrame:
    caught = [F.col(c).alias(c[2:]) for c in nodes.columns if c.startswith("c_")]
    return nodes.select("actor", "levels", "chain", F.col("node_id").alias("trigger_entry_id"), F.col("node_at").alias("trigger_at"), *caught)


def bindings_digest(names: dict[str, Column]) -> Column:
    """First 8 bytes of SHA-256 over name|type|value; in order of names, as 16 hex digits."""
    parts = [F.concat(F.lit(f"{n}|"), F.typeof(c), F.lit("|"), F.coalesce(c.cast("string"), F.lit("<null>")), F.lit(";")) for n, c in sorted(names.items())]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 16)


def accept_increasing(matches: DataFrame, order: list[str], by: list[str] | None = None, seed: list[int] | None = None) -> DataFrame:
    """Matches whose level vector is greater than every one detected before (and than seed): the elision rule."""
    w = Window.partitionBy(*(by or ["actor"])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max("levels").over(w)
    passed = before.isNull() | (F.col("levels") > before)
    if seed is not None:
        passed = passed & (F.col("levels") > F.array(*[F.lit(x).cast("long") for x in seed]))
    return matches.withColumn("__ok", passed).where("__ok").drop("__ok")
