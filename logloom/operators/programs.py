"""Journals of scripts, run: state by replay, documents and diagnostics of each entry, introspection of the state.

Entries are dealt by actor, sorted by entry_id and streamed, so a task holds the state of one actor at a time.  Scripts that
were seen before are not parsed again (a bounded memory).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parsed scripts that a task remembers.
PARSED = 1 << 14
_ENTRY = "actor string, entry_id long, document string, exposed string, diagnostics array<struct<severity:string,message:string>>, error string"
_SYMBOL = "actor string, symbol string, static_type string, runtime_type string, value string"


def _stream(journal: DataFrame, classes, functions, setup, notation, emit: str, schema: str) -> DataFrame:
    """journal: actor, entry_id, occurred_at, script; a DEFINE's script is its definition; an INVOCATION has action_id and
    arguments (literals with commas between) instead."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    from logloom.lang import interpret as I
    from logloom.lang import syntax as S
    from logloom.lang.values import shown, type_name

    target = to_arrow_schema(_parse_datatype_string(schema))
    optional = [F.col(c) if c in journal.columns else F.lit(None).cast(k).alias(c) for c, k in (("action_id", "int"), ("arguments", "string"), ("define_text", "string"))]
    needed = journal.select(F.col("actor").cast("string").alias("actor"), "entry_id", "occurred_at", "script", *optional)

    def run(batches):
        parsed: dict[str, list] = {}
        rows, now, machine = [], None, None

        def program(text: str):
            if text not in parsed:
                if len(parsed) > PARSED:
                    parsed.clear()
                parsed[text] = S.parse_program(notation(text) if notation else text)
            return parsed[text]

        def one(script, action, arguments, define, at):
            try:
                if define is not None or script is not None:
                    return machine.run(program(define if define is not None else script), at)
                given = S.parse_expression("{" + (arguments or "") + "}")
                return machine.invoke(action, [machine.value(x) for x in given.items], at)
            except S.SyntaxFault as e:
                return I.Outcome(error=f"SyntaxFault: {e}")

        def symbols():
            return [(now, machine.spelling[k], machine.types[k], type_name(v), I.document_json(v) if isinstance(v, list) else shown(v)) for k, v in sorted(machine.symbols.items())]

        def flush():
            return pa.RecordBatch.from_pylist([dict(zip(target.names, r, strict=True)) for r in rows], schema=target)

        for b in batches:
            for actor, entry, at, script, action, arguments, define in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if machine is None or actor != now:
                    if machine is not None and emit == "symbols":
                        rows += symbols()
                    now, machine = actor, I.Machine(classes, functions)
                    if setup:
                        machine.run(program(setup), at)
                done = one(script, action, arguments, define, at)
                if emit == "entries":
                    found = [{"severity": s, "message": m} for s, m in done.diagnostics]
                    rows.append((actor, entry, I.document_json(done.document), I.document_json(done.exposed) if done.exposed else None, found, done.error))
                if len(rows) > 5000:
                    yield flush()
                    rows = []
        if machine is not None and emit == "symbols":
            rows += symbols()
        yield flush()

    return needed.repartition("actor").sortWithinPartitions("actor", "entry_id").mapInArrow(run, schema)


def run_entries(journal: DataFrame, classes: dict[str, type] | None = None, functions: dict[str, Callable] | None = None, setup: str = "", notation: Callable[[str], str] | None = None) -> DataFrame:
    """actor, entry_id, document (JSON of what the entry prints), exposed (JSON or null), diagnostics, error: a row for each
    entry, run on the state that the entries before it left.  setup: a program that each actor runs first.  notation: turns what
    entries are written in into the script language."""
    return _stream(journal, classes, functions, setup, notation, "entries", _ENTRY)


def show_symbols(journal: DataFrame, classes: dict[str, type] | None = None, functions: dict[str, Callable] | None = None, setup: str = "", notation: Callable[[str], str] | None = None) -> DataFrame:
    """The globals of each actor after replay: actor, symbol, static_type (of its first value), runtime_type, value."""
    return _stream(journal, classes, functions, setup, notation, "symbols", _SYMBOL)


def canonical(rows: DataFrame, column: str, name: str = "canonical") -> DataFrame:
    """rows with the canonical text of a script column, null where it is no text of the language.  Each distinct text is read once."""
    import pyarrow as pa

    from logloom.lang import syntax as S

    def one(text: str) -> str | None:
        try:
            S.parse_program(text)
            return S.canonical(text)
        except S.SyntaxFault:
            return None

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(t) for t in b.column(0).to_pylist()], pa.string())], ["__text", name])

    found = rows.select(F.col(column).alias("__text")).where(F.col(column).isNotNull()).distinct().mapInArrow(run, f"__text string, `{name}` string")
    return rows.join(found, rows[column] == found["__text"], "left").drop("__text")


# Introspection
def show_entry(journal: DataFrame, entry_id: int) -> DataFrame:
    """One entry with its kind and the fields of that kind; no row if it is not there."""
    from logloom.operators.journal import classify

    found = classify(journal.where(F.col("entry_id") == entry_id))
    fields = {c: F.col(c) for c in ("script", "action_id", "arguments", "define_text") if c in journal.columns}
    return found.select("entry_id", "kind", F.col("occurred_at").alias("at"), *fields.values(), *[c for c in ("expose",) if c in journal.columns])


def show_actions(journal: DataFrame, action_id: int | None = None) -> DataFrame:
    """The definition of each action that holds now (the one with the greatest entry_id): action_id, define_entry_id, at, define."""
    some = journal.where(F.col("define_text").isNotNull() & F.col("action_id").isNotNull())
    some = some if action_id is None else some.where(F.col("action_id") == action_id)
    last = F.max(F.struct("entry_id", "occurred_at", "define_text")).alias("d")
    return some.groupBy("action_id").agg(last).select("action_id", F.col("d.entry_id").alias("define_entry_id"), F.col("d.occurred_at").alias("at"), F.col("d.define_text").alias("define"))


def show_class(journal: DataFrame, name: str | None = None) -> DataFrame:
    """What scripts use of each class (from facts): class, node, member, arity, n.  name: of that class only, whatever the case."""
    calls = journal.select(F.explode("calls").alias("f")).where("f.receiver_type IS NOT NULL")
    calls = calls if name is None else calls.where(F.lower("f.receiver_type") == name.lower())
    return calls.groupBy(F.col("f.receiver_type").alias("class"), F.col("f.node").alias("node"), F.col("f.member").alias("member"), F.size("f.args").alias("arity")).agg(F.count("*").alias("n"))


def show_reactions(registry: DataFrame, checkpoints: DataFrame, fired: DataFrame) -> DataFrame:
    """reaction_id, match_count, seeks (level, detected, confirmed): a row for each registered reaction; one that never ran has none."""
    levels = checkpoints.groupBy("reaction_id").agg(F.array_sort(F.collect_list(F.struct("seek_level", "detected", "confirmed"))).alias("seeks"))
    counts = fired.groupBy("reaction_id").agg(F.count("*").alias("match_count"))
    out = registry.select("reaction_id").join(counts, "reaction_id", "left").join(levels, "reaction_id", "left")
    none = F.array().cast("array<struct<seek_level:int,detected:bigint,confirmed:bigint>>")
    return out.select("reaction_id", F.coalesce("match_count", F.lit(0)).alias("match_count"), F.coalesce(F.col("seeks").cast("array<struct<seek_level:int,detected:bigint,confirmed:bigint>>"), none).alias("seeks"))


def parameter_pools(journal: DataFrame) -> DataFrame:
    """How often each literal stands at each place of a call: class, member, at, type, value, n."""
    calls = journal.select(F.explode("calls").alias("f")).where("f.node = 'call'")
    each = calls.select(F.col("f.receiver_type").alias("class"), F.col("f.member").alias("member"), F.posexplode("f.args").alias("at", "a"))
    return each.where("a.value IS NOT NULL").groupBy("class", "member", "at", F.col("a.type").alias("type"), F.col("a.value").alias("value")).agg(F.count("*").alias("n"))
