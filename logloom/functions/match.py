"""Patterns as columns over the array of an entry's facts.

Matching is greedy: each element takes the first fact behind the last one taken that fits, without backtracking; only
OR branches are tried in turn.  Every step is one higher-order function over the array, so no fact is joined or exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.expr import SPARK
from logloom.lang import patterns as P
from logloom.lang import syntax as S
from logloom.lang.facts import text_of

_NUMERIC = ("int", "long", "double", "decimal")
#: Types that a value of the first is accepted for.
_WIDER = {"int": ["long", "double", "decimal"], "long": ["double", "decimal"], "double": ["decimal"]}


def _is_type(arg: Column, kind: str) -> Column:
    if kind.lower() == "object":
        return F.lit(True)
    fits = [kind.lower(), *(k for k, up in _WIDER.items() if kind.lower() in up)]
    return F.coalesce(F.lower(arg["type"]).isin(fits), F.lit(False))


def _equals(arg: Column, lit: S.Lit) -> Column:
    if lit.type == "null":
        return (F.lower(arg["type"]) == "null") & arg["value"].isNull()
    if lit.type in _NUMERIC:
        return arg["type"].isin(*_NUMERIC) & (arg["value"].try_cast("decimal(38,10)") == F.lit(str(lit.value)).cast("decimal(38,10)"))
    return (arg["type"] == lit.type) & (arg["value"] == F.lit(text_of(lit.value)))


def _no(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _param(arg: Column, p: P.Param, fact: Column, facts: Column) -> Column:
    match p.kind:
        case "literal":
            ok = _equals(arg, p.value) & ~F.coalesce(arg["is_out"], F.lit(False))
        case "list":
            ok = arg["value"] == F.lit("{" + ",".join(text_of(x.value) or "null" for x in p.value) + "}")
        case "name":  # a script variable, or an unbound plain string
            ok = arg["var_name"].isNotNull() | (arg["type"] == "string")
        case "nested":
            ok = F.exists(facts, lambda d: (d["pos"] > fact["pos"]) & _fact(d, p.value, facts))
        case _:
            ok = F.lit(True)
    return _no(ok & _is_type(arg, p.type)) if p.type else _no(ok)


def _params(args: Column, params: tuple | None, fact: Column, facts: Column, types_only: bool = False) -> Column:
    if params is None:
        return F.lit(True)
    ok = F.size(args) == len(params)
    for i, p in enumerate(params):
        if types_only:
            p = P.Param("literal" if p.kind == "literal" else "any", p.value, p.type)
        ok = ok & _param(F.get(args, F.lit(i)), p, fact, facts)
    return _no(ok)


def _fact(c: Column, e: P.Element, facts: Column) -> Column:
    """Whether fact c fits element e."""
    typed = _no(F.array_contains(c["supertypes"], (e.type or "").lower())) if e.type else F.lit(True)
    match e.kind:
        case "type":
            return typed & c["node"].isin("call", "access")
        case "ctor":
            return typed & (c["node"] == "ctor") & _params(c["args"], e.params, c, facts, types_only=True)
        case "assign":
            ok = (c["node"] == "assign") & typed
            if e.name and not e.name.startswith("$"):
                ok = ok & c["receiver"].isNotNull()
            v = e.value
            if isinstance(v, P.Param):
                return _no(ok & _param(F.get(c["args"], F.lit(0)), v, c, facts))
            return _no(ok & (F.lower(F.get(c["args"], F.lit(0))["type"]) == v.type.lower()) & F.exists(facts, lambda d: (d["pos"] < c["pos"]) & _fact(d, v, facts)))
        case "tell":
            wanted = (*e.params, *([e.ident] if e.ident else []))
            enough = F.size(c["args"]) >= len(wanted)
            ok = (c["node"] == "tell") & typed & (c["member"] == e.command) & enough
            for i, p in enumerate(wanted):
                ok = ok & _param(F.get(c["args"], F.lit(i)), p, c, facts)
            return _no(ok)
        case "ack":
            return _no((c["node"] == "ack") & typed & _param(F.get(c["args"], F.lit(0)), e.ident, c, facts))
    member, params = e.path[0]
    named = F.lit(True)
    if params is None:
        ok = (c["node"] == "access") & (F.lower(c["member"]) == member.lower())
        if e.name not in (None, "_"):
            named = F.lower(c["receiver"]) == e.name.lower()
    else:
        ok = (c["node"] == "call") & (c["member"] == member)
        if e.name not in (None, "_"):
            named = c["receiver"].isNotNull()
    ok = ok & typed & named & _params(c["args"], params, c, facts)
    for step, (more, more_params) in enumerate(e.path[1:], 1):  # later members of a chain have no named receiver
        ok = ok & F.exists(facts, _link(c, step, more, more_params, facts))
    return _no(ok)


def _link(c: Column, step: int, member: str, params: tuple | None, facts: Column):
    return lambda d: (d["pos"] >= c["pos"] + step) & d["receiver"].isNull() & (d["member"] == member) & _params(d["args"], params, d, facts)


def _fits(e: P.Element, last: Column | None, facts: Column):
    """A predicate on facts: behind last (if there is one) and fitting e."""
    return lambda c: _fact(c, e, facts) if last is None else (c["pos"] > last) & _fact(c, e, facts)


def _taken(fact: Column, p: P.Param, i: int, facts: Column) -> dict[str, Column]:
    arg = F.get(fact["args"], F.lit(i))
    if p.kind == "nested":
        return _element_captures(F.get(F.filter(facts, _fits(p.value, fact["pos"], facts)), F.lit(0)), p.value, facts)
    if p.kind == "capture":
        return {p.value.lower(): F.coalesce(arg["value"], arg["var_name"])}
    if p.kind == "name":
        return {p.value.lower(): arg["var_name"]}
    return {}


def _element_captures(fact: Column, e: P.Element, facts: Column) -> dict[str, Column]:
    out: dict[str, Column] = {}
    if e.kind == "member":
        params = e.path[0][1]
        if e.name not in (None, "_") and params is not None:
            out[e.name.lower()] = fact["receiver"]
        for i, p in enumerate(params or ()):
            out |= _taken(fact, p, i, facts)
    elif e.kind == "assign" and e.name:
        out[e.name.removeprefix("$").lower()] = F.coalesce(F.get(fact["args"], F.lit(0))["value"], fact["receiver"]) if e.name.startswith("$") else fact["receiver"]
    elif e.kind in ("tell", "ack"):
        for i, p in enumerate((*(e.params or ()), *([e.ident] if e.ident else [])) if e.kind == "tell" else (e.ident,)):
            out |= _taken(fact, p, i, facts)
    return out


def _only_members(pattern: P.Pattern) -> list[str] | None:
    """Members that an entry's only fact must have one of, if every branch asks for method calls."""
    out: set[str] = set()
    for b in pattern.branches:
        calls = {e.path[0][0] for e in b.elements if e.kind == "member" and e.path[0][1] is not None}
        if not calls:
            return None
        out |= calls
    return sorted(out)


def match(df: DataFrame, pattern: P.Pattern | str, facts: str = "calls", expose: str = "expose", script: str = "script", only: str = "member") -> DataFrame:
    """Rows of df that match, with a column for each captured name ($v:T has type T, others are strings) and, where the
    pattern has labels, _matchedbranch.

    only: a column that, where df has it, names the member of an entry's single fact; entries that cannot match are
    then filtered by it, which a file scan takes as a pushed filter."""
    pattern = P.parse_pattern(pattern) if isinstance(pattern, str) else pattern
    if only in df.columns and (members := _only_members(pattern)):
        df = df.where(F.col(only).isin(members))
    wanted = P.captures(pattern)
    own, work, branches = df.columns, df, []
    labelled = any(b.label for b in pattern.branches)
    for k, b in enumerate(pattern.branches):
        last, ok, caught = F.lit(-1), F.lit(True), {}
        for i, e in enumerate(b.elements):
            if e.kind == "expose":
                p, value = e.params[0], F.get_json_object(F.col(expose), f"$.{e.alias}")
                ok = ok & value.isNotNull()
                if p.kind == "literal":
                    ok = ok & _no(value.try_cast("decimal(38,10)") == F.lit(str(p.value.value)).cast("decimal(38,10)") if p.value.type in _NUMERIC else value == text_of(p.value.value))
                if p.type:
                    ok = ok & value.try_cast(SPARK.get(p.type.lower(), "string")).isNotNull()
                if p.kind == "capture":
                    caught[p.value.lower()] = value
                continue
            name = f"__m{k}_{i}"
            fits = _fits(e, last if e.kind not in ("assign", "ctor") else None, F.col(facts))
            work = work.withColumn(name, F.get(F.filter(F.col(facts), fits), F.lit(0)))
            ok = ok & F.col(name).isNotNull()
            if e.kind not in ("assign", "ctor"):
                last = F.col(name)["pos"]
            caught |= _element_captures(F.col(name), e, F.col(facts))
        row = [ok.alias("ok"), *((caught[n] if n in caught else F.lit(None)).cast("string").alias(n) for n in wanted), F.lit(b.label).cast("string").alias("_matchedbranch")]
        work = work.withColumn(f"__b{k}", F.struct(*row))
        branches.append(F.when(F.col(f"__b{k}.ok"), F.col(f"__b{k}")))
    work = work.withColumn("__found", F.coalesce(*branches)).where(F.col("__found").isNotNull())
    kept = [F.col(f"`{c}`") for c in own if c.lower() not in wanted]
    out = work.select(*kept, *(F.col("__found")[n].cast(SPARK.get((t or "string").lower(), "string")).alias(n) for n, t in wanted.items()), *([F.col("__found._matchedbranch").alias("_matchedbranch")] if labelled else []))
    for g in pattern.guards:
        out = out.where(_guard(out, g, script))
    return out


def _guard(df: DataFrame, g: P.Guard, script: str) -> Column:
    if g.name is None:
        held = _no(F.contains(F.col(script), F.lit(g.value)))
        return ~held if g.op.startswith("not") else held
    col = F.col(g.name.lower())
    if g.value.type in _NUMERIC:
        col, value = col.try_cast("decimal(38,10)"), F.lit(str(g.value.value)).cast("decimal(38,10)")
    elif g.value.type == "null":
        return col.isNull() if g.op == "==" else col.isNotNull()
    else:
        value = F.lit(text_of(g.value.value))
        if g.op not in ("==", "!="):
            raise S.SyntaxFault("strings have no order")
        col = col.cast("string")
    return _no({"==": col == value, "!=": col != value, "<": col < value, "<=": col <= value, ">": col > value, ">=": col >= value}[g.op])


def prefilter(script: Column, words: list[str]) -> Column:
    """A cheap necessary condition before a script is parsed: the words occur in this order, whatever their case."""
    return F.lower(script).rlike("(?s)" + ".*".join(_quoted(w.lower()) for w in words)) if words else F.lit(True)


def _quoted(w: str) -> str:
    return "".join("\\" + c if c in r"\.^$*+?()[]{}|" else c for c in w)
