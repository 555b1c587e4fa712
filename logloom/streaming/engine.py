"""Sequence detection entry by entry: the same specification as the batch planner, as a fold over one actor's stream.

A Matcher holds open partial matches and takes entries in ascending order.  It serves the stateful streaming operator
(its state is plain data, so it can be stored and restored) and, in tests, checks the batch planner.

For each entry: exact windows that it closes, coverage that has settled, then the levels in order.  A regular node tries
every later entry; a many-node takes all its entries and goes on once; an exact node is decided by the first entry behind
its window.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timedelta
from decimal import Decimal

from logloom.lang import patterns as P
from logloom.lang import syntax as S
from logloom.lang.facts import text_of
from logloom.lang.values import binary as _binary
from logloom.lang.values import cast as _cast
from logloom.lang.values import typed
from logloom.plans.reaction import Reaction

_NUMBERS = ("int", "long", "double", "decimal")


# Expressions over plain values
def evaluate(e, names: dict[str, object]):
    """The value of an expression; names are in lower case, times are datetime and timedelta."""
    match e:
        case S.Lit(value, _):
            return value
        case S.Name(name):
            return names[name.lower()]
        case S.Unary("!", a):
            return not evaluate(a, names)
        case S.Unary(op, a):
            return -evaluate(a, names) if op == "-" else evaluate(a, names)
        case S.Ternary(t, a, b):
            return evaluate(a if evaluate(t, names) else b, names)
        case S.Binary("&&", a, b):
            return bool(evaluate(a, names)) and bool(evaluate(b, names))
        case S.Binary("||", a, b):
            return bool(evaluate(a, names)) or bool(evaluate(b, names))
        case S.Binary(op, a, b):
            return _binary(op, evaluate(a, names), evaluate(b, names))
        case S.Cast(kind, a):
            return _cast(kind, evaluate(a, names))
        case S.ListOf(items):
            return [evaluate(x, names) for x in items]
        case S.Index(base, keys):
            out = evaluate(base, names)
            for k in keys:
                out = out[evaluate(k, names)]
            return out
        case S.Access(S.Name(base), member, args) if base.lower() in ("time", "seek"):
            if base.lower() == "seek":
                return names[f"seek.{member.lower()}"]
            return timedelta(**{member.lower(): evaluate(args[0], names)})
        case S.Access(base, member, None) if member.lower() == "count":
            return len(evaluate(base, names))
    raise TypeError(f"cannot evaluate {e}")


# Patterns over a list of facts
def _is_type(arg: dict, kind: str) -> bool:
    rank = {"int": 0, "long": 1, "double": 2, "decimal": 3}
    have, want = (arg["type"] or "").lower(), kind.lower()
    return want in ("object", have) or (have in rank and want in rank and rank[have] < rank[want])


def _param_fits(arg: dict, p: P.Param, fact: dict, facts: list[dict]) -> bool:
    if p.type and not _is_type(arg, p.type):
        return False
    match p.kind:
        case "literal":
            lit = p.value
            if arg["is_out"]:
                return False
            if lit.type == "null":
                return (arg["type"] or "").lower() == "null" and arg["value"] is None
            if lit.type in _NUMBERS:
                return arg["type"] in _NUMBERS and arg["value"] is not None and Decimal(arg["value"]) == Decimal(str(lit.value))
            return arg["type"] == lit.type and arg["value"] == text_of(lit.value)
        case "list":
            return arg["value"] == "{" + ",".join(text_of(x.value) or "null" for x in p.value) + "}"
        case "name":
            return arg["var_name"] is not None or arg["type"] == "string"
        case "nested":
            return any(f["pos"] > fact["pos"] and fits(f, p.value, facts) for f in facts)
    return True


def fits(f: dict, e: P.Element, facts: list[dict]) -> bool:
    """Whether a fact fits an element."""
    if e.type and e.type.lower() not in f["supertypes"]:
        return False
    match e.kind:
        case "type":
            return f["node"] in ("call", "access")
        case "ctor":
            return f["node"] == "ctor" and len(f["args"]) == len(e.params) and all(_param_fits(a, P.Param("literal" if p.kind == "literal" else "any", p.value, p.type), f, facts) for a, p in zip(f["args"], e.params, strict=True))
        case "assign":
            if f["node"] != "assign" or (e.name and not e.name.startswith("$") and f["receiver"] is None):
                return False
            if isinstance(e.value, P.Param):
                return _param_fits(f["args"][0], e.value, f, facts)
            return (f["args"][0]["type"] or "").lower() == e.value.type.lower() and any(g["pos"] < f["pos"] and fits(g, e.value, facts) for g in facts)
        case "tell":
            wanted = (*e.params, *([e.ident] if e.ident else []))
            return f["node"] == "tell" and f["member"] == e.command and len(f["args"]) >= len(wanted) and all(_param_fits(a, p, f, facts) for a, p in zip(f["args"], wanted, strict=False))
        case "ack":
            return f["node"] == "ack" and _param_fits(f["args"][0], e.ident, f, facts)
    member, params = e.path[0]
    if params is None:
        ok = f["node"] == "access" and (f["member"] or "").lower() == member.lower() and (e.name in (None, "_") or (f["receiver"] or "").lower() == e.name.lower())
    else:
        ok = f["node"] == "call" and f["member"] == member and (e.name in (None, "_") or f["receiver"] is not None)
        ok = ok and len(f["args"]) == len(params) and all(_param_fits(a, p, f, facts) for a, p in zip(f["args"], params, strict=True))
    return ok and all(any(g["pos"] >= f["pos"] + k and g["receiver"] is None and g["member"] == m for g in facts) for k, (m, _) in enumerate(e.path[1:], 1))


def _guard(g: P.Guard, got: dict) -> bool:
    v, lit = got.get(g.name.lower()), g.value
    if lit.type == "null":
        return (v is None) == (g.op == "==")
    if v is None:
        return False
    a, b = (Decimal(str(v)), Decimal(str(lit.value))) if lit.type in _NUMBERS else (v, lit.value)
    return bool(_binary(g.op, a, b))


def _caught(fact: dict, e: P.Element, facts: list[dict]) -> dict[str, object]:
    """What an element takes from the fact that it fits."""
    got: dict[str, object] = {}
    params = {"member": e.path[0][1] if e.path else None, "tell": (*(e.params or ()), *([e.ident] if e.ident else [])), "ack": (e.ident,)}.get(e.kind) or ()
    if e.kind == "member" and e.name not in (None, "_") and e.path[0][1] is not None:
        got[e.name.lower()] = fact["receiver"]
    if e.kind == "assign" and e.name:
        value = fact["args"][0]["value"] if e.name.startswith("$") else None
        got[e.name.removeprefix("$").lower()] = fact["receiver"] if value is None else value
    for a, p in zip(fact["args"], params, strict=False):
        if p.kind == "nested":
            got |= _caught(next(f for f in facts if f["pos"] > fact["pos"] and fits(f, p.value, facts)), p.value, facts)
        elif p.kind in ("capture", "name"):
            got[p.value.lower()] = a["var_name"] if p.kind == "name" else a["value"] if a["value"] is not None else a["var_name"]
    return got


def _exposed(e: P.Element, expose: str | None) -> dict[str, object] | None:
    """What an expose element takes from exposed JSON, or None if it does not fit."""
    p = e.params[0]
    value = (json.loads(expose) if expose else {}).get(e.alias)
    if value is None:
        return None
    shown = text_of(value) if not isinstance(value, dict | list) else json.dumps(value)
    if p.kind == "literal" and not (Decimal(shown) == Decimal(str(p.value.value)) if p.value.type in _NUMBERS else shown == text_of(p.value.value)):
        return None
    try:
        typed(p.type, shown)
    except (ArithmeticError, ValueError):
        return None
    return {p.value.lower(): shown} if p.kind == "capture" else {}


def capture(pattern: P.Pattern, entry: dict) -> dict[str, object] | None:
    """Captured values of the first branch that an entry (calls, and expose and script if it has them) matches, or None."""
    kinds, facts = P.captures(pattern), entry["calls"]
    for b in pattern.branches:
        last, got, ok = -1, {}, True
        for e in b.elements:
            if e.kind == "expose":
                more = _exposed(e, entry.get("expose"))
            else:
                anywhere = e.kind in ("ctor", "assign")
                found = next((f for f in facts if (anywhere or f["pos"] > last) and fits(f, e, facts)), None)
                more = None if found is None else _caught(found, e, facts)
                last = last if anywhere or found is None else found["pos"]
            if more is None:
                ok = False
                break
            got |= more
        if ok:
            out = {n: typed(t, got.get(n)) for n, t in kinds.items()}
            if any(x.label for x in pattern.branches):
                out["_matchedbranch"] = b.label
            held = lambda g: (g.value in (entry.get("script") or "")) == (g.op == "contains")
            return out if all(_guard(g, out) if g.name else held(g) for g in pattern.guards) else None
    return None


class Level:
    """What a seek asks of an entry: patterns, or a function from an entry to captures (None: no match)."""

    def __init__(self, seek, finder: Callable[[dict], dict | None] | None = None):
        self.seek, self.finder = seek, finder
        self.patterns = [P.parse_pattern(p) for p in seek.patterns]
        self.same = {n for p in self.patterns for n in P.unifying(p)}
        self.where = S.parse_expression(seek.where) if seek.where else None

    def find(self, entry: dict) -> dict | None:
        if self.finder:
            return self.finder(entry)
        out: dict = {}
        for p in self.patterns:
            if (got := capture(p, entry)) is None:
                return None
            out |= {k: v for k, v in got.items() if k not in out}
        return out


class Matcher:
    """One actor's open matches.  take() gives the matches that an entry completes."""

    def __init__(self, spec: Reaction, finders: list[Callable | None] | None = None):
        spec.check()
        self.spec = spec
        self.levels = [Level(s, f) for s, f in zip(spec.seeks, finders or [None] * len(spec.seeks), strict=True)]
        self.nodes: list[dict] = []
        self.last_id = 0

    # State is a list of plain dicts; keys: level, parent (number), id, at, ids, last, caught, fired, open, count, left
    def state(self) -> dict:
        return {"nodes": self.nodes, "last_id": self.last_id}

    def restore(self, state: dict) -> Matcher:
        self.nodes, self.last_id = state["nodes"], state["last_id"]
        return self

    def _new(self, level: int, parent: int | None, entry_id: int, at, ids: list[int], caught: dict) -> dict:
        node = {"level": level, "parent": parent, "id": entry_id, "at": at, "ids": ids, "last": at, "caught": caught, "fired": False, "open": True, "left": None, "settle": None, "seen": entry_id}
        self.nodes.append(node)
        if self.spec.for_each and parent is None:
            node["left"] = self._product(caught)
        nxt = level + 1
        if nxt < len(self.levels) and self.levels[nxt].seek.exactly is not None:
            me = len(self.nodes) - 1
            self.nodes.append({"level": nxt, "parent": me, "id": 0, "at": at, "ids": [], "last": at, "caught": caught, "fired": False, "open": False, "left": None, "settle": None, "seen": entry_id, "exact": "waits"})
        return node

    def _product(self, caught: dict) -> list:
        out: list[dict] = [{}]
        for names, arrays in self.spec.for_each.factors:
            columns = [caught[a] for a in arrays]
            if len({len(c) for c in columns}) > 1:
                raise ValueError("zipped arrays differ in length")
            out = [{**o, **dict(zip(names, row, strict=True))} for o in out for row in zip(*columns, strict=True)]
        seen: list = []
        for o in out:
            if o not in seen:
                seen.append(o)
        return seen

    def _window(self, level: Level, node: dict, entry: dict) -> bool:
        anchor_id = node["ids"][-1] if node["ids"] else node["id"]
        s = level.seek
        return (s.entries is None or entry["entry_id"] - anchor_id <= s.entries) and (s.time is None or entry["occurred_at"] - node["last"] <= s.time)

    def _passes(self, level: Level, got: dict, entry: dict, node: dict | None) -> bool:
        names = dict(node["caught"]) if node else {}
        if node and any(str(names[n]).lower() != str(got[n]).lower() for n in level.same if n in names):
            return False
        names |= got
        names |= {"@now": entry["occurred_at"], "now": entry["occurred_at"], "@entryid": entry["entry_id"]}
        if node:
            names |= {"seek.@now": node["at"], "seek.@entryid": node["id"]}
        return level.where is None or bool(evaluate(level.where, names))

    def _chain(self, node: dict) -> tuple[list[int], list[int]]:
        levels, chain, at = [], [], node
        while at is not None:
            first = at["ids"][0] if at["ids"] else at["id"]
            parent = self.nodes[at["parent"]] if at["parent"] is not None else None
            if "exact" in at and not at["ids"]:
                first = self._chain(parent)[0][-1]
            levels.insert(0, first)
            chain[:0] = at["ids"] or ([at["id"]] if "exact" not in at else [])
            at = parent
        return levels, chain

    def _fire(self, node: dict, entry: dict, out: list[dict]) -> None:
        node["fired"] = True
        levels, chain = self._chain(node)
        out.append({"levels": levels, "chain": chain, "trigger_entry_id": entry["entry_id"], "trigger_at": entry["occurred_at"], **node["caught"]})

    def take(self, entry: dict) -> list[dict]:
        """entry: entry_id, occurred_at and what the levels look at.  Entries not behind the last one are ignored."""
        if entry["entry_id"] <= self.last_id:
            return []
        out: list[dict] = []
        last = len(self.levels) - 1
        eid, at = entry["entry_id"], entry["occurred_at"]
        for node in list(self.nodes):
            if node.get("exact") == "waits":
                s = self.levels[node["level"]].seek
                parent = self.nodes[node["parent"]]
                anchor_id, anchor_at = (parent["ids"][-1] if parent["ids"] else parent["id"]), parent["last"]
                if (s.entries is not None and eid > anchor_id + s.entries) or (s.time is not None and at - anchor_at > s.time):
                    node["exact"] = "ok" if len(node["ids"]) == s.exactly else "failed"
                    if node["exact"] == "ok":
                        node["open"], node["closing"] = True, eid
                        if not node["ids"]:  # an empty one goes on from its parent
                            node["anchor"], node["last"], node["id"] = anchor_id, anchor_at, anchor_id
                        if node["level"] == last and s.final:
                            self._fire(node, entry, out)
            if node["settle"] is not None and not node["fired"] and at - node["last"] >= self.levels[last].seek.aged:
                self._fire(node, entry, out)
        for k, level in enumerate(self.levels):
            got = level.find(entry)
            if got is None:
                continue
            if k == 0:
                if self._passes(level, got, entry, None):
                    self._grow(None, k, level, entry, got, out, last)
                continue
            for n, node in enumerate(list(self.nodes)):
                if node["level"] == k - 1 and node["open"]:
                    first = node["ids"][0] if node["ids"] and "exact" not in node else node["id"]
                    if "exact" in node:
                        if eid < node["closing"]:
                            continue
                    elif eid <= first:
                        continue
                    if self.levels[k - 1].seek.many and len(node["ids"]) < self.levels[k - 1].seek.at_least:
                        continue
                    if self._window(level, node, entry) and self._passes(level, got, entry, node):
                        self._grow(n, k, level, entry, got, out, last)
        self.last_id = eid
        return out

    def _grow(self, parent: int | None, k: int, level: Level, entry: dict, got: dict, out: list[dict], last: int) -> None:
        eid, at, s = entry["entry_id"], entry["occurred_at"], level.seek
        above = self.nodes[parent]["caught"] if parent is not None else {}
        if s.exactly is not None:
            node = next(n for n in self.nodes if n["parent"] == parent and n.get("exact"))
            if node["exact"] == "waits":
                node["ids"].append(eid)
                node["last"] = at
            return
        if not s.many:
            node = self._new(k, parent, eid, at, [], above | got)
            if k == last:
                self._fire(node, entry, out)
                self.nodes = self.nodes[:-1] if self.nodes[-1] is node else self.nodes
            return
        anchor = None
        if self.spec.for_each and k == last:
            p = parent
            while p is not None and self.nodes[p]["left"] is None:
                p = self.nodes[p]["parent"]
            anchor = self.nodes[p] if p is not None else None
        if anchor is not None:
            key = {n: (above | got)[n] for names, _ in self.spec.for_each.factors for n in names}
            if key not in anchor["left"]:
                return
        stale = self.spec.stale_after
        node = next((n for n in self.nodes if n["level"] == k and n["parent"] == parent and n["open"]), None)
        if node is not None and k == last and stale is not None and not self.spec.for_each and eid - node["seen"] > stale:
            node["open"] = False
            node = None
        if node is None:
            node = self._new(k, parent, eid, at, [], above | got)
        node["ids"].append(eid)
        node["last"], node["seen"] = at, eid
        if anchor is not None:
            anchor["left"].remove(key)
            if not anchor["left"]:
                if s.aged:
                    node["settle"] = True
                else:
                    self._fire(node, entry, out)
        elif k == last and not node["fired"] and len(node["ids"]) == s.at_least:
            self._fire(node, entry, out)
