"""Query programs as columns: print, if, for, blocks, assignment, check, notify and eval compiled over the columns of a DataFrame.

A row is one run of the program.  An assignment is a new column under its name; in a branch it is a "when" of the branch's
condition; a loop is a higher-order function over an array, and a name from outside that its body assigns is folded along.
What a loop prints is an array named after its variable.  Nothing leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.expr import SPARK, Compiler, Typed, TypeFault, text, type_of, widest
from logloom.functions.render import Only, to_json, to_list, to_xml
from logloom.lang import syntax as S


@dataclass
class Field:
    """A printed value, or a printed collection (array and the fields of one element), and where it is printed."""

    value: Typed | None
    condition: Column | None
    array: Column | None = None
    item: object = None


@dataclass
class Result:
    fields: dict[str, Field] = field(default_factory=dict)
    exposed: dict[str, Field] = field(default_factory=dict)
    diagnostics: list[tuple[Column, str, Column]] = field(default_factory=list)
    names: dict[str, Typed] = field(default_factory=dict)


def _and(a: Column | None, b: Column) -> Column:
    b = F.coalesce(b, F.lit(False))
    return b if a is None else a & b


def _assigned(body: list[S.Stmt]) -> list[str]:
    """Names that a body assigns, in order."""
    out: list[str] = []
    for s in body:
        p = s.parts
        inner = [*p["yes"], *p["no"]] if s.kind == "if" else p["body"] if s.kind in ("block", "for", "eval") else []
        found = [p["target"].name.lower()] if s.kind == "assign" and isinstance(p["target"], S.Name) else _assigned(inner)
        out += [n for n in found if n not in out]
    return out


class _Run:
    def __init__(self, names: dict[str, Typed], functions: dict | None):
        self.scopes: list[dict[str, Typed]] = [dict(names)]
        self.functions = functions
        self.result = Result()

    def compiler(self) -> Compiler:
        return Compiler({k: v for scope in self.scopes for k, v in scope.items()}, self.functions)

    def value(self, e) -> Typed:
        return self.compiler().typed(e)

    def test(self, e) -> Column:
        v = self.value(e)
        if v.type != "bool":
            raise TypeFault(f"{v.type} is no condition")
        return v.col

    def within(self, body: list[S.Stmt], only: Column | None, names: dict[str, Typed] | None = None) -> None:
        self.scopes.append(dict(names or {}))
        self.all(body, only)
        self.scopes.pop()

    def all(self, body: list[S.Stmt], only: Column | None) -> None:
        for s in body:
            self.one(s, only)

    def assign(self, name: str, value: Typed, only: Column | None) -> None:
        low = name.lower()
        scope = next((x for x in reversed(self.scopes) if low in x), None)
        if scope is None:
            self.scopes[-1][low] = value  # a new name lives in its own block, where its condition holds anyway
            return
        old = scope[low]
        kind = widest(old.type, value.type)
        scope[low] = Typed(value.to(kind), kind) if only is None else Typed(F.when(only, value.to(kind)).otherwise(old.to(kind)), kind)

    def put(self, into: dict[str, Field], name: str, new: Field) -> None:
        old = into.get(name)
        if old is not None and old.value is not None and new.value is not None:  # printed again: the later one holds where it is printed
            kind = widest(old.value.type, new.value.type)
            value = new.value.to(kind) if new.condition is None else F.when(new.condition, new.value.to(kind)).otherwise(old.value.to(kind))
            both = None if old.condition is None or new.condition is None else old.condition | new.condition
            new = Field(Typed(value, kind), both)
        into[name] = new

    def one(self, s: S.Stmt, only: Column | None) -> None:
        p = s.parts
        match s.kind:
            case "block":
                self.within(p["body"], only)
            case "eval":
                self.all(p["body"], only)
            case "if":
                test = F.coalesce(self.test(p["test"]), F.lit(False))
                self.within(p["yes"], _and(only, test))
                self.within(p["no"], _and(only, ~test))
            case "assign":
                if not isinstance(p["target"], S.Name):
                    raise TypeFault("a query assigns names only")
                self.assign(p["target"].name, self.value(p["value"]), only)
            case "print" | "expose":
                into = self.result.fields if s.kind == "print" else self.result.exposed
                for name, e in p["columns"]:
                    self.put(into, name, Field(self.value(e), only))
            case "check":
                self.result.diagnostics.append((_and(only, ~F.coalesce(self.test(p["test"]), F.lit(False))), p["severity"], text(self.value(p["message"]))))
            case "notify":
                self.result.diagnostics.append((F.lit(True) if only is None else only, p["severity"], text(self.value(p["message"]))))
            case "for":
                self.loop(p, only)
            case _:
                raise TypeFault(f"a query cannot {s.kind}")

    def loop(self, p: dict, only: Column | None) -> None:
        source = self.value(p["source"])
        if not source.type.startswith("list<"):
            raise TypeFault("for wants a list")
        inner, names, body = source.type[5:-1], p["names"], p["body"]
        known = self.compiler().names
        carried = [n for n in _assigned(body) if n in known]
        array = F.coalesce(source.col, F.array().cast("array<void>")) if inner == "null" else source.col

        def bound(x: Column, i: Column) -> dict[str, Typed]:
            last = {names[-1].lower(): Typed(x, inner)}
            return last if len(names) == 1 else {names[0].lower(): Typed(i, "int"), **last}

        def inside(x: Column, i: Column, more: dict[str, Typed]) -> _Run:
            run = _Run(known, self.functions)
            run.scopes.append(more)
            run.within(body, None, bound(x, i))
            if run.result.diagnostics or run.result.exposed:
                raise TypeFault("a loop prints or assigns only")
            return run

        probe = inside(F.lit(None), F.lit(0), {})
        if carried:
            if probe.result.fields:
                raise TypeFault("a loop that assigns names from outside cannot print")
            kinds = {n: widest(known[n].type, probe.scopes[0][n].type) for n in carried}
            start = F.struct(*[known[n].to(kinds[n]).alias(n) for n in carried])
            pairs = F.transform(array, lambda x, i: F.struct(x.alias("x"), i.alias("i")))

            def step(state: Column, pair: Column) -> Column:
                now = {n: Typed(state[n], kinds[n]) for n in carried}
                run = inside(pair["x"], pair["i"], now)
                return F.struct(*[run.scopes[1][n].to(kinds[n]).cast(SPARK.get(kinds[n], "string")).alias(n) for n in carried])

            end = F.aggregate(pairs, start, step)
            for n in carried:
                self.assign(n, Typed(F.when(array.isNull(), known[n].to(kinds[n])).otherwise(end[n]), kinds[n]), only)
            return
        name = names[-1] if names[-1] != "_" else names[0]
        numbered = F.transform(array, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        self.result.fields[name] = Field(None, only, numbered, lambda e: inside(e["x"], e["i"], {}).result.fields)


def _document(fields: dict[str, Field]) -> list:
    out = []
    for name, f in fields.items():
        part = (name, f.value) if f.value is not None else (name, f.array, lambda e, f=f: _document(f.item(e)))
        out.append(part if f.condition is None else Only(f.condition, part))
    return out


def _struct(fields: dict[str, Field]) -> list[Column]:
    """The printed fields as columns, null where they are not printed; collections as arrays of structs."""
    out = []
    for name, f in fields.items():
        c = f.value.col if f.value is not None else F.transform(f.array, lambda e, f=f: F.struct(*_struct(f.item(e))))
        out.append((c if f.condition is None else F.when(f.condition, c)).alias(name))
    return out


def compile_program(df: DataFrame, script: str, functions: dict | None = None, parameters: dict[str, Typed] | None = None) -> Result:
    """The program over the columns of df.  parameters: further names; one whose value is an expression of columns is computed
    for each row."""
    own = {f.name.lower(): Typed(F.col(f"`{f.name}`"), type_of(f.dataType.simpleString())) for f in df.schema}
    run = _Run({**own, **{k.lower(): v for k, v in (parameters or {}).items()}}, functions)
    run.all(S.parse_program(script), None)
    run.result.names = run.scopes[0]
    return run.result


def run_columns(df: DataFrame, script: str, key: list[str], **options) -> DataFrame:
    """key and a column for everything the program prints."""
    return df.select(*key, *_struct(compile_program(df, script, **options).fields))


def run_documents(df: DataFrame, script: str, key: list[str], render: str = "json", **options) -> DataFrame:
    """key and document, a text: json, list or xml."""
    make = {"json": to_json, "list": to_list, "xml": to_xml}[render]
    return df.select(*key, make(*_document(compile_program(df, script, **options).fields)).alias("document"))


def run_exposed(df: DataFrame, script: str, key: list[str], **options) -> DataFrame:
    """key and expose: JSON of what the program exposes."""
    return df.select(*key, to_json(*_document(compile_program(df, script, **options).exposed)).alias("expose"))


def run_diagnostics(df: DataFrame, script: str, key: list[str], **options) -> DataFrame:
    """key, severity, message: a row for each check that fails and each notify that is reached."""
    found = compile_program(df, script, **options).diagnostics
    each = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(severity).alias("severity"), message.alias("message"))) for c, severity, message in found]))
    return df.select(*key, F.explode(each).alias("d")).select(*key, "d.severity", "d.message")


def run_guarded(df: DataFrame, check: str, command: str, key: list[str], **options) -> DataFrame:
    """What the command prints, for the rows in which the check reports no error."""
    errors = [c for c, severity, _ in compile_program(df, check, **options).diagnostics if severity == "error"]
    bad = F.lit(False)
    for c in errors:
        bad = bad | c
    return run_columns(df.where(~bad), command, key, **options)
