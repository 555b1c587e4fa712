"""Script expressions as Spark columns, with the language's own promotion rules.

int < double < decimal; double with decimal gives decimal; int / int truncates; == and != are two-valued; strings have no
order; || and && are not guaranteed to stop early.  Integer overflow raises an error (ANSI), where the language wraps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.lang import syntax as S

SPARK = {"int": "int", "long": "bigint", "double": "double", "decimal": "decimal(28,10)", "string": "string", "bool": "boolean", "datetime": "timestamp_ntz"}
FROM_SPARK = {"int": "int", "bigint": "long", "double": "double", "string": "string", "boolean": "bool", "timestamp_ntz": "datetime", "timestamp": "datetime", "smallint": "int", "tinyint": "int", "float": "double", "date": "datetime"}
RANK = {"int": 0, "long": 1, "double": 2, "decimal": 3}


class TypeFault(TypeError):
    """The expression has no type."""


@dataclass(frozen=True)
class Typed:
    col: Column
    type: str

    def to(self, kind: str) -> Column:
        return self.col if self.type == kind else self.col.cast(SPARK[kind])


def type_of(spark_type: str) -> str:
    if spark_type.startswith("decimal"):
        return "decimal"
    if spark_type.startswith("array<"):
        return f"list<{type_of(spark_type[6:-1])}>"
    if spark_type.startswith("interval"):
        return "timespan"
    if spark_type.startswith("struct<"):
        return spark_type
    return FROM_SPARK.get(spark_type, "object")


def fields_of(kind: str) -> dict[str, tuple[str, str]]:
    """Fields of a struct type by their name in lower case: their own name and their type."""
    out, depth, begin = {}, 0, 7
    for i in range(7, len(kind)):
        depth += {"<": 1, "(": 1, ">": -1, ")": -1}.get(kind[i], 0)
        if (kind[i] == "," and depth == 0) or i == len(kind) - 1:
            name, _, inner = kind[begin:i].partition(":")
            out[name.lower()] = (name, type_of(inner))
            begin = i + 1
    return out


def widest(*kinds: str) -> str:
    known = [k for k in kinds if k != "null"]
    if not known:
        return "null"
    if all(k in RANK for k in known):
        return max(known, key=RANK.__getitem__)
    if len(set(known)) == 1:
        return known[0]
    raise TypeFault(f"no common type of {', '.join(known)}")


def text(e: Typed) -> Column:
    """Invariant text: dates as MM/dd/yyyy, with the time unless it is midnight; booleans capitalised."""
    if e.type == "datetime":
        midnight = F.date_format(e.col, "HHmmss") == "000000"
        return F.when(midnight, F.date_format(e.col, "MM/dd/yyyy")).otherwise(F.date_format(e.col, "MM/dd/yyyy HH:mm:ss"))
    if e.type == "bool":
        return F.when(e.col, "True").when(~e.col, "False")
    if e.type == "double":
        return F.regexp_replace(e.col.cast("string"), r"\.0$", "")
    if e.type == "decimal":
        return F.regexp_replace(F.regexp_replace(e.col.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return e.col.cast("string")


def json_number(e: Typed) -> Column:
    """Numbers in documents: doubles and decimals always have a decimal point."""
    t = text(e)
    return F.when(F.instr(t, ".") > 0, t).otherwise(F.concat(t, F.lit(".0"))) if e.type in ("double", "decimal") else t


#: Whitelisted members of values, by type: name -> (arity, result type or None for the receiver's, builder).
MEMBERS = {
    ("string", "toupper"): (0, "string", lambda r: F.upper(r)),
    ("string", "tolower"): (0, "string", lambda r: F.lower(r)),
    ("string", "trim"): (0, "string", lambda r: F.trim(r)),
    ("string", "length"): (None, "int", lambda r: F.char_length(r)),
    ("string", "substring"): (2, "string", lambda r, a, n: F.substring(r, a + 1, n)),
    ("string", "contains"): (1, "bool", lambda r, x: F.contains(r, x)),
    ("string", "startswith"): (1, "bool", lambda r, x: F.startswith(r, x)),
    ("string", "endswith"): (1, "bool", lambda r, x: F.endswith(r, x)),
    ("string", "replace"): (2, "string", lambda r, a, b: F.replace(r, a, b)),
    ("string", "indexof"): (1, "int", lambda r, x: F.call_function("locate", x, r) - 1),
    ("string", "padleft"): (1, "string", lambda r, n: F.when(F.char_length(r) >= n, r).otherwise(F.call_function("lpad", r, n, F.lit(" ")))),
    ("string", "padright"): (1, "string", lambda r, n: F.when(F.char_length(r) >= n, r).otherwise(F.call_function("rpad", r, n, F.lit(" ")))),
    ("string", "trimstart"): (0, "string", lambda r: F.ltrim(r)),
    ("string", "trimend"): (0, "string", lambda r: F.rtrim(r)),
    ("string", "insert"): (2, "string", lambda r, n, x: F.concat(F.substring(r, F.lit(1), n), x, F.substring(r, n + 1, F.char_length(r)))),
    ("string", "remove"): (1, "string", lambda r, n: F.substring(r, F.lit(1), n)),
    ("string", "split"): (1, "list<string>", lambda r, x: F.call_function("split", r, F.concat(F.lit("\\Q"), x, F.lit("\\E")))),
    ("string", "lastindexof"): (1, "int", lambda r, x: F.when(F.contains(r, x), F.char_length(r) - F.call_function("locate", F.reverse(x), F.reverse(r)) - F.char_length(x) + 1).otherwise(F.lit(-1))),
    ("datetime", "year"): (None, "int", lambda r: F.year(r)),
    ("datetime", "month"): (None, "int", lambda r: F.month(r)),
    ("datetime", "day"): (None, "int", lambda r: F.dayofmonth(r)),
    ("datetime", "hour"): (None, "int", lambda r: F.hour(r)),
    ("datetime", "minute"): (None, "int", lambda r: F.minute(r)),
    ("datetime", "second"): (None, "int", lambda r: F.second(r).cast("int")),
    ("datetime", "date"): (None, "datetime", lambda r: F.date_trunc("DAY", r).cast("timestamp_ntz")),
    ("datetime", "adddays"): (1, "datetime", lambda r, n: r + F.make_dt_interval(n)),
    ("datetime", "addhours"): (1, "datetime", lambda r, n: r + F.make_dt_interval(F.lit(0), n)),
    ("datetime", "addminutes"): (1, "datetime", lambda r, n: r + F.make_dt_interval(F.lit(0), F.lit(0), n)),
    ("datetime", "addseconds"): (1, "datetime", lambda r, n: r + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n)),
    ("datetime", "addmonths"): (1, "datetime", lambda r, n: r + F.make_ym_interval(F.lit(0), n)),
    ("datetime", "addyears"): (1, "datetime", lambda r, n: r + F.make_ym_interval(n)),
    ("datetime", "dayofyear"): (None, "int", lambda r: F.dayofyear(r)),
    ("datetime", "dayofweek"): (None, "int", lambda r: F.dayofweek(r) - 1),
    ("timespan", "totalseconds"): (None, "double", lambda r: F.extract(F.lit("DAY"), r) * 86400 + F.extract(F.lit("HOUR"), r) * 3600 + F.extract(F.lit("MINUTE"), r) * 60 + F.extract(F.lit("SECOND"), r).cast("double")),
}
#: Members of lists: name -> (arity, result type: "item", "list" or its own, builder).
LIST_MEMBERS = {
    "contains": (1, "bool", lambda r, x: F.array_contains(r, x)),
    "first": (0, "item", lambda r: F.get(r, F.lit(0))),
    "last": (0, "item", lambda r: F.element_at(r, -1)),
    "distinct": (0, "list", lambda r: F.array_distinct(r)),
    "reverse": (0, "list", lambda r: F.reverse(r)),
    "skip": (1, "list", lambda r, n: F.slice(r, n + 1, F.size(r))),
    "take": (1, "list", lambda r, n: F.slice(r, F.lit(1), n)),
    "max": (0, "item", lambda r: F.array_max(r)),
    "min": (0, "item", lambda r: F.array_min(r)),
    "sum": (0, "item", lambda r: F.aggregate(r, F.coalesce(F.get(r, F.lit(0)) * 0, F.lit(0)), lambda a, x: a + x)),
    "concat": (1, "list", lambda r, x: F.concat(r, x)),
    "indexof": (1, "int", lambda r, x: (F.array_position(r, x) - 1).cast("int")),
}
#: Static functions: class.name -> (arity, result type or None for the argument's, builder).
STATICS = {
    "math.abs": (1, None, lambda x: F.abs(x)),
    "math.floor": (1, "double", lambda x: F.floor(x).cast("double")),
    "math.ceiling": (1, "double", lambda x: F.ceil(x).cast("double")),
    "math.sqrt": (1, "double", lambda x: F.sqrt(x)),
    "math.pow": (2, "double", lambda a, b: F.pow(a, b)),
    "math.round": (2, "double", lambda x, n: F.call_function("bround", x, n)),
    "math.truncate": (1, None, lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))),
    "math.sign": (1, "int", lambda x: F.signum(x).cast("int")),
    "math.exp": (1, "double", lambda x: F.exp(x)),
    "math.log": (1, "double", lambda x: F.log(x)),
    "math.max": (2, None, lambda a, b: F.greatest(a, b)),
    "math.min": (2, None, lambda a, b: F.least(a, b)),
    "time.weeks": (1, "timespan", lambda n: F.make_dt_interval(n * 7)),
    "time.days": (1, "timespan", lambda n: F.make_dt_interval(n)),
    "time.hours": (1, "timespan", lambda n: F.make_dt_interval(F.lit(0), n)),
    "time.minutes": (1, "timespan", lambda n: F.make_dt_interval(F.lit(0), F.lit(0), n)),
    "time.seconds": (1, "timespan", lambda n: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n)),
}


class Compiler:
    """names: lower-case name -> Typed.  A registered function (name -> Typed builder) may stand for a domain method."""

    def __init__(self, names: dict[str, Typed], functions: dict | None = None):
        self.names, self.functions = {k.lower(): v for k, v in names.items()}, functions or {}

    def column(self, source: str) -> Column:
        return self.typed(S.parse_expression(source)).col

    def typed(self, e) -> Typed:
        match e:
            case S.Lit(value, kind):
                if kind == "null":
                    return Typed(F.lit(None), "null")
                return Typed(F.lit(value).cast(SPARK[kind]), kind)
            case S.Name(name):
                if name.lower() not in self.names:
                    raise TypeFault(f"unknown name {name}")
                return self.names[name.lower()]
            case S.Unary("!", arg):
                return Typed(~self._bool(arg), "bool")
            case S.Unary(op, arg):
                x = self.typed(arg)
                if x.type not in RANK:
                    raise TypeFault(f"{op} wants a number")
                return Typed(-x.col, x.type) if op == "-" else x
            case S.Ternary(test, yes, no):
                a, b = self.typed(yes), self.typed(no)
                kind = widest(a.type, b.type)
                return Typed(F.when(self._bool(test), a.to(kind)).otherwise(b.to(kind)), kind)
            case S.Binary("&&", a, b):
                return Typed(F.when(self._bool(a), self._bool(b)).otherwise(F.lit(False)), "bool")
            case S.Binary("||", a, b):
                return Typed(F.when(self._bool(a), F.lit(True)).otherwise(self._bool(b)), "bool")
            case S.Binary(op, a, b):
                return self._binary(op, self.typed(a), self.typed(b))
            case S.Cast(kind, arg):
                return self._cast(kind, self.typed(arg))
            case S.ListOf(items):
                found = [self.typed(x) for x in items]
                kind = widest(*(x.type for x in found)) if found else "int"
                return Typed(F.array(*(x.to(kind) for x in found)), f"list<{kind}>")
            case S.Index(base, keys):
                x = self.typed(base)
                for k in keys:
                    if not x.type.startswith("list<"):
                        raise TypeFault("an index wants a list")
                    x = Typed(x.col[self.typed(k).col], x.type[5:-1])
                return x
            case S.Access(base, member, args):
                return self._access(base, member, args)
            case S.Call(name, args):
                if name.lower() in self.functions:
                    return self.functions[name.lower()](*(self.typed(a) for a in args))
                return Typed(F.struct(*(self.typed(a).col.alias(f"_{i + 1}") for i, a in enumerate(args))), name)
        raise TypeFault(f"cannot compile {e}")

    def _bool(self, e) -> Column:
        x = self.typed(e)
        if x.type != "bool":
            raise TypeFault(f"{x.type} is no condition")
        return x.col

    def _binary(self, op: str, a: Typed, b: Typed) -> Typed:
        if op in ("==", "!="):
            numeric = a.type in RANK and b.type in RANK
            kind = widest(a.type, b.type) if numeric else None
            same = a.to(kind).eqNullSafe(b.to(kind)) if kind else a.col.eqNullSafe(b.col)
            return Typed(same if op == "==" else ~same, "bool")
        if op in ("<", "<=", ">", ">="):
            ok = a.type in RANK and b.type in RANK or a.type == b.type and a.type in ("datetime", "timespan")
            if not ok:
                raise TypeFault(f"{a.type} {op} {b.type}")
            x, y = (a.to(widest(a.type, b.type)), b.to(widest(a.type, b.type))) if a.type in RANK else (a.col, b.col)
            return Typed({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool")
        if op == "+" and "string" in (a.type, b.type):
            return Typed(F.concat(F.coalesce(text(a), F.lit("")), F.coalesce(text(b), F.lit(""))), "string")
        spans = {("datetime", "timespan", "+"): "datetime", ("datetime", "timespan", "-"): "datetime", ("timespan", "timespan", "+"): "timespan", ("timespan", "timespan", "-"): "timespan", ("datetime", "datetime", "-"): "timespan"}
        if (a.type, b.type, op) in spans:
            return Typed(a.col + b.col if op == "+" else a.col - b.col, spans[a.type, b.type, op])
        if a.type not in RANK or b.type not in RANK:
            raise TypeFault(f"{a.type} {op} {b.type}")
        kind = widest(a.type, b.type)
        if kind == "decimal":
            # Scales that keep ten digits: a product of two (28,10) would lose four of them.
            size = "decimal(19,9)" if op == "*" else "decimal(28,10)"
            x, y = a.col.cast(size), b.col.cast(size)
        else:
            x, y = a.to(kind), b.to(kind)
        if op == "/":
            value = F.call_function("div", x, y).cast(SPARK[kind]) if kind in ("int", "long") else x / y
        else:
            value = {"+": x + y, "-": x - y, "*": x * y}[op]
        return Typed(value.cast(SPARK[kind]), kind)

    def _cast(self, kind: str, x: Typed) -> Typed:
        if x.type == "string" and kind in RANK:
            raise TypeFault("a string is not cast to a number")
        if kind == "string":
            return Typed(text(x), "string")
        if kind in ("int", "long") and x.type in ("double", "decimal"):
            return Typed(F.when(x.col < 0, F.ceil(x.col)).otherwise(F.floor(x.col)).cast(SPARK[kind]), kind)
        return Typed(x.col.cast(SPARK[kind]), kind)

    def _access(self, base, member: str, args: tuple | None) -> Typed:
        given = [self.typed(a) for a in args or ()]
        if isinstance(base, S.Name) and base.name.lower() not in self.names:
            key = f"{base.name}.{member}".lower()
            if key in self.names:
                return self.names[key]
            if key in self.functions:
                return self.functions[key](*given)
            if key in STATICS:
                arity, kind, build = STATICS[key]
                if len(given) != arity:
                    raise TypeFault(f"{key} takes {arity} arguments")
                return Typed(build(*(x.col for x in given)), kind or widest(*(x.type for x in given)))
            raise TypeFault(f"unknown {key}")
        x = self.typed(base)
        if x.type.startswith("list<") and member.lower() == "count":
            return Typed(F.size(x.col), "int")
        if x.type.startswith("list<") and args is not None and member.lower() in LIST_MEMBERS:
            arity, kind, build = LIST_MEMBERS[member.lower()]
            if arity != len(given):
                raise TypeFault(f"{member} takes {arity} arguments")
            inner = x.type[5:-1]
            values = [g.to(inner) if g.type in RANK and inner in RANK else g.col for g in given]
            return Typed(build(x.col, *values), {"item": inner, "list": x.type}.get(kind, kind))
        if (x.type, member.lower()) in MEMBERS:
            arity, kind, build = MEMBERS[x.type, member.lower()]
            if (arity is None) != (args is None) or (arity or 0) != len(given):
                raise TypeFault(f"{member} takes {arity or 'no'} arguments")
            return Typed(build(x.col, *(g.col for g in given)), kind)
        if args is None and x.type.startswith("struct<") and member.lower() in (fields := fields_of(x.type)):
            name, kind = fields[member.lower()]
            return Typed(x.col.getField(name), kind)
        if args is None and x.type == "object":
            return Typed(x.col.getField(member), "object")
        raise TypeFault(f"{x.type} has no member {member}")


def over(df, extra: dict[str, Typed] | None = None) -> Compiler:
    """A compiler over the columns of a DataFrame."""
    own = {f.name: Typed(F.col(f"`{f.name}`"), type_of(f.dataType.simpleString())) for f in df.schema}
    return Compiler({**own, **(extra or {})})
