"""The script language's operators over plain values: numbers, texts, times."""

from __future__ import annotations

from datetime import datetime
from decimal import ROUND_DOWN, Decimal


def shown(v: object) -> str:
    """A value as text: dates as MM/dd/yyyy, with the time unless it is midnight; no zeros behind the point; booleans capitalised."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "True" if v else "False"
    if isinstance(v, datetime):
        return v.strftime("%m/%d/%Y" if (v.hour, v.minute, v.second) == (0, 0, 0) else "%m/%d/%Y %H:%M:%S")
    if isinstance(v, float):
        return repr(v).removesuffix(".0")
    if isinstance(v, Decimal):
        t = format(v, "f")
        return t.rstrip("0").rstrip(".") if "." in t else t
    return str(v)


def binary(op: str, a, b):
    if isinstance(a, Decimal) and isinstance(b, float):
        b = Decimal(repr(b))
    if isinstance(b, Decimal) and isinstance(a, float):
        a = Decimal(repr(a))
    match op:
        case "==":
            return a == b
        case "!=":
            return a != b
        case "+":
            return shown(a) + shown(b) if isinstance(a, str) or isinstance(b, str) else a + b
        case "-":
            return a - b
        case "*":
            return a * b
        case "/":
            return int((Decimal(a) / Decimal(b)).to_integral_value(ROUND_DOWN)) if isinstance(a, int) and isinstance(b, int) else a / b
    if a is None or b is None:
        return False
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def cast(kind: str, v):
    return {"int": int, "long": int, "double": float, "decimal": lambda x: Decimal(str(x)), "string": shown, "bool": bool}.get(kind, lambda x: x)(v)


def typed(kind: str | None, value: str | None):
    """A captured text as a value of its written type."""
    if value is None or kind is None:
        return value
    match kind.lower():
        case "int" | "long":
            return int(value)
        case "double":
            return float(value)
        case "decimal":
            return Decimal(value)
        case "bool":
            return value.lower() == "true"
        case "datetime":
            return datetime.fromisoformat(value)
    return value


def type_name(v: object) -> str:
    """The language's name of a value's type."""
    kinds = {bool: "bool", int: "int", float: "double", Decimal: "decimal", str: "string", datetime: "datetime", type(None): "null"}
    if isinstance(v, list):
        return f"list<{type_name(v[0]) if v else 'object'}>"
    return kinds.get(type(v)) or type(v).__name__
