"""Query documents as text columns: JSON, an indented list form, and XML, from the same fields.

A document is a list of fields (name, Typed) and collections (name, array column, item): item(element) gives the fields of
one element.  Only(condition, part) stands where the condition holds.  Doubles and decimals always have a point in JSON; dates are MM/dd/yyyy, with the time unless it is midnight;
an empty collection is left out of JSON, is [] in the list form and an empty element in XML.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom.functions.expr import Typed, json_number, text



@dataclass(frozen=True)
class Only:
    """A part of a document that is there only where the condition holds."""

    condition: Column
    part: tuple


def _parts(parts):
    """(condition or None, name, value, item ...) of each part."""
    return [(p.condition, *p.part) if isinstance(p, Only) else (None, *p) for p in parts]


def _when(condition, c: Column) -> Column:
    return c if condition is None else F.when(condition, c)


_BARE = ("int", "long", "double", "decimal", "bool")


def _escape_json(c: Column) -> Column:
    quoted = F.to_json(F.array(c))  # an array of one string: its text without the brackets
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def _json(v: Typed) -> Column:
    if v.type == "null":
        return F.lit("null")
    if v.type.startswith("list<"):
        inner = F.array_join(F.transform(v.col, lambda x: _json(Typed(x, v.type[5:-1]))), ",")
        return F.coalesce(F.concat(F.lit("["), inner, F.lit("]")), F.lit("null"))
    if v.type == "bool":
        out = v.col.cast("string")
    elif v.type in _BARE:
        out = json_number(v)
    else:
        out = _escape_json(text(v))
    return F.coalesce(out, F.lit("null"))


def to_json(*parts: tuple) -> Column:
    """{"a":1,"lines":[{...},...]}"""
    out = []
    for only, name, value, *item in _parts(parts):
        key = F.concat(_escape_json(F.lit(name)), F.lit(":"))
        if item:
            rows = F.array_join(F.transform(value, _item(item[0], to_json)), ",")
            out.append(_when(only, F.when(F.size(value) > 0, F.concat(key, F.lit("["), rows, F.lit("]")))))
        else:
            out.append(_when(only, F.concat(key, _json(value))))
    return F.concat(F.lit("{"), F.concat_ws(",", *out), F.lit("}"))


def _item(fields, render):
    return lambda x: render(*fields(x))


def _plain(v: Typed) -> Column:
    if v.type == "string":
        return F.coalesce(_escape_json(v.col), F.lit("null"))
    if v.type.startswith("list<"):
        return F.concat(F.lit("["), F.array_join(F.transform(v.col, lambda x: _plain(Typed(x, v.type[5:-1]))), ", "), F.lit("]"))
    return F.coalesce(v.col.cast("string") if v.type == "bool" else text(v), F.lit("null"))


def to_list(*parts: tuple) -> Column:
    """One "name: value" a line; items of collections begin with a dash and are indented."""
    lines = []
    for only, name, value, *item in _parts(parts):
        if item:
            rows = F.array_join(F.transform(value, _item(item[0], _dashed)), "\n")
            lines.append(_when(only, F.when(F.size(value) > 0, F.concat(F.lit(f"{name}:\n"), rows)).otherwise(F.lit(f"{name}: []"))))
        else:
            lines.append(_when(only, F.concat(F.lit(f"{name}: "), _plain(value))))
    return F.concat_ws("\n", *lines)


def _dashed(*parts: tuple) -> Column:
    return F.concat(F.lit("  - "), F.replace(to_list(*parts), F.lit("\n"), F.lit("\n    ")))


def _xml_text(c: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(mark), F.lit(entity))
    return c


def to_xml(*parts: tuple, root: str = "root", depth: int = 0) -> Column:
    """Elements named after the fields, indented by two spaces; null is an empty element; items are <item>."""
    pad, inner = "  " * depth, "  " * (depth + 1)
    lines = []
    for only, name, value, *item in _parts(parts):
        empty = F.lit(f"{inner}<{name}/>\n")
        whole = lambda c, only=only: F.coalesce(_when(only, c), F.lit(""))
        if item:
            rows = F.array_join(F.transform(value, _item(item[0], lambda *p: to_xml(*p, root="item", depth=depth + 2))), "")
            lines.append(whole(F.when(F.size(value) > 0, F.concat(F.lit(f"{inner}<{name}>\n"), rows, F.lit(f"{inner}</{name}>\n"))).otherwise(empty)))
        else:
            shown = _xml_text(F.array_join(value.col.cast("array<string>"), ",") if value.type.startswith("list<") else value.col.cast("string") if value.type == "bool" else text(value))
            lines.append(whole(F.coalesce(F.concat(F.lit(f"{inner}<{name}>"), shown, F.lit(f"</{name}>\n")), empty)))
    return F.concat(F.lit(f"{pad}<{root}>\n"), *lines, F.lit(f"{pad}</{root}>\n"))


def find_alias(json_text: Column, alias: str) -> Column:
    """All values of a key anywhere in a JSON text, as JSON texts in order of appearance (scalars and flat arrays or objects)."""
    name = "".join("\\" + c if c in r"\.^$*+?()[]{}|" else c for c in alias)
    value = r'("(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null|\[[^\[\]{}]*\]|\{[^{}\[\]]*\})'
    return F.regexp_extract_all(json_text, F.lit(f'"{name}"\\s*:\\s*{value}'), F.lit(1))
