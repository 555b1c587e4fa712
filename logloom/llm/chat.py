r"""Prefix-target expansion: every assistant turn becomes an example of its own.

An example holds all turns before the reply as context and the reply as the only trainable span.  Turns after the last
reply (or all turns, if there is no reply) follow in one more example without a trainable span, so that nothing is lost.

Template of a turn: "### role: text</turn>\n".  Inside texts and roles a backslash escapes \ and #, and </turn> is written
<\/turn>; in roles ":" is written \c.  Escaped text holds neither "#" alone nor "</turn>", so parsing is unambiguous.

Rows are dealt by conversation, sorted and streamed: memory holds the turns of one conversation at a time.

Defined results: null roles and texts are empty; rows without conv_id form one conversation; equal turns are ordered by
role, then text; repeated rows are repeated turns; an empty table gives no example; extra columns are ignored.
"""

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import lean

END = "</turn>\n"
TRAINED = "assistant"
_ESCAPED = {"\\\\": "\\", "\\#": "#", "\\/": "/", "\\c": ":"}
FIELDS = ["conv_id", "example", "text", "loss_start", "loss_end"]


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("#", "\\#").replace("</turn>", "<\\/turn>")


def unescape(s: str) -> str:
    return re.sub(r"\\.", lambda m: _ESCAPED[m[0]], s) if "\\" in s else s


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The formatted turn and where its text begins."""
    head = f"### {escape(role).replace(':', chr(92) + 'c')}: "
    return f"{head}{escape(text)}{END}", len(head)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of an example."""
    turns = []
    for part in text.split(END)[:-1]:
        role, _, body = part.removeprefix("### ").partition(": ")
        turns.append((unescape(role), unescape(body)))
    return turns


def groups(batches, keys: int = 1):
    """(key, rows) for each run of equal values in the first column of sorted batches."""
    key, rows = None, None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if rows is None or row[0] != key:
                if rows is not None:
                    yield key, rows
                key, rows = row[0], []
            rows.append(row)
    if rows is not None:
        yield key, rows


def expand(turns: list[tuple[str, str]]):
    """(text, loss_start, loss_end) for each example of one conversation; no span (-1) in one without a reply."""
    prefix, size, trailing = [], 0, False
    for role, text in turns:
        formatted, head = format_turn(role, text)
        prefix.append(formatted)
        size += len(formatted)
        trailing = role != TRAINED
        if not trailing:
            prefix = ["".join(prefix)]
            yield prefix[0], size - len(formatted) + head, size - len(END)
    if trailing:
        yield "".join(prefix), -1, -1


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, example (from 0), text, loss_start, loss_end: examples, in order within each conversation and its partition."""
    kind = turns.schema[conv_col].dataType.simpleString()
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )

    def run(batches):
        kind, held, size = None, [], 0
        def flush():
            nonlocal held, size
            cols = list(zip(*held, strict=True))
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.int64()]
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], FIELDS)

        def typed():
            nonlocal kind
            for b in batches:
                kind = b.column(0).type
                yield b

        for conv, found in groups(typed()):
            for n, (text, a, z) in enumerate(expand([(r[2], r[3]) for r in found])):
                held.append((conv, n, text, a, z))
                size += len(text)
                if size > 1 << 22:
                    yield flush()
        if held:
            yield flush()

    sorted_rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return sorted_rows.mapInArrow(lean(run), f"conv_id {kind}, example long, text string, loss_start long, loss_end long")
