"""Sequence definitions (reactions): a small immutable specification and its fluent builder.

One specification serves the batch planner (plans/batch.py) and the streaming engine (streaming/engine.py).
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field, replace
from datetime import timedelta

from pyspark.sql import DataFrame

#: Greatest number of steps.
MAX_DEPTH = 100
#: Entries after which an idle partial match is dropped.
STALE_AFTER = 1000


@dataclass(frozen=True)
class Seek:
    patterns: tuple[str, ...] = ()
    source: DataFrame | None = field(default=None, compare=False)
    where: str | None = None
    many: bool = False
    at_least: int = 1
    exactly: int | None = None
    entries: int | None = None
    time: timedelta | None = None
    final: bool = False
    accumulate: str | None = None
    aged: timedelta | None = None


@dataclass(frozen=True)
class ForEach:
    """Factors of a product: names, and the captured arrays that they run over; a factor of several is zipped."""

    factors: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...]


def parse_for_each(text: str) -> ForEach:
    """"(a, b) in $xs × ($ys, $zs)": names on the left in the order of the arrays on the right; * stands for ×."""
    m = re.fullmatch(r"\s*\(?([^()]*)\)?\s+in\s+(.+)", text, re.S)
    if not m:
        raise ValueError(f"not a for-each: {text}")
    names = [n.strip().lstrip("$").lower() for n in m[1].split(",")]
    factors, at = [], 0
    for part in re.split(r"[×*]", m[2]):
        arrays = tuple(a.strip().lstrip("$").lower() for a in part.strip().strip("()").split(","))
        factors.append((tuple(names[at : at + len(arrays)]), arrays))
        at += len(arrays)
    if at != len(names) or not all(names):
        raise ValueError("as many names as arrays are needed")
    return ForEach(tuple(factors))


@dataclass(frozen=True)
class Reaction:
    name: str
    seeks: tuple[Seek, ...] = ()
    for_each: ForEach | None = None
    stale_after: int | None = STALE_AFTER
    action: str = "emit"  # emit, continue, elide, materialize, outbox
    elide_seeks: tuple[int, ...] = ()
    destination: str | None = None
    payload: str | None = None
    types: tuple[tuple[str, str], ...] = ()

    # Building
    def seek(self, *patterns: str, source: DataFrame | None = None) -> Reaction:
        if self.seeks:
            raise ValueError("seek() comes first and once")
        return self._add(patterns, source)

    def then_seek(self, *patterns: str, source: DataFrame | None = None) -> Reaction:
        if not self.seeks or self.seeks[-1].final:
            raise ValueError("then_seek() needs a seek before it that is not the final one")
        return self._add(patterns, source)

    def then_final_seek(self, *patterns: str, source: DataFrame | None = None) -> Reaction:
        return self.then_seek(*patterns, source=source)._last(final=True)

    def _add(self, patterns, source) -> Reaction:
        if len(self.seeks) == MAX_DEPTH:
            raise ValueError(f"at most {MAX_DEPTH} seeks")
        if not patterns and source is None:
            raise ValueError("a seek needs a pattern or a source")
        return replace(self, seeks=(*self.seeks, Seek(tuple(patterns), source)))

    def _last(self, **what) -> Reaction:
        if not self.seeks:
            raise ValueError("no seek to change")
        return replace(self, seeks=(*self.seeks[:-1], replace(self.seeks[-1], **what)))

    def where(self, condition: str) -> Reaction:
        return self._last(where=condition)

    def many(self, at_least: int = 1) -> Reaction:
        if self.seeks[-1].exactly is not None or at_least < 1:
            raise ValueError("many() and an exact count exclude each other")
        return self._last(many=True, at_least=at_least)

    def exactly(self, n: int) -> Reaction:
        if self.seeks[-1].many or len(self.seeks) < 2 or n < 0:
            raise ValueError("an exact count needs a seek before it and no many()")
        return self._last(exactly=n)

    def none(self) -> Reaction:
        return self.exactly(0)

    def one(self) -> Reaction:
        return self.exactly(1)

    def within(self, span: int | timedelta) -> Reaction:
        return self._last(time=span) if isinstance(span, timedelta) else self._last(entries=span)

    def accumulate(self, name: str) -> Reaction:
        """Give the entries that the many-seek has taken a column of their own."""
        return self._last(accumulate=name)

    def aged(self, span: timedelta) -> Reaction:
        return self._last(aged=span)

    def cover(self, text: str) -> Reaction:
        return replace(self, for_each=parse_for_each(text))

    def elide(self, *seeks: int) -> Reaction:
        return replace(self, action="elide", elide_seeks=seeks)

    def materialize(self, destination: str) -> Reaction:
        return replace(self, action="materialize", destination=destination)

    def outbox(self, destination: str, payload: str) -> Reaction:
        return replace(self, action="outbox", destination=destination, payload=payload)

    def check(self) -> Reaction:
        """Raises ValueError where the definition cannot run."""
        for k, s in enumerate(self.seeks):
            if s.exactly is not None and s.entries is None and s.time is None:
                raise ValueError("an exact count needs a window")
            if s.final and k != len(self.seeks) - 1:
                raise ValueError("the final seek is the last one")
            if s.aged and not self.for_each:
                raise ValueError("aged() belongs to coverage")
        if not self.seeks:
            raise ValueError("no seek")
        return self

    @property
    def identity(self) -> str:
        """A number for the whole definition: changing any part of it gives another one."""
        parts = [self.name, *(repr(s) for s in self.seeks), repr(self.for_each), self.action, repr(self.elide_seeks), self.destination, self.payload]
        return hashlib.sha256("\n".join(map(str, parts)).encode()).hexdigest()[:16]


def reaction(name: str) -> Reaction:
    return Reaction(name)
