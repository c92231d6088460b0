"""Metadata filters: a JSON-like object compiled to a Column.

No SQL text is built, so nothing can be injected; the checks on values keep out what
is more likely a mistake than a wish.  The filter is applied below any ranking.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class FilterError(ValueError):
    """A filter that cannot be compiled."""


MOST_CHARACTERS, MOST_ITEMS = 256, 256
REFUSED = frozenset("'\"\\;`\n\r\t\0")
INT32 = (-(2**31), 2**31 - 1)
_ORDER = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}
#: Field -> (column, type, operators), in the order predicates are put.
FIELDS = {
    "document_id": ("document_id", str, {"eq", "in", "contains"}),
    "document_name": ("document_id", str, {"contains"}),
    "chunk_id": ("chunk_id", str, {"eq", "in"}),
    "chunk_index": ("chunk_index", int, {"eq", "in", *_ORDER}),
}


@dataclass(frozen=True)
class Predicate:
    column: str
    operator: str
    value: Any

    def to_column(self) -> Column:
        c = F.col(self.column)
        if self.operator == "eq":
            return c == F.lit(self.value)
        if self.operator == "in":
            return c.isin(list(self.value))
        if self.operator == "contains":
            return c.contains(self.value)
        return getattr(c, _ORDER[self.operator])(F.lit(self.value))


@dataclass(frozen=True)
class Filter:
    """Compiled predicates, all of which must hold."""

    predicates: tuple[Predicate, ...]

    def to_column(self) -> Column:
        return reduce(lambda a, b: a & b, (p.to_column() for p in self.predicates))

    @property
    def signature(self) -> str:
        """The same for filters that mean the same; a key for caches."""
        return json.dumps([[p.column, p.operator, list(p.value) if p.operator == "in" else p.value] for p in self.predicates])

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.to_column())


def _checked(field: str, kind: type, value: Any) -> Any:
    if kind is int:
        if isinstance(value, bool) or not isinstance(value, int) or not INT32[0] <= value <= INT32[1]:
            raise FilterError(f"{field} takes a 32-bit integer, not {value!r}")
        return value
    if not isinstance(value, str) or not value.strip():
        raise FilterError(f"{field} takes a string that is not blank, not {value!r}")
    if len(value) > MOST_CHARACTERS or any(c in REFUSED or ord(c) < 32 for c in value):
        raise FilterError(f"{field}: the string is too long or has a character that no id has")
    return value


def compile_filter(spec: Any) -> Filter | None:
    """None for None; a compiled filter as it is; else every field and operator of the object, in canonical order."""
    if spec is None or isinstance(spec, Filter):
        return spec
    if not isinstance(spec, dict) or not spec:
        raise FilterError("a filter is an object with one field at least")
    for name in spec:
        if name not in FIELDS:
            raise FilterError(f"unknown field {name}; there are {', '.join(FIELDS)}")
    out = []
    for name, (column, kind, allowed) in FIELDS.items():
        if name not in spec:
            continue
        wanted = spec[name] if isinstance(spec[name], dict) else {"eq": spec[name]}
        if not wanted:
            raise FilterError(f"{name} has no operator")
        for op in sorted(wanted):
            if op not in allowed:
                raise FilterError(f"{name} does not take {op}; it takes {', '.join(sorted(allowed))}")
            value = wanted[op]
            if op == "in":
                if not isinstance(value, (list, tuple)) or not 0 < len(value) <= MOST_ITEMS:
                    raise FilterError(f"{name}: in takes a list of 1 to {MOST_ITEMS} values")
                value = tuple(_checked(name, kind, v) for v in value)
            else:
                value = _checked(name, kind, value)
            out.append(Predicate(column, op, value))
    return Filter(tuple(out))


def combined(*filters: Filter | None) -> Filter | None:
    """Both narrow; a missing side leaves the other."""
    parts = tuple(p for f in filters if f for p in f.predicates)
    return Filter(parts) if parts else None
