"""What a plan's filters say of the stored values, in a form that file readers can use to skip row groups.

A filter over a typed column tests a value that was made from the stored one: moments without their
fractions, decimals from doubles, years.  Readers don't see through that, so each such condition is
given once more as a range of the stored value that holds all rows it can accept.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon import types as t
from tabulon.plans.validator import Physical, Typed

_FLIPPED = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "==": "=="}
_SECOND = timedelta(seconds=1)
#: Local time zones are never further apart than this.
_ZONE = timedelta(days=1)


def ranges(plan: Physical) -> Iterator[tuple[str, str, str, object]]:
    """(column, what of it, operator, value) of every condition that all rows of the result meet; what is value or year."""
    computed = dict(plan.computed)
    for condition in plan.filters:
        yield from _of(condition, computed)


def _of(x: Typed, computed: dict[str, Typed]) -> Iterator[tuple[str, str, str, object]]:
    if x.op == "and":
        for part in x.args:
            yield from _of(part, computed)
    elif x.op == "between" and not x.negated and all(a.op == "literal" for a in x.args[1:]):
        for op, bound in ((">=", x.args[1]), ("<=", x.args[2])):
            yield from _compared(x.args[0], op, bound, computed)
    elif x.op in _FLIPPED:
        a, b = x.args
        if b.op == "literal":
            yield from _compared(a, x.op, b, computed)
        elif a.op == "literal":
            yield from _compared(b, _FLIPPED[x.op], a, computed)


def _compared(side: Typed, op: str, bound: Typed, computed: dict[str, Typed]) -> Iterator[tuple[str, str, str, object]]:
    if side.op == "column" and side.value in computed:
        side = computed[side.value]
    if side.op == "column" and side.value not in computed:
        yield side.value, "value", op, bound.value
    elif side.op == "call" and side.value == "year" and side.args[0].op == "column" and side.args[0].value not in computed:
        yield side.args[0].value, "year", op, bound.value


def stored(source: Column, kind: T.DataType, typed: str, what: str, op: str, value: object) -> Column | None:
    """The condition on a stored column of a Spark type that a range of its typed value implies, or None if that says nothing new."""
    if what == "year":
        if not isinstance(value, int) or not 1 <= value < 9999:
            return None
        first, after = datetime(value, 1, 1), datetime(value + 1, 1, 1)
        low, high = {"==": (first, after), "<": (None, first), "<=": (None, after), ">": (after, None), ">=": (first, None)}[op]
        return _moments(source, kind, low, high)
    if typed == t.DATETIME:
        low, high = {"==": (value, value + _SECOND), "<": (None, value), "<=": (None, value + _SECOND), ">": (value + _SECOND, None), ">=": (value, None)}[op]
        return _moments(source, kind, low, high)
    if typed == t.DECIMAL and isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        near = 1e-3 + 1e-6 * abs(float(value))  # more than rounding to four digits, of doubles or floats, takes
        low, high = source > F.lit(float(value) - near), source < F.lit(float(value) + near)
        return {"==": low & high, "<": high, "<=": high, ">": low, ">=": low}[op]
    return None


def _moments(source: Column, kind: T.DataType, low: datetime | None, high: datetime | None) -> Column | None:
    if isinstance(kind, T.DateType):
        name, wider = "date", timedelta(0)
    elif isinstance(kind, T.TimestampNTZType):
        name, wider = "timestamp_ntz", timedelta(0)
    elif isinstance(kind, T.TimestampType):
        name, wider = "timestamp", _ZONE
    else:
        return None
    at = lambda x: F.lit(x.isoformat(sep=" ")).cast(name)
    found = [source >= at(low - wider)] if low else []
    found += [source < at(high + wider)] if high else []
    return found[0] & found[1] if len(found) == 2 else found[0]
