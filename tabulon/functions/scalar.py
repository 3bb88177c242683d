"""The query language's nine functions as Spark expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon import types as t

_LEAST = -(1 << 63)


def _absolute(c: Column, kind: str) -> Column:
    return F.when(c != _LEAST, F.abs(c)) if kind == t.INT64 else F.abs(c)


#: name: (types it takes, its type (None: that of the argument), what it is)
FUNCTIONS = {
    "year": (t.TEMPORAL, t.INT64, lambda c, _: F.year(c).cast("bigint")),
    "month": (t.TEMPORAL, t.INT64, lambda c, _: F.month(c).cast("bigint")),
    "day": (t.TEMPORAL, t.INT64, lambda c, _: F.dayofmonth(c).cast("bigint")),
    "hour": (frozenset((t.DATETIME,)), t.INT64, lambda c, _: F.hour(c).cast("bigint")),
    "minute": (frozenset((t.DATETIME,)), t.INT64, lambda c, _: F.minute(c).cast("bigint")),
    # ASCII only
    "lower": (t.TEXT, None, lambda c, _: F.translate(c, string.ascii_uppercase, string.ascii_lowercase)),
    "upper": (t.TEXT, None, lambda c, _: F.translate(c, string.ascii_lowercase, string.ascii_uppercase)),
    # in bytes
    "length": (t.TEXT, t.INT64, lambda c, _: F.octet_length(c).cast("bigint")),
    "abs": (t.NUMERIC, None, _absolute),
}
