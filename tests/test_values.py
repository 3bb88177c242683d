import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tabulon import types as t
from tabulon.functions import values

D, M = datetime.date, datetime.datetime
CASES = [
    (t.INT64, "42", 42), (t.INT64, "  -7 ", -7), (t.INT64, "19.99", None), (t.INT64, "12abc", None), (t.INT64, "1e3", None), (t.INT64, "9223372036854775808", None),
    (t.FLOAT64, "1.5", 1.5), (t.FLOAT64, "1e3", 1000.0), (t.FLOAT64, "1e999", None), (t.FLOAT64, ".5", 0.5), (t.FLOAT64, "inf", None), (t.FLOAT64, "5%", None),
    (t.DECIMAL, "19.99", Decimal("19.99")), (t.DECIMAL, "-0.01", Decimal("-0.01")), (t.DECIMAL, "15.50 EUR", Decimal("15.5")), (t.DECIMAL, "$5", Decimal(5)), (t.DECIMAL, "1.234567", None), (t.DECIMAL, "1e3", None), (t.DECIMAL, "$5 EUR", None),
    (t.BOOLEAN, "TRUE", True), (t.BOOLEAN, "0", False), (t.BOOLEAN, "ano", True), (t.BOOLEAN, "maybe", None),
    (t.DATE, "2026-01-31", D(2026, 1, 31)), (t.DATE, "31.01.2026", D(2026, 1, 31)), (t.DATE, "2026/01/31", D(2026, 1, 31)), (t.DATE, "2026-02-30", None), (t.DATE, "2026-1-31", None),
    (t.DATE, "01/13/2026", D(2026, 1, 13)), (t.DATE, "13/01/2026", D(2026, 1, 13)), (t.DATE, "01/02/2026", D(2026, 2, 1)), (t.DATE, "0999-01-01", None), (t.DATE, "2026-01/31", None),
    (t.DATETIME, "2026-01-31T12:30:00Z", M(2026, 1, 31, 12, 30)), (t.DATETIME, "2026-01-31 12:30:00+01:00", M(2026, 1, 31, 11, 30)), (t.DATETIME, "2026-01-31t12:30", M(2026, 1, 31, 12, 30)),
    (t.DATETIME, "2026-01-31 23:59:60", M(2026, 2, 1)), (t.DATETIME, "2026-01-31", M(2026, 1, 31)), (t.DATETIME, "2026-01-31T12:30:00.999", M(2026, 1, 31, 12, 30)), (t.DATETIME, "2026-01-31T24:00:00", None), (t.DATETIME, "junk", None),
    (t.UTF8, " a ", " a "),
]


def test_values_agree_with_their_rules(spark):
    for kind in {c[0] for c in CASES}:
        own = [(text, want) for k, text, want in CASES if k == kind]
        df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(own)], "i int, x string")
        got = [r.v for r in df.select("i", values.parsed(F.col("x"), kind).alias("v")).orderBy("i").collect()]
        assert got == [w for _, w in own], kind
        assert [values.scalar(text, kind) for text, _ in own] == [w for _, w in own], kind


@pytest.mark.parametrize(("text", "typed", "plain"), [("", True, True), ("N/A", True, True), (" null ", True, True), ("\\N", True, True), ("0", False, False), ("NA", True, False), ("--", True, False), ("?", True, False)])
def test_null_words(spark, text, typed, plain):
    df = spark.createDataFrame([(text,)], "x string")
    row = df.select(values.is_null(F.col("x"), t.INT64), values.is_null(F.col("x"), t.UTF8)).first()
    assert tuple(row) == (typed, plain)
    assert (values.scalar_is_null(text), values.scalar_is_null(text, False)) == (typed, plain)


def test_separators(spark):
    dialect = t.Dialect(decimal_separator=",", thousands_separator=" ")
    df = spark.createDataFrame([("1 234,50",), ("1.5",), ("-3,25",)], "x string")
    for kind, want in ((t.FLOAT64, [1234.5, None, -3.25]), (t.DECIMAL, [Decimal("1234.5"), None, Decimal("-3.25")])):
        assert [r[0] for r in df.select(values.parsed(F.col("x"), kind, dialect)).collect()] == want
        assert [values.scalar(x, kind, dialect) for x in ("1 234,50", "1.5", "-3,25")] == want
