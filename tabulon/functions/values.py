"""Rules that turn text into values, as Spark expressions and, for literals and file heads, as plain functions.

Both forms share their patterns.  Text columns keep their text as it is; all others are trimmed first.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon import types as t

# Fixed values of the file format.
NULL_WORDS = ("", "null", "n/a", "nan", "\\n")
NULL_WORDS_TYPED = (*NULL_WORDS, "nil", "na", "none", "-", "--", "?")
TRUE_WORDS = ("true", "t", "yes", "y", "1", "ano")
FALSE_WORDS = ("false", "f", "no", "n", "0", "nie")
CURRENCIES = ("EUR", "USD", "CZK", "PLN", "GBP", "€", "$", "Kč")

_SPACE = " \t\n\x0b\f\r"
_INT = r"^[+-]?\d+$"
_FLOAT = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_DECIMAL = r"^[+-]?(\d+(\.\d{0,4})?|\.\d{1,4})$"
_MARK = "|".join(re.escape(c) for c in CURRENCIES)
_YMD = r"^(\d{4})([-/])(\d{2})\2(\d{2})$"
_DOTTED = r"^(\d{2})\.(\d{2})\.(\d{4})$"
_SLASHED = r"^(\d{2})/(\d{2})/(\d{4})$"
_MOMENT = r"^(.{10})[Tt ](\d{2}):(\d{2})(?::(\d{2})(?:\.\d*)?)?(?:[Zz]|([+-])(\d{2}):(\d{2}))?$"


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACE))


def _null_pattern(words: tuple[str, ...]) -> str:
    """Fails at the first character of nearly every value."""
    space = "[ \\t\\n\\x0B\\f\\r]*+"
    return f"^{space}(?:(?i:{'|'.join(re.escape(w) for w in words if w)}){space})?\\z"


_NULL, _NULL_TYPED = _null_pattern(NULL_WORDS), _null_pattern(NULL_WORDS_TYPED)


def is_null(text: Column, kind: str) -> Column:
    """Whether a field stands for no value in a column of a type."""
    return text.isNull() | text.rlike(_NULL if kind in t.TEXT else _NULL_TYPED)


def field(text: Column, kind: str, dialect: t.Dialect | None = None) -> Column:
    """The value of a field of a type; null if it stands for none or doesn't parse.

    Nearly all values are written in one plain way, which a single pattern tells; the other ways, and
    blanks around values, are looked at only where that fails.
    """
    dialect = dialect or t.Dialect()
    if kind in t.TEXT:
        return F.when(~is_null(text, kind), text)
    plain = {t.INT64: (r"^-?[0-9]{1,18}\z", "bigint"), t.DECIMAL: (r"^-?[0-9]{1,14}(?:\.[0-9]{1,4})?+\z", "decimal(18,4)"), t.FLOAT64: (r"^-?[0-9]{1,15}(?:\.[0-9]{1,15})?+\z", "double"), t.DATE: (r"^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2}\z", "date"), t.DATETIME: (r"^[1-9][0-9]{3}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}\z", "timestamp_ntz")}
    other = _bound(text, lambda x: F.when(~is_null(x, kind), parsed(x, kind, dialect)))
    if kind not in plain or (kind in (t.DECIMAL, t.FLOAT64) and dialect.decimal_separator != ".") or (kind in t.NUMERIC and dialect.thousands_separator == "."):
        return other
    pattern, name = plain[kind]
    return F.coalesce(F.when(text.rlike(pattern), text.try_cast(name)), other)


def _plain_number(text: Column, dialect: t.Dialect) -> Column:
    """A number with a point as its decimal separator and no thousands separator; null where a stray point stands."""
    out = text
    if dialect.thousands_separator:
        out = F.replace(out, F.lit(dialect.thousands_separator), F.lit(""))
    if dialect.decimal_separator != ".":
        out = F.when(~F.contains(out, F.lit(".")), F.replace(out, F.lit(dialect.decimal_separator), F.lit(".")))
    return out


def _guarded(text: Column, pattern: str, kind: str) -> Column:
    return F.when(text.rlike(pattern), text.try_cast(kind))


def parsed(text: Column, kind: str, dialect: t.Dialect | None = None) -> Column:
    """The value of a field that isn't null, or null if it doesn't parse."""
    dialect = dialect or t.Dialect()
    if kind in t.TEXT:
        return text
    text = trimmed(text)
    if kind == t.INT64:
        return _guarded(F.replace(text, F.lit(dialect.thousands_separator), F.lit("")) if dialect.thousands_separator else text, _INT, "bigint")
    if kind == t.FLOAT64:
        value = _guarded(_plain_number(text, dialect), _FLOAT, "double")
        return F.when(F.abs(value) < float("inf"), value)
    if kind == t.DECIMAL:
        return F.coalesce(_guarded(_plain_number(text, dialect), _DECIMAL, "decimal(18,4)"), _bound(text, lambda x: _marked(x, dialect)))
    if kind == t.BOOLEAN:
        word = F.lower(text)
        return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    if kind == t.DATE:
        return _date(text)
    if kind == t.DATETIME:
        return _moment(text)
    return F.lit(None)


def _marked(text: Column, dialect: t.Dialect) -> Column:
    """A decimal with one currency before or after it."""
    bare = trimmed(F.regexp_replace(text, f"^({_MARK})|({_MARK})$", ""))
    one = text.rlike(f"^({_MARK})|({_MARK})$") & ~text.rlike(f"^({_MARK}).*({_MARK})$")
    return _guarded(F.when(one, _plain_number(bare, dialect)), _DECIMAL, "decimal(18,4)")


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it names it; keeps generated code small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _date(text: Column) -> Column:
    """Ten characters: YYYY-MM-DD, YYYY/MM/DD, DD.MM.YYYY, or slashes, read per value as day first unless only month first can be."""

    def other(x: Column) -> Column:
        parts = F.split(x, "[-/.]")
        first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        month_first = x.contains("/") & (first <= "12") & (second > "12")
        iso = F.when(x.rlike(_YMD), F.replace(x, F.lit("/"), F.lit("-"))).when(
            x.rlike(_DOTTED) | x.rlike(_SLASHED), F.concat_ws("-", F.get(parts, F.lit(2)), F.when(month_first, first).otherwise(second), F.when(month_first, second).otherwise(first))
        )
        return F.when(iso >= "1000", iso.try_cast("date"))

    plain = F.when(text.rlike(r"^[1-9]\d{3}-\d\d-\d\d$"), text.try_cast("date"))
    return F.coalesce(plain, F.when(F.length(text) == 10, _bound(text, other)))


def _moment(text: Column) -> Column:
    """A date, or a date and a time with seconds up to 60 and an offset that is taken off; fractions are dropped."""

    def other(parts: Column) -> Column:
        number = [F.coalesce(F.get(parts, F.lit(k)).try_cast("bigint"), F.lit(0)) for k in range(1, 7)]
        hour, minute, second, _, off_hour, off_minute = number
        inside = (hour <= 23) & (minute <= 59) & (second <= 60) & (off_hour <= 23) & (off_minute <= 59)
        offset = F.when(F.get(parts, F.lit(4)) == "-", 1).otherwise(-1) * (off_hour * 3600 + off_minute * 60)
        seconds = F.unix_date(_date(F.get(parts, F.lit(0)))).cast("bigint") * 86400 + hour * 3600 + minute * 60 + second + offset
        return F.when(inside, F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_seconds(seconds).cast("timestamp_ntz")))

    plain = F.when(text.rlike(r"^[1-9]\d{3}-\d\d-\d\d[T ]\d\d:\d\d:\d\d$"), text.try_cast("timestamp_ntz"))
    pieces = F.split(F.regexp_replace(text, _MOMENT, "$1,$2,$3,$4,$5,$6,$7"), ",", -1)
    timed = F.when(text.rlike(_MOMENT), _bound(pieces, other))
    return F.coalesce(plain, timed, F.when(F.length(text) == 10, _date(text).cast("timestamp_ntz")))


# The same rules for single values.


def scalar_is_null(text: str, typed: bool = True) -> bool:
    return strip(text).lower() in (NULL_WORDS_TYPED if typed else NULL_WORDS)


def strip(text: str) -> str:
    return text.strip(_SPACE)


def _scalar_number(text: str, dialect: t.Dialect) -> str:
    if dialect.thousands_separator:
        text = text.replace(dialect.thousands_separator, "")
    if dialect.decimal_separator != ".":
        text = "x" if "." in text else text.replace(dialect.decimal_separator, ".")
    return text


def _scalar_int(text: str, dialect: t.Dialect) -> int | None:
    bare = text.replace(dialect.thousands_separator, "") if dialect.thousands_separator else text
    value = int(bare) if re.fullmatch(_INT[1:-1], bare, re.A) else None
    return value if value is not None and -(1 << 63) <= value < 1 << 63 else None


def _scalar_float(text: str, dialect: t.Dialect) -> float | None:
    bare = _scalar_number(text, dialect)
    value = float(bare) if re.fullmatch(_FLOAT[1:-1], bare, re.A) else None
    return value if value is not None and abs(value) < float("inf") else None


def _scalar_decimal(text: str, dialect: t.Dialect) -> Decimal | None:
    for mark in CURRENCIES:
        if text.startswith(mark):
            text = text[len(mark) :]
            break
        if text.endswith(mark):
            text = text[: -len(mark)]
            break
    bare = _scalar_number(strip(text), dialect)
    value = Decimal(bare).quantize(Decimal("0.0001")) if re.fullmatch(_DECIMAL[1:-1], bare, re.A) and len(bare) < 40 else None
    return value if value is not None and abs(value) < 10**14 else None


def _scalar_bool(text: str, _: t.Dialect) -> bool | None:
    return True if text.lower() in TRUE_WORDS else False if text.lower() in FALSE_WORDS else None


def _scalar_date(text: str, _: t.Dialect) -> datetime.date | None:
    if m := re.fullmatch(_YMD[1:-1], text, re.A):
        year, month, day = m[1], m[3], m[4]
    elif m := re.fullmatch(_DOTTED[1:-1], text, re.A):
        day, month, year = m.groups()
    elif m := re.fullmatch(_SLASHED[1:-1], text, re.A):
        day, month, year = m.groups()
        if day <= "12" < month:
            day, month = month, day
    else:
        return None
    try:
        return datetime.date(int(year), int(month), int(day)) if year >= "1000" else None
    except ValueError:
        return None


def _scalar_moment(text: str, dialect: t.Dialect) -> datetime.datetime | None:
    if len(text) == 10:
        day = _scalar_date(text, dialect)
        return day and datetime.datetime(day.year, day.month, day.day)
    m = re.fullmatch(_MOMENT[1:-1], text, re.A)
    day = m and _scalar_date(m[1], dialect)
    if not day:
        return None
    hour, minute, second, off_hour, off_minute = (int(x or 0) for x in (m[2], m[3], m[4], m[6], m[7]))
    if hour > 23 or minute > 59 or second > 60 or off_hour > 23 or off_minute > 59:
        return None
    offset = (1 if m[5] == "-" else -1) * (off_hour * 3600 + off_minute * 60)
    return datetime.datetime(day.year, day.month, day.day) + datetime.timedelta(seconds=hour * 3600 + minute * 60 + second + offset)


_SCALAR: dict[str, Callable] = {t.INT64: _scalar_int, t.FLOAT64: _scalar_float, t.DECIMAL: _scalar_decimal, t.BOOLEAN: _scalar_bool, t.DATE: _scalar_date, t.DATETIME: _scalar_moment}


def scalar(text: str, kind: str, dialect: t.Dialect | None = None) -> object | None:
    """The value of one text of a type, or None if it doesn't parse."""
    return text if kind in t.TEXT else _SCALAR[kind](strip(text), dialect or t.Dialect())
