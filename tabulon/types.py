"""Physical and semantic types, columns and schemas."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

INT64, FLOAT64, BOOLEAN, DATE, DATETIME, DECIMAL, UTF8, CATEGORICAL, UNKNOWN = ("INT64", "FLOAT64", "BOOLEAN", "DATE", "DATETIME", "DECIMAL", "UTF8", "CATEGORICAL", "UNKNOWN")
PHYSICAL = (INT64, FLOAT64, BOOLEAN, DATE, DATETIME, DECIMAL, UTF8, CATEGORICAL)
NUMERIC = frozenset((INT64, FLOAT64, DECIMAL))
TEMPORAL = frozenset((DATE, DATETIME))
TEXT = frozenset((UTF8, CATEGORICAL))
SEMANTIC = ("UNKNOWN", "IDENTIFIER", "QUANTITY", "MONETARY", "PERCENTAGE", "COUNTRY", "CATEGORY", "STATUS", "DATE", "TIMESTAMP", "TEXT", "FLAG", "EMAIL")

DECIMAL_TYPE = T.DecimalType(18, 4)
SPARK = {INT64: T.LongType(), FLOAT64: T.DoubleType(), BOOLEAN: T.BooleanType(), DATE: T.DateType(), DATETIME: T.TimestampNTZType(), DECIMAL: DECIMAL_TYPE, UTF8: T.StringType(), CATEGORICAL: T.StringType()}
_ALIASES = {"INT": INT64, "INTEGER": INT64, "FLOAT": FLOAT64, "DOUBLE": FLOAT64, "BOOL": BOOLEAN, "TIMESTAMP": DATETIME, "MONEY": DECIMAL, "STRING": UTF8, "TEXT": UTF8, "CATEGORY": CATEGORICAL}


def physical_type(name: str) -> str:
    """The physical type that a name or one of its aliases means; UNKNOWN for any other."""
    upper = name.strip().upper()
    return upper if upper in PHYSICAL else _ALIASES.get(upper, UNKNOWN)


def semantic_type(name: str) -> str:
    upper = name.strip().upper()
    return upper if upper in SEMANTIC else "UNKNOWN"


def of_spark(kind: T.DataType) -> str:
    """The physical type of a typed source's column."""
    if isinstance(kind, T.IntegralType):
        return INT64
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return FLOAT64
    for spark, name in ((T.DecimalType, DECIMAL), (T.BooleanType, BOOLEAN), (T.DateType, DATE), (T.TimestampType, DATETIME), (T.TimestampNTZType, DATETIME), (T.StringType, UTF8)):
        if isinstance(kind, spark):
            return name
    return UNKNOWN


@dataclass(frozen=True)
class Column:
    """A column as it is stored and as queries name it."""

    physical_name: str
    index: int
    physical_type: str
    semantic_name: str = ""
    semantic_type: str = "UNKNOWN"
    confidence: float = 0.0
    confirmed: bool = False

    @property
    def query_name(self) -> str:
        return self.semantic_name or self.physical_name


@dataclass(frozen=True)
class Dialect:
    """How a delimited file is written."""

    delimiter: str = ","
    quote: str = '"'
    has_header: bool = True
    header_confidence: float = 0.0
    encoding: str = "utf-8"
    decimal_separator: str = "."
    thousands_separator: str = ""
    crlf: bool = False  # the first line ends with a carriage return, alone or before the line feed
    quoted_newlines: bool = False
    names: tuple[str, ...] = ()


@dataclass(frozen=True)
class Schema:
    """Columns in file order, and the dialect of a delimited source."""

    columns: tuple[Column, ...]
    dialect: Dialect = field(default_factory=Dialect)
    dataset: str = ""

    def resolve(self, name: str) -> Column | None:
        """The one column a name means, case aside: by semantic names, else by physical ones; None if none or several."""
        wanted = name.lower()
        for of in (lambda c: c.semantic_name, lambda c: c.physical_name):
            found = [c for c in self.columns if of(c) and of(c).lower() == wanted]
            if found:
                return found[0] if len(found) == 1 else None
        return None

    def with_columns(self, columns: list[Column]) -> Schema:
        return replace(self, columns=tuple(columns))


def display(value: object, kind: str) -> str:
    """A result cell as text: NULL, four digits for real and decimal numbers, ISO dates."""
    if value is None:
        return "NULL"
    if kind in (FLOAT64, DECIMAL):
        return f"{value:.4f}"
    if kind == BOOLEAN:
        return "true" if value else "false"
    if kind == DATETIME:
        return value.strftime("%Y-%m-%dT%H:%M:%S")
    return str(value)
