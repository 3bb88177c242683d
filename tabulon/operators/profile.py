"""Column profiles of a sample or a whole file and the physical types they speak for."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon import files
from tabulon import types as t
from tabulon.functions import values

# Fixed values of the type decision.
EXAMPLES = 5
EXAMPLE_LENGTH = 64
TYPE_SHARE = 0.99
CURRENCY_SHARE = 0.10
CENTS_SHARE = 0.50
CATEGORY_VALUES = 256
CATEGORY_SHARE = 0.10
#: Bytes of a table and of text for one task; a table is stored compressed.
PIECE, TEXT_PIECE = 2 << 20, 4 << 20
#: What the planner says of rows whose size it doesn't know is more.
UNKNOWN = 1 << 60

_HITS = {
    "boolean": t.BOOLEAN, "integer": t.INT64, "date": t.DATE, "datetime": t.DATETIME, "decimal": t.DECIMAL, "real": t.FLOAT64,
}


@dataclass
class Profile:
    """What the rows show of one column."""

    name: str
    rows: int = 0
    nulls: int = 0
    distinct: int = 0
    min_length: int = 0
    max_length: int = 0
    examples: list[str] = field(default_factory=list)
    hits: dict[str, int] = field(default_factory=dict)
    non_negative: bool = False
    minimum: object = None
    maximum: object = None
    mean: float | None = None
    type: str = t.UTF8

    @property
    def filled(self) -> int:
        return self.rows - self.nulls

    def share(self, hit: str) -> float:
        return self.hits.get(hit, 0) / self.filled if self.filled else 0.0

    @property
    def unique_ratio(self) -> float:
        return self.distinct / self.filled if self.filled else 0.0


def _shapes(text: Column) -> dict[str, Column]:
    mark = "|".join(__import__("re").escape(c) for c in values.CURRENCIES)
    return {
        "currency": text.rlike(f"^({mark})\\s*[-+0-9.,]|[0-9]\\s*({mark})$"), "cents": text.rlike(r"[.,]\d\d(\D*)$"), "code": text.rlike("^[A-Z]{2}$"),
        "email": text.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s.]+$"), "percent": text.rlike(r"\d\s*%$"),
    }


def _dealt(df: DataFrame, piece: int) -> DataFrame:
    """The rows in tasks of ``piece`` bytes, as the planner knows them: what a task holds of different values doesn't grow with the table."""
    size = files.planned_bytes(df)
    pieces = -(-size // piece) if size < UNKNOWN else 1  # a sample that was made here, or rows already in tasks
    return df.repartition(pieces, *(F.col(f"`{c}`") for c in df.columns)) if pieces > 1 else df


def profile(sample: DataFrame, names: list[str], dialect: t.Dialect) -> list[Profile]:
    """Profiles of text columns, a sample's or a whole file's, in two passes: counts first, then bounds in the type decided on."""
    if not names:
        return []
    places = range(len(names))
    sample = _dealt(sample.toDF(*(f"c{k}" for k in places)), TEXT_PIECE).cache()
    try:
        # A typed column's nulls, whatever the type turns out to be.  Each step is a projection of its own, worked out once.
        texts = sample.select(*(F.when(~values.is_null(F.col(f"c{k}"), t.INT64), values.trimmed(F.col(f"c{k}"))).alias(f"c{k}") for k in places))
        tests, first = [], []
        for k in places:
            text = F.col(f"c{k}")
            hits = {hit: values.parsed(text, kind, dialect).isNotNull() for hit, kind in _HITS.items()} | _shapes(text) | {"negative": values.parsed(text, t.FLOAT64, dialect) < 0}
            tests += [c.alias(f"c{k}_{h}") for h, c in hits.items()]
            stats = {"filled": F.count(text), "min_length": F.min(F.octet_length(text)), "max_length": F.max(F.octet_length(text))} | {f"hit_{h}": F.count_if(f"c{k}_{h}") for h in hits}
            first.append(F.struct(*(c.alias(n) for n, c in stats.items())).alias(f"c{k}"))
        row = texts.select("*", *tests).agg(F.count(F.lit(1)).alias("rows"), *first).first()
        distinct, examples = _different(texts)
        found = []
        for k, name in enumerate(names):
            r = row[f"c{k}"]
            hits = {h: r[f"hit_{h}"] for h in (*_HITS, "currency", "cents", "code", "email", "percent")}
            p = Profile(name, row.rows, row.rows - r["filled"], distinct.get(k, 0), r["min_length"] or 0, r["max_length"] or 0, examples.get(k, []), hits, r["hit_negative"] == 0)
            p.type = decide(p)
            found.append(p)
        second = []
        for k, p in enumerate(found):
            raw = F.col(f"c{k}")
            value = F.when(~values.is_null(raw, p.type), values.parsed(raw, p.type, dialect))
            mean = F.avg(value.cast("double")) if p.type in t.NUMERIC else F.lit(None).cast("double")
            second.append(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"), mean.alias("mean")).alias(f"c{k}"))
        row = sample.agg(*second).first()
        for k, p in enumerate(found):
            p.minimum, p.maximum, p.mean = row[f"c{k}"]
        return found
    finally:
        sample.unpersist()


def _different(texts: DataFrame) -> tuple[dict[int, int], dict[int, list[str]]]:
    """How many different texts each column has, by place, and the least short ones of them."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).alias("text")) for k, c in enumerate(texts.columns))))
    kept = texts.select(each.alias("x")).select("x.*").where("text IS NOT NULL").distinct()
    least = kept.where(F.length("text") <= EXAMPLE_LENGTH).withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("text"))).where(F.col("place") <= EXAMPLES)
    counts = kept.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.select("k", "n", F.lit(None).cast("string").alias("text")).unionAll(least.select("k", F.lit(None).cast("bigint"), "text")).collect()
    distinct, examples = {r.k: r.n for r in rows if r.n is not None}, {}
    for r in sorted((r for r in rows if r.n is None), key=lambda r: r.text.encode()):
        examples.setdefault(r.k, []).append(r.text)
    return distinct, examples


def decide(p: Profile) -> str:
    """The type nearly all values parse as, the narrowest first; text where none fits."""
    if not p.filled:
        return t.UTF8
    fits = lambda hit: p.share(hit) >= TYPE_SHARE
    if fits("boolean") and p.distinct <= 2:
        return t.BOOLEAN
    for hit, kind in (("integer", t.INT64), ("date", t.DATE), ("datetime", t.DATETIME)):
        if fits(hit):
            return kind
    if fits("decimal") and (p.share("currency") > CURRENCY_SHARE or p.share("cents") > CENTS_SHARE):
        return t.DECIMAL
    if fits("real"):
        return t.FLOAT64
    return t.CATEGORICAL if p.distinct <= CATEGORY_VALUES and p.unique_ratio <= CATEGORY_SHARE else t.UTF8


def estimate_rows(file_bytes: int, sampled_rows: int, sampled_bytes: int, complete: bool) -> tuple[int, bool]:
    """(rows, exact): the sample's count if it holds all rows, else the file's size over the sample's bytes per row."""
    if complete or not sampled_bytes:
        return sampled_rows, complete
    return round(file_bytes * sampled_rows / sampled_bytes), False


def column_counts(df: DataFrame) -> DataFrame:
    """(name, row_count, null_count, distinct_count, min_length, max_length) of each column of a typed table."""
    made = []
    df = _dealt(df, PIECE)
    for k, name in enumerate(df.columns):
        c = F.col(f"`{name}`")
        text = F.octet_length(c.cast("string")).cast("bigint")
        made += [F.count_if(c.isNull()).alias(f"n{k}"), F.count_distinct(c).alias(f"d{k}"), F.min(text).alias(f"lo{k}"), F.max(text).alias(f"hi{k}")]
    row = lambda k, name: F.struct(F.lit(name).alias("name"), F.col("rows").alias("row_count"), *(F.col(f"{c}{k}").alias(n) for c, n in (("n", "null_count"), ("d", "distinct_count"), ("lo", "min_length"), ("hi", "max_length"))))
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *made)
    return counts.select(F.inline(F.array(*(row(k, name) for k, name in enumerate(df.columns)))))
