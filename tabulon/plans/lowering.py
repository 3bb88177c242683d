"""Typed plans as DataFrame operations; everything from here on is Catalyst's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon import types as t
from tabulon.functions.scalar import FUNCTIONS
from tabulon.plans.validator import Aggregate, Physical, Typed

_COMPARE = {"==": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__}
_TRY = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}


#: A sort with a limit beyond this is a full sort: top-k keeps its rows, and room for them, in memory.
TOP_K_ROWS = 100_000
_TOP_K_SETTING = "spark.sql.execution.topKSortFallbackThreshold"


def bound_top_k(spark: SparkSession) -> None:
    """Have the session sort in full for large limits, unless it already has a bound of its own."""
    if int(spark.conf.get(_TOP_K_SETTING)) > TOP_K_ROWS:
        spark.conf.set(_TOP_K_SETTING, TOP_K_ROWS)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(x: Typed, env: dict[str, Column]) -> Column:
    """An expression over the columns of ``env``."""
    match x.op:
        case "column":
            return env[x.value]
        case "literal":
            return F.lit(x.value).cast(t.SPARK[x.type])
        case "call":
            return FUNCTIONS[x.value][2](column(x.args[0], env), x.args[0].type)
        case "not":
            return ~column(x.args[0], env)
        case "negate":
            inner = column(x.args[0], env)
            return -inner if x.type == t.FLOAT64 else F.try_subtract(F.lit(0).cast(t.SPARK[x.type]), inner).try_cast(t.SPARK[x.type])
        case "is_null":
            inner = column(x.args[0], env)
            return inner.isNotNull() if x.negated else inner.isNull()
        case "in":
            return _among(x, env)
        case "between":
            subject, low, high = (column(a, env) for a in x.args)
            inside = subject.between(low, high)
            inside = ~inside if x.negated else inside
            # SQL would decide on one bound alone; here any null operand gives null.
            null = reduce(Column.__or__, [c.isNull() for a, c in zip(x.args, (subject, low, high), strict=True) if a.op != "literal"], F.lit(False))
            return inside if all(a.op == "literal" for a in x.args[1:]) else F.when(~null, inside)
        case "and":
            return column(x.args[0], env) & column(x.args[1], env)
        case "or":
            return column(x.args[0], env) | column(x.args[1], env)
    a, b = (column(arg, env) for arg in x.args)
    if x.op in _COMPARE:
        return _COMPARE[x.op](a, b)
    if x.type == t.FLOAT64:
        a, b = a.cast("double"), b.cast("double")
        return F.try_divide(a, b) if x.op == "/" else {"+": Column.__add__, "-": Column.__sub__, "*": Column.__mul__}[x.op](a, b)
    return _TRY[x.op](a, b).try_cast(t.SPARK[x.type])


def _among(x: Typed, env: dict[str, Column]) -> Column:
    subject = column(x.args[0], env)
    items = [column(a, env) for a in x.args[1:]]
    if all(a.op == "literal" for a in x.args[1:]):
        found = subject.isin(*items)
    else:  # null items are passed over
        found = F.when(subject.isNotNull(), reduce(Column.__or__, [F.coalesce(subject == i, F.lit(False)) for i in items]))
    return ~found if x.negated else found


def _aggregate(a: Aggregate, env: dict[str, Column]) -> Column:
    if a.function == "count":
        return F.count(env[a.column] if a.column else F.lit(1)).alias(a.alias)
    value = env[a.column]
    if a.function in ("min", "max"):
        return getattr(F, a.function)(value).alias(a.alias)
    wide = value.cast("decimal(38,0)") if a.input_type == t.INT64 else value
    total = F.sum(wide)
    if a.function == "avg":
        return (total.cast("double") / F.nullif(F.count(value), F.lit(0)).cast("double")).alias(a.alias)
    kind = {t.INT64: "bigint", t.DECIMAL: "decimal(38,4)", t.FLOAT64: "double"}[a.input_type]
    return total.try_cast(kind).alias(a.alias)


def lower(df: DataFrame, plan: Physical, compat_empty_global: bool = False) -> DataFrame:
    """``df``, whose columns are the scanned ones by their query names, put through a plan.

    ``compat_empty_global`` makes a global aggregate over no rows return no row instead of one.
    """
    bound_top_k(df.sparkSession)
    env = {name: F.col(quoted(name)) for name in df.columns}
    for alias, typed in plan.computed:
        env[alias] = column(typed, env)
    for typed in plan.filters:
        df = df.where(column(typed, env))
    if plan.aggregates:
        keys = [env[ref].alias(name) for name, ref in plan.keys]
        made = [_aggregate(a, env) for a in plan.aggregates]
        if keys:
            df = df.groupBy(*keys).agg(*made)
        else:
            df = df.agg(*made, *([F.count(F.lit(1)).alias("__rows")] if compat_empty_global else []))
            df = df.where("__rows > 0").drop("__rows") if compat_empty_global else df
    else:
        df = df.select(*(env[ref].alias(name) for name, ref in plan.output))
    if plan.sorts:
        # Names may repeat in a projection, so the sort goes by place.
        names = [f"_{k}" for k in range(len(plan.names))]
        order = [F.col(names[k]).asc_nulls_last() if way == "asc" else F.col(names[k]).desc_nulls_first() for k, way in plan.sorts]
        df = df.toDF(*names).orderBy(*order)
        df = df.limit(plan.limit) if plan.limit else df
        return df.toDF(*plan.names)
    return df.limit(plan.limit) if plan.limit else df
