"""Logical plans: six operations, read from JSON and written back."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

MAX_JSON_DEPTH = 64
AGGREGATES = {"count": "count", "sum": "sum", "avg": "avg", "average": "avg", "min": "min", "minimum": "min", "max": "max", "maximum": "max"}
_TYPES = {"project": "project", "map": "project", "compute": "project", "filter": "filter", "where": "filter", "group_by": "group_by", "groupby": "group_by", "aggregate": "aggregate", "agg": "aggregate", "sort": "sort", "order_by": "sort", "limit": "limit", "top": "limit"}
_ORDERS = {"asc": "asc", "ascending": "asc", "desc": "desc", "descending": "desc"}


class PlanError(ValueError):
    """A plan that can't be read."""


@dataclass(frozen=True)
class Operation:
    """One step; only the fields of its type are set."""

    type: str
    columns: tuple[str, ...] = ()
    expr: str = ""
    alias: str = ""
    predicate: str = ""
    function: str = ""
    column: str = ""
    order: str = "asc"
    rows: int = 0

    def to_json(self) -> dict:
        out: dict = {"type": self.type}
        match self.type:
            case "project":
                out |= ({"columns": [*self.columns]} if self.columns else {}) | ({"expr": self.expr, "as": self.alias} if self.expr else {})
            case "filter":
                out["predicate"] = self.predicate
            case "group_by":
                out["columns"] = [*self.columns]
            case "aggregate":
                out |= {"function": self.function, **({"column": self.column} if self.column else {}), "as": self.alias}
            case "sort":
                out |= {"column": self.column, "order": self.order}
            case "limit":
                out["n"] = self.rows
        return out

    def to_text(self) -> str:
        match self.type:
            case "project":
                return "project " + ", ".join([*self.columns, *([f"{self.expr} AS {self.alias}"] if self.expr else [])])
            case "filter":
                return f"filter {self.predicate}"
            case "group_by":
                return "group_by " + ", ".join(self.columns)
            case "aggregate":
                return f"aggregate {self.function}({self.column or '*'}) AS {self.alias}"
            case "sort":
                return f"sort {self.column} {self.order}"
        return f"limit {self.rows}"


@dataclass(frozen=True)
class Plan:
    """A list of operations and the question they answer, if there was one."""

    operations: tuple[Operation, ...]
    question: str = ""
    provider: str = ""
    notes: tuple[str, ...] = field(default=())

    def to_json(self) -> str:
        return json.dumps({"operations": [o.to_json() for o in self.operations]})

    def to_text(self) -> str:
        return "\n".join(f"{k}. {o.to_text()}" for k, o in enumerate(self.operations, 1))


def _first(data: dict, *keys: str) -> object | None:
    return next((data[k] for k in keys if k in data), None)


def _text(data: dict, *keys: str) -> str:
    value = _first(data, *keys)
    return value if isinstance(value, str) else ""


def _names(data: dict, *keys: str) -> tuple[str, ...]:
    value = _first(data, *keys)
    if value is None:
        return ()
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise PlanError(f"{keys[0]} must be a list of names")
    return tuple(value)


def _operation(data: object) -> Operation:
    if not isinstance(data, dict) or not isinstance(data.get("type"), str):
        raise PlanError("every operation says its type")
    kind = _TYPES.get(data["type"].lower())
    match kind:
        case "project":
            columns, expr, alias = _names(data, "columns"), _text(data, "expr", "expression"), _text(data, "as", "alias")
            if not columns and not expr:
                raise PlanError("project lists columns or gives an expr")
            if expr and not alias:
                raise PlanError("a computed column has to be named with as")
            return Operation(kind, columns=columns, expr=expr, alias=alias)
        case "filter":
            if not (predicate := _text(data, "predicate", "expr", "condition")):
                raise PlanError("a filter without a predicate keeps nothing apart")
            return Operation(kind, predicate=predicate)
        case "group_by":
            columns = _names(data, "columns") or tuple(filter(None, (_text(data, "column"),)))
            if not columns:
                raise PlanError("group_by has to say by which columns")
            return Operation(kind, columns=columns)
        case "aggregate":
            function = AGGREGATES.get(_text(data, "function", "fn").lower())
            if not function:
                raise PlanError(f"unknown aggregate function {_text(data, 'function', 'fn')!r}")
            column = _text(data, "column")
            return Operation(kind, function=function, column=column, alias=_text(data, "as", "alias") or (f"{function}_{column}" if column else function))
        case "sort":
            order = _ORDERS.get((_text(data, "order") or "asc").lower())
            if not (column := _text(data, "column", "by")) or not order:
                raise PlanError("a sort is by a column, asc or desc")
            return Operation(kind, column=column, order=order)
        case "limit":
            rows = _first(data, "n", "rows", "limit")
            if isinstance(rows, float) and rows.is_integer():
                rows = int(rows)
            if not isinstance(rows, int) or isinstance(rows, bool) or rows <= 0:
                raise PlanError("a limit is a whole number of rows from 1 on")
            return Operation(kind, rows=rows)
    raise PlanError(f"unknown operation {data['type']!r}")


def _depth(data: object, left: int = MAX_JSON_DEPTH) -> None:
    if left < 0:
        raise PlanError(f"JSON nested deeper than {MAX_JSON_DEPTH}")
    for value in data.values() if isinstance(data, dict) else data if isinstance(data, list) else ():
        _depth(value, left - 1)


def parse_plan(source: str | dict) -> Plan:
    """A plan from JSON text or its data; ``PlanError`` if it isn't one."""
    if isinstance(source, str):
        try:
            source = json.loads(source)
        except (ValueError, RecursionError) as e:
            raise PlanError(f"not JSON: {e}") from None
    _depth(source)
    if not isinstance(source, dict) or not isinstance(source.get("operations"), list) or not source["operations"]:
        raise PlanError("a plan is an object with a list of operations")
    return Plan(tuple(map(_operation, source["operations"])))
