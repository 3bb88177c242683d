"""A deterministic planner from questions to plans, and the protocol of other providers."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Protocol

from tabulon import types as t
from tabulon.operators.infer import Hint, normalised
from tabulon.operators.profile import Profile
from tabulon.plans.plan import Operation, Plan, PlanError, parse_plan

# Fixed words of the question language.
GROUP_WORDS = ("by", "per", "podla")
LIMIT_WORDS = ("top", "first", "limit")
AGGREGATE_WORDS = {
    "total": "sum", "sum": "sum", "revenue": "sum", "average": "avg", "avg": "avg", "mean": "avg", "minimum": "min", "min": "min",
    "maximum": "max", "max": "max", "count": "count", "how": "count", "number": "count",
}
#: How many words from a keyword on may name its column.
REACH = 4
#: Longest name and reason that are taken from a provider.
MAX_NAME, MAX_WHY = 64, 200


class Provider(Protocol):
    """Whatever proposes names for a schema or turns a question into a plan."""

    name: str

    def plan(self, schema: t.Schema, question: str) -> Plan: ...


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9_]+", text.lower())


def column_for(schema: t.Schema, asked: list[str]) -> str:
    """The column named by the first word that is a column's name, else by the first that is part of one; empty if none."""
    whole = {name.lower(): c.query_name for c in reversed(schema.columns) for name in (c.physical_name, c.semantic_name) if name}
    for word in asked:
        if word in whole:
            return whole[word]
    for word in asked:
        if len(word) >= 4:
            for c in schema.columns:
                if word in c.query_name.lower():
                    return c.query_name
    return ""


def _temporal(schema: t.Schema) -> str:
    return next((c.query_name for c in schema.columns if c.physical_type in t.TEMPORAL), "")


def _measure(schema: t.Schema) -> str:
    """What to add up when a question doesn't say: money if there is any, else a quantity, else another number that is no key."""
    for fits in (lambda c: c.semantic_type == "MONETARY", lambda c: c.physical_type == t.DECIMAL, lambda c: c.semantic_type == "QUANTITY", lambda c: c.semantic_type != "IDENTIFIER"):
        for c in schema.columns:
            if c.physical_type in t.NUMERIC and fits(c):
                return c.query_name
    return ""


def plan_for(schema: t.Schema, question: str) -> Plan:
    """A year filters, ``by`` groups, a keyword aggregates and sorts, ``top N`` limits; with none of these all rows are listed."""
    asked, operations = words(question), []
    years = [w for w in asked if re.fullmatch(r"\d{4}", w) and 1900 <= int(w) <= 2100]
    if years and (temporal := _temporal(schema)):
        operations += [Operation("project", expr=f"year({temporal})", alias="year"), Operation("filter", predicate=f"year == {years[-1]}")]
    key = next(filter(None, (column_for(schema, asked[k + 1 : k + REACH]) for k, w in enumerate(asked[:-1]) if w in GROUP_WORDS)), "")
    if key:
        operations.append(Operation("group_by", columns=(key,)))
    at = next((k for k, w in enumerate(asked) if w in AGGREGATE_WORDS), None)
    if at is not None:
        function = AGGREGATE_WORDS[asked[at]]
        column = "" if function == "count" else column_for(schema, asked[at : at + REACH]) or _measure(schema)
        alias = f"{function}_{column}" if column else "row_count"
        operations += [Operation("aggregate", function=function if column else "count", column=column, alias=alias), Operation("sort", column=alias, order="desc")]
    elif key:
        operations.append(Operation("aggregate", function="count", alias="row_count"))
    else:
        operations.append(Operation("project", columns=tuple(c.query_name for c in schema.columns if c.physical_type != t.UNKNOWN)))
    limits = [int(b) for a, b in zip(asked, asked[1:], strict=False) if a in LIMIT_WORDS and b.isdecimal()]
    if limits and limits[-1] > 0:
        operations.append(Operation("limit", rows=limits[-1]))
    return Plan(tuple(operations), question, "mock")


class Mock:
    """The planner above as a provider."""

    name = "mock"

    def plan(self, schema: t.Schema, question: str) -> Plan:
        return plan_for(schema, question)


def prompt(schema: t.Schema, question: str) -> str:
    """What a remote provider is told: the columns and the language, never a row."""
    columns = [{"name": c.query_name, "type": c.physical_type, "meaning": c.semantic_type} for c in schema.columns]
    return "\n".join((
        "Answer with one JSON object {\"operations\": [...]} and nothing else.",
        "Operations: project, filter, group_by, aggregate (count, sum, avg, min, max), sort, limit.",
        "They always run as: computed columns, filters, grouping and aggregates, sort, limit.",
        f"Columns: {json.dumps(columns)}",
        f"Question: {question}",
    ))


def reply_plan(reply: str) -> Plan:
    """The plan in a provider's reply, with or without a code fence around it."""
    text = _object(reply)
    if not text:
        raise PlanError("the reply holds no JSON object")
    return parse_plan(text)


def _object(reply: str) -> str:
    """The JSON object in a reply, or nothing."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", reply, re.S)
    text = fenced[1] if fenced else reply
    start, end = text.find("{"), text.rfind("}")
    return text[start : end + 1] if 0 <= start < end else ""


def schema_prompt(schema: t.Schema, profiles: list[Profile]) -> str:
    """What a remote provider is told for naming columns: types and figures of a sample, never a value."""
    known = {p.name: p for p in profiles}
    columns = []
    for c in schema.columns:
        p = known.get(c.physical_name)
        figures = {"filled": round(p.filled / p.rows, 3) if p.rows else 0.0, "different": round(p.unique_ratio, 3), "shortest": p.min_length, "longest": p.max_length} if p else {}
        columns.append({"index": c.index, "label": c.physical_name, "type": c.physical_type} | figures)
    return "\n".join((
        "Answer with one JSON object {\"columns\": [{\"index\", \"name\", \"meaning\", \"confidence\", \"why\"}]} and nothing else.",
        f"Meanings: {', '.join(t.SEMANTIC)}. A confidence lies between 0 and 1.",
        f"Columns: {json.dumps(columns)}",
    ))


def reply_hints(reply: str, schema: t.Schema) -> list[Hint]:
    """The proposals in a provider's reply, one for each column at most: names made plain, unknown meanings and confidences outside 0 to 1 put right, all else passed over."""
    text = _object(reply)
    try:
        said = json.loads(text).get("columns") if text else None
    except ValueError as reason:
        raise PlanError(f"the reply isn't JSON: {reason}") from None
    found: dict[int, Hint] = {}
    places = {c.index: c for c in schema.columns}
    for one in said if isinstance(said, list) else ():
        index = one.get("index") if isinstance(one, dict) else None
        if isinstance(index, bool) or not isinstance(index, int) or index not in places or index in found:
            continue
        confidence = one.get("confidence", 0)
        sure = float(confidence) if isinstance(confidence, int | float) and confidence == confidence else 0.0
        name = normalised(str(one.get("name") or ""))[:MAX_NAME] or places[index].query_name
        found[index] = Hint(index, name, t.semantic_type(str(one.get("meaning") or "")), min(1.0, max(0.0, sure)), str(one.get("why") or "")[:MAX_WHY])
    return [found[k] for k in sorted(found)]


@dataclass
class Remote:
    """A provider behind a function from a prompt to a reply; how that is sent is the caller's matter."""

    name: str
    ask: Callable[[str], str]

    def plan(self, schema: t.Schema, question: str) -> Plan:
        found = reply_plan(self.ask(prompt(schema, question)))
        return Plan(found.operations, question, self.name)

    def names(self, schema: t.Schema, profiles: list[Profile]) -> list[Hint]:
        """Proposals for ``pipeline.inspect``; a person still has to confirm them."""
        return reply_hints(self.ask(schema_prompt(schema, profiles)), schema)


def resolve(asked: str = "", available: Mapping[str, Provider] | None = None, environment: Mapping[str, str] | None = None, configured: Mapping[str, str] | None = None) -> tuple[Provider, str]:
    """The provider named by the caller, the variable TABULON_PROVIDER or a configuration, in this order, or the mock; and why."""
    available = available or {}
    environment = os.environ if environment is None else environment
    for where, name in (("argument", asked), ("environment", environment.get("TABULON_PROVIDER", "")), ("configuration", (configured or {}).get("provider", ""))):
        if name:
            return (available[name], where) if name in available else (Mock(), f"{where} names {name}, which isn't set up")
    return Mock(), "default"
