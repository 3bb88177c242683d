import pytest

from tabulon import types as t
from tabulon.plans import expr, nl
from tabulon.plans.plan import Plan, PlanError, parse_plan
from tabulon.plans.validator import validate

SCHEMA = t.Schema((
    t.Column("transaction_id", 0, t.INT64, semantic_type="IDENTIFIER"), t.Column("user_id", 1, t.INT64, semantic_type="IDENTIFIER"), t.Column("amount", 2, t.DECIMAL, semantic_type="MONETARY"),
    t.Column("country", 3, t.CATEGORICAL, semantic_type="COUNTRY"), t.Column("timestamp", 4, t.DATETIME, semantic_type="TIMESTAMP"), t.Column("note", 5, t.UTF8), t.Column("rate", 6, t.FLOAT64), t.Column("ok", 7, t.BOOLEAN), t.Column("day", 8, t.DATE), t.Column("odd", 9, t.UNKNOWN),
))


@pytest.mark.parametrize("text", [
    "year(timestamp) == 2025", "country IN ('SK','CZ') AND amount BETWEEN 10 AND 20", "a IS NOT NULL OR NOT (b < 3)", "-a * +b - 3 / (c + 1.5) >= abs(d)", "x NOT IN (1, -2)", "x NOT BETWEEN 1 AND 2", "a <> 'it\\'s' and b = \"q\"",
])
def test_expressions_print_what_they_parse(text):
    tree = expr.parse(text)
    assert expr.parse(expr.to_text(tree)) == tree


@pytest.mark.parametrize("text", ["year(", "a ==", "nosuchfn(a)", "", "a b", "a == 1 == 2", "year(a, b)", "a NOT 3", "'open", "a ; b", "(" * 70 + "a" + ")" * 70])
def test_other_texts_are_rejected(text):
    with pytest.raises(expr.ExpressionError):
        expr.parse(text)


def test_names_once_in_order():
    assert expr.names(expr.parse("b + a BETWEEN a AND c OR year(d) IN (b, 1)")) == ["b", "a", "c", "d"]


def found(*operations):
    return validate(parse_plan({"operations": [*operations]}), SCHEMA)


def where(predicate):
    return found({"type": "filter", "predicate": predicate})


@pytest.mark.parametrize("predicate", [
    "amount > 10", "amount > -5", "amount BETWEEN -5 AND '10 EUR'", "timestamp >= '2025-01-01'", "day == '31.01.2025'", "user_id == 2.5", "user_id == true", "rate IN (-1, 2)", "ok == 1", "ok = 'yes'", "country BETWEEN 'A' AND 'B'",
    "country == note", "lower(note) == 'x'", "length(note) > 3", "amount * user_id > 5", "rate > user_id", "NOT ok", "amount IS NULL", "user_id / 0 > 1", "year(day) IN (2024)",
])
def test_accepted(predicate):
    assert where(predicate).accepted, where(predicate).errors


@pytest.mark.parametrize("predicate", [
    "country == 5", "amount > user_id", "nope == 1", "amount * 2 > 3", "amount + rate > 1", "amount * amount > 1", "note BETWEEN 'a' AND 'b'", "timestamp == 5", "day == timestamp", "user_id == 'x'", "user_id == NULL", "user_id IN (1, NULL)",
    "rate == true", "ok == 2.5", "ok == 7", "year(note) == 1", "hour(day) == 1", "upper(amount) == 'X'", "abs(note) > 1", "user_id", "NOT user_id", "ok AND user_id", "-note == 1", "odd == 1", "amount == 'ten'", "note + 1 > 2",
])
def test_rejected(predicate):
    assert not where(predicate).accepted


def test_aggregates_by_type():
    agg = lambda f, c: found({"type": "aggregate", "function": f, "column": c})
    assert not agg("sum", "country").accepted
    assert not agg("avg", "day").accepted
    assert not agg("max", "ok").accepted
    assert agg("max", "note").plan.aggregates[0].type == t.UTF8
    assert agg("avg", "user_id").plan.aggregates[0].type == t.FLOAT64
    assert agg("count", "ok").plan.aggregates[0].alias == "count_ok"
    assert not found({"type": "aggregate", "function": "sum"}).accepted


def test_implicit_rules_warn():
    listing = found({"type": "project", "columns": ["country", "country"]})
    assert (listing.plan.limit, listing.plan.names) == (1000, ["country", "country"])
    assert "1000 rows" in listing.warnings[0]
    assert not found({"type": "aggregate", "function": "count"}).plan.limit
    grouped = found({"type": "group_by", "column": "rate"})
    assert grouped.plan.names == ["rate", "row_count"]
    assert len(grouped.warnings) == 3
    assert found({"type": "filter", "predicate": "user_id > 1 AND note IS NULL"}).plan.names == ["user_id", "note"]
    assert len(found({"type": "limit", "n": 3}).plan.names) == 9
    dropped = found({"type": "project", "columns": ["note"]}, {"type": "aggregate", "function": "count"})
    assert dropped.plan.names == ["count"]
    assert found({"type": "limit", "n": 9}, {"type": "limit", "n": 4}).plan.limit == 4


def test_names_and_sorts():
    assert not found({"type": "project", "columns": ["note"]}, {"type": "sort", "column": "amount"}).accepted
    assert found({"type": "project", "columns": ["note"]}, {"type": "sort", "by": "NOTE", "order": "descending"}).plan.sorts == [(0, "desc")]
    used = {"type": "project", "columns": ["note"]}
    assert not found(used, {"type": "project", "expr": "length(note)", "as": "note"}).accepted
    assert not found({"type": "filter", "predicate": "y == 1"}, {"type": "project", "expr": "year(day)", "as": "y"}).accepted
    assert not found({"type": "aggregate", "function": "count", "as": "n"}, {"type": "filter", "predicate": "n > 1"}).accepted  # no HAVING
    twice = t.Schema((t.Column("a", 0, t.INT64, "x"), t.Column("b", 1, t.INT64, "X"), t.Column("x", 2, t.INT64)))
    assert twice.resolve("x") is None
    assert twice.resolve("B").index == 1


@pytest.mark.parametrize("plan", [
    "{", "[]", {"operations": []}, {"operations": [{"type": "join"}]}, {"operations": [{"type": "window"}]}, {"operations": [{"type": "distinct"}]}, {"operations": [{"type": "limit", "n": 0}]}, {"operations": [{"type": "limit", "n": True}]},
    {"operations": [{"type": "sort", "column": "a", "order": "up"}]}, {"operations": [{"type": "aggregate", "function": "median", "column": "a"}]}, {"operations": [{"type": "project", "expr": "a+1"}]}, {"operations": [{"type": "filter"}]}, {"operations": [{"type": "project", "columns": [1]}]},
])
def test_plans_that_cannot_be_read(plan):
    with pytest.raises(PlanError):
        parse_plan(plan)


def test_plans_round_trip():
    plan = parse_plan({"operations": [{"type": "compute", "expression": "year(day)", "alias": "y"}, {"type": "where", "condition": "y == 1"}, {"type": "groupby", "column": "country"}, {"type": "agg", "fn": "average", "column": "amount"}, {"type": "order_by", "by": "avg_amount", "order": "desc"}, {"type": "top", "rows": 3}]})
    assert parse_plan(plan.to_json()) == plan
    assert "aggregate avg(amount) AS avg_amount" in plan.to_text()


def test_questions():
    plan = nl.plan_for(SCHEMA, "Show total amount by country in 2025")
    assert [o.type for o in plan.operations] == ["project", "filter", "group_by", "aggregate", "sort"]
    assert plan.operations[3].alias == "sum_amount"
    assert nl.plan_for(SCHEMA, "count by country top 3").operations[-1].rows == 3
    assert nl.plan_for(SCHEMA, "show everything").operations[0].type == "project"
    assert nl.plan_for(SCHEMA, "the total of all rows").operations[0].column == "amount"
    for question in ("total amount by country in 2025", "average amount podla country", "how many", "x"):
        assert validate(nl.plan_for(SCHEMA, question), SCHEMA).accepted


def test_providers():
    remote = nl.Remote("far", lambda prompt: "Sure:\n```json\n{\"operations\": [{\"type\": \"limit\", \"n\": 2}]}\n```")
    assert remote.plan(SCHEMA, "two").operations[0].rows == 2
    assert nl.resolve("far", {"far": remote}, {})[0] is remote
    assert nl.resolve("", {"far": remote}, {"TABULON_PROVIDER": "far"})[1] == "environment"
    assert nl.resolve("gone", {}, {})[0].name == "mock"
    assert "12345" not in nl.prompt(SCHEMA, "q")
    with pytest.raises(PlanError):
        nl.reply_plan("I can't")
    assert isinstance(nl.Mock().plan(SCHEMA, "q"), Plan)
