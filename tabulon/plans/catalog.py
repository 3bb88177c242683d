"""Every registered query of the plan engine with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabulon import types as t
from tabulon.operators import profile
from tabulon.plans import engine, nl
from tabulon.sources import round_trips
from tabulon.sources.dataset import ParquetDataset

#: Money in the test tables is stored as doubles; as confirmed columns it is decimal, so sums are exact.
MONEY = {
    "orders": {"o_totalprice": t.DECIMAL}, "customer": {"c_acctbal": t.DECIMAL}, "part": {"p_retailprice": t.DECIMAL},
    "lineitem": {"l_extendedprice": t.DECIMAL, "l_discount": t.DECIMAL, "l_tax": t.DECIMAL}, "events": {"value": t.DECIMAL},
}


def dataset(spark: SparkSession, sf_dir: str, table: str, money: bool = True) -> ParquetDataset:
    return ParquetDataset(spark, f"{sf_dir}/{table}.parquet", MONEY.get(table) if money else None)


def _project(*columns: str) -> dict:
    return {"type": "project", "columns": [*columns]}


def _compute(expr: str, alias: str) -> dict:
    return {"type": "project", "expr": expr, "as": alias}


def _filter(predicate: str) -> dict:
    return {"type": "filter", "predicate": predicate}


def _group(*columns: str) -> dict:
    return {"type": "group_by", "columns": [*columns]}


def _agg(function: str, column: str = "", alias: str = "") -> dict:
    return {"type": "aggregate", "function": function} | ({"column": column} if column else {}) | ({"as": alias} if alias else {})


def _sort(column: str, order: str = "asc") -> dict:
    return {"type": "sort", "column": column, "order": order}


def _limit(n: int) -> dict:
    return {"type": "limit", "n": n}


#: Marks plans whose whole result is wanted.
_ALL: dict = {}
_LINE = ("l_orderkey", "l_linenumber")
_PRICE = "CAST(l_extendedprice AS DECIMAL(18,4))"
_TOTAL = "CAST(o_totalprice AS DECIMAL(18,4))"


def _line(expr: str, alias: str, sql: str) -> tuple:
    """A computed column over lineitem, listed with its row's key."""
    return "lineitem", [_project(*_LINE), _compute(expr, alias), _ALL], f"SELECT CAST(l_orderkey AS BIGINT) l_orderkey, CAST(l_linenumber AS BIGINT) l_linenumber, {sql} AS {alias} FROM lineitem"


def _kept(table: str, key: str, predicate: str, sql: str = "") -> tuple:
    """The keys that a filter keeps."""
    return table, [_project(key), _filter(predicate), _ALL], f"SELECT CAST({key} AS BIGINT) AS {key} FROM {table} WHERE {sql or predicate}"


#: name: (table, operations, SQL)
PLANS: dict[str, tuple[str, list[dict], str]] = {
    "flagship": (
        "orders",
        [_compute("year(o_orderdate)", "order_year"), _filter("order_year == 1997"), _group("o_orderpriority"), _agg("sum", "o_totalprice", "revenue"), _sort("revenue", "desc")],
        f"SELECT o_orderpriority, sum({_TOTAL}) AS revenue FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1",
    ),
    "project_columns": ("nation", [_project("n_nationkey", "n_name"), _sort("n_nationkey"), _ALL], "SELECT CAST(n_nationkey AS BIGINT) n_nationkey, n_name FROM nation"),
    "project_expr_add": _line("l_extendedprice + l_tax", "v", "CAST(l_extendedprice AS DECIMAL(18,4)) + CAST(l_tax AS DECIMAL(18,4))"),
    "project_expr_sub": _line("l_orderkey - l_partkey", "v", "CAST(l_orderkey - l_partkey AS BIGINT)"),
    "project_expr_mul": _line("l_extendedprice * l_linenumber", "v", f"CAST({_PRICE} * l_linenumber AS DECIMAL(18,4))"),
    "project_expr_div": _line("l_orderkey / l_linenumber", "v", "CAST(l_orderkey AS DOUBLE) / CAST(l_linenumber AS DOUBLE)"),
    "project_expr_neg": _line("-l_partkey", "v", "CAST(-l_partkey AS BIGINT)"),
    "project_expr_plus_literal": _line("+l_partkey + 7", "v", "CAST(l_partkey + 7 AS BIGINT)"),
    "div_by_zero_null": _line("l_orderkey / (l_linenumber - 1)", "v", "CAST(l_orderkey AS DOUBLE) / NULLIF(CAST(l_linenumber - 1 AS DOUBLE), 0)"),
    "filter_eq": _kept("orders", "o_orderkey", "o_orderstatus == 'F'", "o_orderstatus = 'F'"),
    "filter_ne": _kept("orders", "o_orderkey", "o_orderstatus != 'F'"),
    "filter_lt": _kept("orders", "o_orderkey", "o_totalprice < 1000.5", f"{_TOTAL} < 1000.5"),
    "filter_le": _kept("orders", "o_orderkey", "o_custkey <= 20"),
    "filter_gt": _kept("orders", "o_orderkey", "o_orderdate > '1999-05-01'"),
    "filter_ge": _kept("orders", "o_orderkey", "o_orderdate >= '2000-01-31T00:00:00'"),
    "filter_negative_literal": _kept("customer", "c_custkey", "c_acctbal > -5", "CAST(c_acctbal AS DECIMAL(18,4)) > -5"),
    "filter_and": _kept("orders", "o_orderkey", "o_orderstatus = 'O' AND o_totalprice > 2000", f"o_orderstatus = 'O' AND {_TOTAL} > 2000"),
    "filter_or": _kept("orders", "o_orderkey", "o_orderstatus = 'O' OR o_custkey < 9"),
    "filter_not": _kept("orders", "o_orderkey", "NOT (o_orderstatus = 'O' AND o_custkey < 500)"),
    "filter_in": _kept("part", "p_partkey", "p_size IN (1, 7, 49)"),
    "filter_not_in": _kept("part", "p_partkey", "p_size NOT IN (1, 7, 49)"),
    "filter_in_columns": _kept("lineitem", "l_orderkey", "l_partkey IN (l_suppkey, l_linenumber)"),
    "filter_between": _kept("part", "p_partkey", "p_retailprice BETWEEN 1000 AND 1200", "CAST(p_retailprice AS DECIMAL(18,4)) BETWEEN 1000 AND 1200"),
    "filter_not_between": _kept("part", "p_partkey", "p_size NOT BETWEEN 5 AND 45"),
    "filter_is_null": _kept("events", "event_id", "props IS NULL"),
    "filter_is_not_null": _kept("events", "event_id", "props IS NOT NULL"),
    "filter_after_aggregate_is_where": (
        "orders", [_group("o_orderstatus"), _agg("count", alias="n"), _filter("o_custkey < 100"), _ALL], "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey < 100 GROUP BY 1",
    ),
    "fn_year_month_day": (
        "orders", [_project("o_orderkey"), _compute("year(o_orderdate)", "y"), _compute("month(o_orderdate)", "m"), _compute("day(o_orderdate)", "d"), _ALL],
        "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders",
    ),
    "fn_hour_minute": ("events", [_project("event_id"), _compute("hour(ts)", "h"), _compute("minute(ts)", "m"), _ALL], "SELECT event_id, hour(ts) AS h, minute(ts) AS m FROM events"),
    "fn_lower_upper": (
        "documents", [_project("doc_id"), _compute("lower(text)", "l"), _compute("upper(text)", "u"), _ALL],
        "SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS l, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS u FROM documents",
    ),
    "fn_length": ("documents", [_project("doc_id"), _compute("length(text)", "n"), _ALL], "SELECT doc_id, strlen(text) AS n FROM documents"),
    "fn_abs": ("customer", [_project("c_custkey"), _compute("abs(c_acctbal)", "v"), _ALL], "SELECT c_custkey, abs(CAST(c_acctbal AS DECIMAL(18,4))) AS v FROM customer"),
    "agg_count_star": ("lineitem", [_agg("count", alias="n")], "SELECT count(*) AS n FROM lineitem"),
    "agg_count_col": ("events", [_agg("count", "props", "n")], "SELECT count(props) AS n FROM events"),
    "agg_sum_int": ("lineitem", [_agg("sum", "l_partkey", "v")], "SELECT CAST(sum(l_partkey) AS BIGINT) AS v FROM lineitem"),
    "agg_sum_decimal": ("lineitem", [_agg("sum", "l_extendedprice", "v")], f"SELECT sum({_PRICE}) AS v FROM lineitem"),
    "agg_avg": ("lineitem", [_agg("avg", "l_extendedprice", "v")], f"SELECT CAST(sum({_PRICE}) AS DOUBLE) / count(*) AS v FROM lineitem"),
    "agg_min_max": ("lineitem", [_agg("min", "l_extendedprice"), _agg("max", "l_quantity")], f"SELECT min({_PRICE}) AS min_l_extendedprice, max(l_quantity) AS max_l_quantity FROM lineitem"),
    "agg_text_min_max": ("part", [_agg("min", "p_name", "lo"), _agg("max", "p_name", "hi")], "SELECT min(p_name) AS lo, max(p_name) AS hi FROM part"),
    "agg_date_min_max": ("orders", [_agg("min", "o_orderdate", "lo"), _agg("max", "o_orderdate", "hi")], "SELECT min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders"),
    "agg_multi": (
        "lineitem", [_group("l_returnflag"), _agg("count", alias="n"), _agg("sum", "l_extendedprice", "s"), _agg("avg", "l_discount", "a"), _agg("min", "l_shipdate", "lo"), _agg("max", "l_tax", "hi"), _ALL],
        f"SELECT l_returnflag, count(*) AS n, sum({_PRICE}) AS s, CAST(sum(CAST(l_discount AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS a, min(l_shipdate) AS lo, max(CAST(l_tax AS DECIMAL(18,4))) AS hi FROM lineitem GROUP BY 1",
    ),
    "agg_empty_global": ("orders", [_filter("o_orderkey < 0"), _agg("count", alias="n"), _agg("sum", "o_custkey", "s")], "SELECT 0::BIGINT AS n, NULL::BIGINT AS s"),
    "group_one": ("lineitem", [_group("l_linestatus"), _agg("count", alias="n"), _ALL], "SELECT l_linestatus, count(*) AS n FROM lineitem GROUP BY 1"),
    "group_many": ("lineitem", [_group("l_returnflag", "l_linestatus"), _agg("sum", "l_suppkey", "s"), _ALL], "SELECT l_returnflag, l_linestatus, CAST(sum(l_suppkey) AS BIGINT) AS s FROM lineitem GROUP BY ALL"),
    "group_null": ("events", [_group("props"), _agg("count", alias="n"), _ALL], "SELECT props, count(*) AS n FROM events GROUP BY 1"),
    "group_implicit_count": ("customer", [_group("c_mktsegment"), _ALL], "SELECT c_mktsegment, count(*) AS row_count FROM customer GROUP BY 1"),
    "group_computed_key": (
        "events", [_compute("hour(ts)", "h"), _group("h", "event_type"), _agg("sum", "value", "v"), _ALL],
        "SELECT hour(ts) AS h, event_type, sum(CAST(value AS DECIMAL(18,4))) AS v FROM events GROUP BY ALL",
    ),
    "sort_asc": ("customer", [_project("c_custkey", "c_name"), _sort("c_name"), _sort("c_custkey"), _limit(25)], "SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 25"),
    "sort_desc": ("part", [_project("p_partkey", "p_retailprice"), _sort("p_retailprice", "desc"), _sort("p_partkey"), _limit(25)], "SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18,4)) AS p_retailprice FROM part ORDER BY 2 DESC NULLS FIRST, 1 LIMIT 25"),
    "sort_nulls_desc_first": ("events", [_project("event_id", "props"), _sort("props", "desc"), _sort("event_id"), _limit(50)], "SELECT event_id, props FROM events ORDER BY props DESC NULLS FIRST, event_id LIMIT 50"),
    "limit_smallest_of_several": ("supplier", [_project("s_suppkey"), _sort("s_suppkey"), _limit(9), _limit(4)], "SELECT s_suppkey FROM supplier ORDER BY 1 LIMIT 4"),
    "topk": ("orders", [_project("o_orderkey", "o_totalprice"), _sort("o_totalprice", "desc"), _sort("o_orderkey"), _limit(10)], f"SELECT o_orderkey, {_TOTAL} AS o_totalprice FROM orders ORDER BY 2 DESC NULLS FIRST, 1 LIMIT 10"),
    "default_limit": ("lineitem", [_project(*_LINE), _sort("l_orderkey"), _sort("l_linenumber")], "SELECT CAST(l_orderkey AS BIGINT) l_orderkey, CAST(l_linenumber AS BIGINT) l_linenumber FROM lineitem ORDER BY 1, 2 LIMIT 1000"),
    "implicit_select_filter_only": ("region", [_filter("r_regionkey > 1")], "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey FROM region WHERE r_regionkey > 1"),
    "implicit_select_all": ("region", [_limit(100)], "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region"),
    "implicit_drop_projection": ("orders", [_project("o_orderkey"), _agg("count", alias="n")], "SELECT count(*) AS n FROM orders"),
    "grouped_projection_ignored": ("nation", [_project("n_name"), _group("n_regionkey"), _agg("count", alias="n"), _ALL], "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, count(*) AS n FROM nation GROUP BY 1"),
}

#: name: (table, question, SQL)
QUESTIONS = {
    "nl_total_by": ("orders", "Show total o_totalprice by o_orderpriority in 1997", f"SELECT o_orderpriority, sum({_TOTAL}) AS sum_o_totalprice FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1"),
    "nl_average_by": ("customer", "average c_acctbal per c_mktsegment", "SELECT c_mktsegment, CAST(sum(CAST(c_acctbal AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS avg_c_acctbal FROM customer GROUP BY 1"),
    "nl_count": ("orders", "how many orders in 1998", "SELECT count(*) AS row_count FROM orders WHERE year(o_orderdate) = 1998"),
    "nl_group_only": ("customer", "customers by c_mktsegment", "SELECT c_mktsegment, count(*) AS row_count FROM customer GROUP BY 1"),
    "nl_top_n": ("nation", "count by n_regionkey top 5", "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, count(*) AS row_count FROM nation GROUP BY 1"),
    "nl_listing": ("region", "list everything", "SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region"),
}


def _plan(table: str, operations: list[dict]) -> Callable[[SparkSession, str], DataFrame]:
    asked = {"operations": [o for o in operations if o is not _ALL]}
    return lambda spark, sf_dir: engine.query(dataset(spark, sf_dir, table), asked, bounded=_ALL not in operations)


def _question(table: str, question: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source = dataset(spark, sf_dir, table)
        return engine.query(source, nl.plan_for(source.schema, question))

    return run


def profile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, nulls and distinct values of each column of a table, one row per column."""
    return profile.column_counts(dataset(spark, sf_dir, "customer", money=False).df)


_PROFILED = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS name, count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count, min(strlen(CAST({c} AS VARCHAR))) AS min_length, max(strlen(CAST({c} AS VARCHAR))) AS max_length FROM customer"
    for c in _PROFILED
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: _plan(table, operations) for name, (table, operations, _) in PLANS.items()}
    found |= {name: _question(table, question) for name, (table, question, _) in QUESTIONS.items()}
    return found | {"profile_counts": profile_counts} | {name: run for name, (run, _) in round_trips.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for of in (PLANS, QUESTIONS) for name, (_, _, sql) in of.items()} | {"profile_counts": PROFILE_SQL} | {name: sql for name, (_, sql) in round_trips.QUERIES.items()}
