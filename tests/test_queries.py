"""Every registered query of the plan engine against its SQL, and streams against batches."""

import duckdb
import pytest

from tabulon import types as t
from tabulon.plans import catalog, engine
from tabulon.plans.engine import Rejected
from tabulon.streaming import stream

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", catalog.queries())
def test_query(spark, sql, name):
    df = catalog.queries()[name](spark, DATA)
    want = sql.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert got == sorted(repr(tuple(r[k] for k in places)) for r in want.fetchall())


def test_filters_reach_the_scan(spark):
    plan = {"operations": [{"type": "project", "columns": ["o_orderkey"]}, {"type": "filter", "predicate": "o_orderkey > 5 AND o_orderstatus == 'F'"}]}
    text = engine.query(catalog.dataset(spark, DATA, "orders"), plan)._jdf.queryExecution().toString()
    assert "GreaterThan(o_orderkey,5)" in text
    assert "o_totalprice" not in text.split("ReadSchema")[-1]


def test_nested_columns_cannot_be_referred_to(spark):
    with pytest.raises(Rejected):
        engine.query(catalog.dataset(spark, DATA, "embeddings"), {"operations": [{"type": "project", "columns": ["embedding"]}]})


def test_stream(spark, tmp_path):
    rows = [(k, k % 3, float(k)) for k in range(30)]
    schema = t.Schema((t.Column("k", 0, t.INT64), t.Column("g", 1, t.INT64), t.Column("x", 2, t.FLOAT64)))
    for part in range(3):
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], "k long, g long, x double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    plan = {"operations": [{"type": "filter", "predicate": "k > 4"}, {"type": "group_by", "column": "g"}, {"type": "aggregate", "function": "sum", "column": "k", "as": "s"}]}
    df, mode = stream(spark, str(tmp_path / "in"), schema, plan, max_files=1)
    query = df.writeStream.format("memory").queryName("streamed").outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    want = {g: sum(k for k in range(5, 30) if k % 3 == g) for g in range(3)}
    assert {r.g: r.s for r in spark.table("streamed").collect()} == want
    with pytest.raises(Rejected):
        stream(spark, str(tmp_path / "in"), schema, {"operations": [{"type": "limit", "n": 3}]})


def _explained(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["flagship", "filter_gt", "filter_ge", "filter_lt", "filter_between", "filter_and", "nl_count", "nl_total_by"])
def test_ranges_of_stored_values_reach_the_scan(spark, name):
    text = _explained(catalog.queries()[name](spark, DATA))
    pushed = text.split("PushedFilters: [")[-1].split("]")[0]
    assert any(word in pushed for word in ("GreaterThan", "LessThan")), pushed


@pytest.mark.parametrize("name", [n for n, (_, operations, _) in catalog.PLANS.items() if catalog._ALL in operations and "agg" not in n and not any(o.get("type") in ("sort", "aggregate", "group_by") for o in operations)])
def test_listings_stay_where_their_rows_are(spark, name):
    text = _explained(catalog.queries()[name](spark, DATA))
    assert "SinglePartition" not in text
    assert "GlobalLimit" not in text


def test_profile_counts_scans_once(spark):
    text = _explained(catalog.profile_counts(spark, DATA)).split("== Physical Plan ==")[-1]
    assert text.count("FileScan") <= 1 + text.count("Initial Plan")
