from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tabulon import cli, pipeline
from tabulon import types as t
from tabulon.operators import infer, profile, sample
from tabulon.plans import engine
from tabulon.sources import generator, round_trips, sidecar, sniff
from tabulon.sources.dataset import CsvDataset

SUM = {"operations": [{"type": "aggregate", "function": "count", "as": "n"}, {"type": "aggregate", "function": "sum", "column": "amount", "as": "s"}]}


def one(folder):
    return str(next(p for p in sorted(folder.glob("part-*")) if p.suffix != ".json"))


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("made") / "t"
    return generator.generate(spark, str(folder), 6000, 7), one(folder)


@pytest.fixture(scope="module")
def inspected(spark, made):
    return pipeline.inspect(spark, made[1], use_sidecar=False)


def test_inference_on_generated_data(inspected):
    assert [c.physical_type for c in inspected.schema.columns] == [t.INT64, t.INT64, t.DECIMAL, t.CATEGORICAL, t.DATETIME]
    assert [c.semantic_type for c in inspected.schema.columns] == ["IDENTIFIER", "IDENTIFIER", "MONETARY", "COUNTRY", "TIMESTAMP"]
    assert inspected.exact
    assert inspected.rows == 6000


def test_known_answers(made, inspected):
    totals, _ = made
    assert engine.run(inspected.dataset, SUM).collect() == [[totals.rows, totals.total_amount]]
    year = {"operations": [{"type": "project", "expr": "year(timestamp)", "as": "y"}, {"type": "filter", "predicate": "y == 2025"}, {"type": "aggregate", "function": "count"}]}
    assert engine.run(inspected.dataset, year).collect() == [[totals.rows_in_2025]]
    groups = engine.run(inspected.dataset, {"operations": [{"type": "group_by", "column": "country"}, {"type": "limit", "n": 99}]})
    rows = groups.collect()
    assert dict(map(tuple, rows))[None] == totals.null_countries
    assert len(rows) == totals.countries + 1
    assert groups.report.records == groups.report.rows_after_filter == totals.rows
    assert groups.report.groups == len(rows)


@pytest.mark.parametrize("partitions", [1, 2, 7, 16])
def test_partitions_do_not_matter(made, inspected, partitions):
    assert engine.run(inspected.dataset, SUM, engine.Options(partitions=partitions)).collect()[0][1] == made[0].total_amount


def test_questions_over_a_file_without_labels(spark, tmp_path):
    totals = generator.generate(spark, str(tmp_path / "t"), 3000, 5, header=False)
    found = pipeline.inspect(spark, one(tmp_path / "t"))
    assert [c.query_name for c in found.schema.columns] == ["transaction_id", "user_id", "amount", "country", "timestamp"] or found.schema.columns[1].semantic_type == "QUANTITY"
    pipeline.confirm(found, {"column_1": "user_id"}, {"column_1": "identifier"})
    again = pipeline.inspect(spark, one(tmp_path / "t"))
    assert again.cached
    assert again.schema == found.schema
    rows = pipeline.ask(again, "total amount by country in 2025").collect()
    assert len(rows) == totals.countries + bool(totals.null_countries)
    assert [r[1] for r in rows] == sorted((r[1] for r in rows), reverse=True)


def test_bad_rows(spark, tmp_path):
    totals = generator.generate(spark, str(tmp_path / "t"), 4000, 11, corrupt=0.02)
    found = pipeline.inspect(spark, one(tmp_path / "t"))
    outcome = engine.run(found.dataset, SUM, engine.Options(policy="quarantine"))
    assert outcome.collect() == [[totals.rows - totals.corrupted, totals.total_amount]]
    assert outcome.report.bad_rows == totals.corrupted
    assert outcome.quarantine.count() == min(100, totals.corrupted)
    assert engine.run(found.dataset, SUM, engine.Options(policy="anything")).collect()[0][0] == totals.rows - totals.corrupted
    with pytest.raises(PySparkException, match="bad row"):
        engine.run(found.dataset, SUM, engine.Options(policy="fail")).collect()


def test_bad_fields_count_only_where_they_are_used(spark, tmp_path):
    file = tmp_path / "x.csv"
    file.write_text("a,b\n1,2\nx,3\n4,\n5\n6,7,8\n")
    schema = t.Schema((t.Column("a", 0, t.INT64), t.Column("b", 1, t.INT64)), t.Dialect(names=("a", "b")))
    source = CsvDataset(spark, str(file), schema)
    count = lambda *ops: engine.query(source, {"operations": [*ops, {"type": "aggregate", "function": "count"}]}).first()[0]
    assert count() == 3
    assert count({"type": "filter", "predicate": "a IS NULL OR a > 0"}) == 2
    assert count({"type": "filter", "predicate": "b > 0"}) == 2


def test_empty_global_aggregate(inspected):
    none = {"operations": [{"type": "filter", "predicate": "user_id < 0"}, {"type": "aggregate", "function": "count"}]}
    assert engine.run(inspected.dataset, none).collect() == [[0]]
    assert engine.run(inspected.dataset, none, engine.Options(compat_empty_global=True)).collect() == []


def test_rejected_plans_do_not_run(inspected):
    with pytest.raises(engine.Rejected, match="there is no sum"):
        engine.run(inspected.dataset, {"operations": [{"type": "aggregate", "function": "sum", "column": "country"}]})


def test_sniffing():
    s = sniff.sniff_bytes(b"id;amount;country\n1;12,5;SK\n2;1 234,50;CZ\n3;7,25;SK\n4;0,99;DE\n5;3,50;SK\n").dialect
    assert (s.delimiter, s.decimal_separator, s.thousands_separator, s.has_header, s.names) == (";", ",", " ", True, ("id", "amount", "country"))
    s = sniff.sniff_bytes(b"1,17,3.50,SK,2025-01-01\n2,18,4.25,CZ,2025-01-02\n3,19,5.75,SK,2025-01-03\n").dialect
    assert not s.has_header
    assert s.names[0] == "column_0"
    s = sniff.sniff_bytes(b'a,b\n1,"x\ny"\n2,z\n').dialect
    assert s.quoted_newlines
    assert sniff.sniff_bytes(b"only\nwords\nhere\n").dialect.names == ("only",)
    assert sniff.column_names(["a", " a ", "", "b"], True) == ("a", "a_2", "column_2", "b")
    with pytest.raises(sniff.UnsupportedEncoding):
        sniff.sniff_bytes("a,b\n".encode("utf-16"))


def test_encodings(spark, tmp_path):
    text = "mesto;počet\nŽilina;5\nŠaľa;7\nKošice;9\n"
    assert sniff.encoding_of(text.encode("cp1250")) == "windows-1250"
    assert sniff.encoding_of(text.encode("iso8859-2")) == "iso-8859-2"
    assert sniff.encoding_of(text.encode()) == "utf-8"
    assert sniff.encoding_of(text.encode()[:-1] + "é".encode()[:1]) == "utf-8"
    (tmp_path / "c.csv").write_bytes(text.encode("cp1250"))
    found = pipeline.inspect(spark, str(tmp_path / "c.csv"))
    rows = engine.run(found.dataset, {"operations": [{"type": "project", "columns": ["mesto"]}, {"type": "sort", "column": "mesto"}]}).collect()
    assert sorted(r[0] for r in rows) == sorted(["Žilina", "Šaľa", "Košice"])


def test_records_of_quoted_text():
    assert [r for r, _ in sniff.records('a,"b,""c""",,d\r\ne,f\r"g\nh"\n', ",")] == [["a", 'b,"c"', "", "d"], ["e", "f"], ["g\nh"]]


def test_samples(inspected):
    a, b = (sample.reservoir(inspected.dataset, 50).rows.collect() for _ in range(2))
    assert a == b
    assert len(a) == 50
    assert sample.reservoir(inspected.dataset, 50, seed=1).rows.collect() != a
    assert sample.head_and_probes(inspected.dataset, 100).rows.count() == 100


def test_labels_and_shapes():
    p = profile.Profile("Total Price", 10, 0, 10, type=t.UTF8)
    assert infer.hints([p], True)[0].semantic_type == "UNKNOWN"
    assert infer.hints([p], True)[0].confidence == 0.20
    q = profile.Profile("2 Unit-Price", 10, 0, 5, type=t.DECIMAL)
    hint = infer.hints([q, q], True)
    assert (hint[0].name, hint[1].name, hint[0].semantic_type, round(hint[0].confidence, 2)) == ("c2_unit_price", "c2_unit_price_2", "MONETARY", 0.90)
    assert [infer.from_label(x) for x in ("user_id", "created_at", "status", "is_new", "qty", "zzz", "iso")] == ["IDENTIFIER", "TIMESTAMP", "STATUS", "FLAG", "QUANTITY", "UNKNOWN", "COUNTRY"]
    assert profile.decide(profile.Profile("x", 5, 5)) == t.UTF8
    assert profile.estimate_rows(1000, 10, 100, False) == (100, False)


def test_sidecar(tmp_path):
    schema = t.Schema((t.Column("a", 0, t.DECIMAL, "x", "MONETARY", 0.9, True),), t.Dialect(delimiter=";", names=("a",)), "f.csv")
    sidecar.save(schema, str(tmp_path / "f.csv"))
    assert sidecar.load(str(tmp_path / "f.csv")) == schema
    (tmp_path / ("g.csv" + sidecar.SUFFIX)).write_text("{")
    assert sidecar.load(str(tmp_path / "g.csv")) is None
    assert sidecar.from_json('{"columns": [{"physical_name": "a", "physical_type": "money"}]}').columns[0].physical_type == t.DECIMAL


def test_corrupt_totals(spark):
    totals = generator.totals(generator.transactions(spark, 1000, 3, corrupt=0.1, partitions=2))
    again = generator.totals(generator.transactions(spark, 1000, 3, corrupt=0.1, partitions=5))
    assert totals == again
    assert 50 < totals.corrupted < 150
    assert Decimal("0.01") <= totals.minimum < totals.maximum <= Decimal(20000)


def test_command_line(made, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda workers: __import__("pyspark").sql.SparkSession.getActiveSession())
    assert cli.main(["query", made[1], "total amount by country"]) == 0
    assert "sum_amount" in capsys.readouterr().out
    (tmp_path / "p.json").write_text('{"operations": [{"type": "limit", "n": 2}]}')
    assert cli.main(["plan", made[1], str(tmp_path / "p.json"), "--json"]) == 0
    assert '"rows"' in capsys.readouterr().out
    assert cli.main(["schema", made[1]]) == 0
    assert cli.main(["models"]) == 0
    assert cli.main(["selftest", str(tmp_path / "own")]) == 0
    assert "all answers are right" in capsys.readouterr().out
    assert cli.main(["bench", str(tmp_path / "timed"), "--rows", "2000", "--repeats", "1"]) == 0
    assert "MiB/s" in capsys.readouterr().out
    (tmp_path / "q.json").write_text('{"operations": [{"type": "join"}]}')
    assert cli.main(["plan", made[1], str(tmp_path / "q.json")]) == 1


@pytest.mark.parametrize("label", ["k,price,word\n", ""])
def test_files_that_hold_no_rows_do_not_hide_the_others(spark, tmp_path, label):
    (tmp_path / "part-0.csv").write_text(label)
    (tmp_path / "part-1.csv").write_text("")
    (tmp_path / "part-2.csv").write_text(label + "1,2.50,a")
    (tmp_path / "part-3.csv").write_text(label + "2,3.25,b\n3,4.75,a\n4,1.25,a\n")
    found = pipeline.inspect(spark, str(tmp_path), use_sidecar=False)
    assert found.schema.dialect.has_header == bool(label)
    assert [c.physical_name for c in found.schema.columns] == (["k", "price", "word"] if label else ["column_0", "column_1", "column_2"])
    assert [c.physical_type for c in found.schema.columns[:2]] == [t.INT64, t.DECIMAL]
    price = found.schema.columns[1].query_name
    plan = {"operations": [{"type": "aggregate", "function": "count", "as": "n"}, {"type": "aggregate", "function": "sum", "column": price, "as": "s"}]}
    assert engine.query(found.dataset, plan).collect() == [(4, Decimal("11.75"))]
    assert sniff.head_of(spark, str(tmp_path)) == (label + "1,2.50,a\n2,3.25,b\n3,4.75,a\n4,1.25,a\n").encode()


def test_a_result_in_many_files_is_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", 5, 1.5), ("b", 7, 2.5), ("c", 9, 3.5)], "word string, n long, most double")
    rows.repartitionByRange(8, F.col("n").desc()).write.csv(str(tmp_path / "first"), header=True, sep=";")
    (tmp_path / "first" / "part-00000-0.csv").write_text("word;n;most\n")
    found = pipeline.inspect(spark, str(tmp_path / "first"), use_sidecar=False)
    listed = engine.query(found.dataset, {"operations": [{"type": "project", "columns": ["word", "n", "most"]}]}, bounded=False)
    assert sorted(map(tuple, listed.collect())) == [("a", 5, 1.5), ("b", 7, 2.5), ("c", 9, 3.5)]


def test_quarantine_holds_all_bad_rows(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n" + "".join(f"{k},1\n" if k % 2 else f"{k}\n" for k in range(500)))
    found = pipeline.inspect(spark, str(tmp_path / "x.csv"), use_sidecar=False)
    outcome = engine.run(found.dataset, {"operations": [{"type": "aggregate", "function": "count"}]}, engine.Options(policy="quarantine"))
    assert outcome.collect() == [[250]]
    assert sorted(int(r[0]) for r in outcome.quarantine.collect()) == [*range(0, 500, 2)]


def test_blanks_and_breaks_around_and_in_texts_are_kept(spark, tmp_path):
    texts = ["  blanks ", "", "\r\nboth", "one\rof\r\neach\n", "\ttab\t", "plain", None, "é\u2028x"]
    made = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").coalesce(1)
    made.write.parquet(str(tmp_path / "documents.parquet"))
    got = {int(r.doc_id): r.body for r in round_trips.csv_quoted_breaks(spark, str(tmp_path)).collect()}
    assert got == {k: x and x + f'\n"quoted", {k}' if x != "" else f'\n"quoted", {k}' for k, x in enumerate(texts)}


def test_rows_are_counted_where_all_are_read(spark, tmp_path, monkeypatch):
    (tmp_path / "x.csv").write_text("a,b\n" + "".join(f"{k},{k % 7}\n" for k in range(sample.TARGET + 1)))
    found = pipeline.inspect(spark, str(tmp_path / "x.csv"), use_sidecar=False)
    assert (found.rows, found.exact) == (sample.TARGET + 1, True)
    monkeypatch.setattr(sample, "SMALL_FILE", 0)
    found = pipeline.inspect(spark, str(tmp_path / "x.csv"), use_sidecar=False)
    assert not found.exact
    assert (found.count(), found.exact) == (sample.TARGET + 1, True)


def test_profile_counts_all_different_values(spark):
    rows = spark.range(100_002).select(F.concat(F.lit("v"), "id").alias("a"), (F.col("id") % 3).cast("string").alias("b"))
    a, b = profile.profile(rows, ["a", "b"], t.Dialect())
    assert (a.rows, a.distinct, a.examples) == (100_002, 100_002, ["v0", "v1", "v10", "v100", "v1000"])
    assert (b.distinct, b.examples) == (3, ["0", "1", "2"])


def test_column_counts_deal_large_tables(spark, tmp_path, monkeypatch):
    spark.range(3000).select("id", (F.col("id") % 7).alias("k"), F.lit(None).cast("string").alias("none")).write.parquet(str(tmp_path / "t"))
    whole = profile.column_counts(spark.read.parquet(str(tmp_path / "t")))
    want = sorted(map(tuple, whole.collect()))
    assert want == [("id", 3000, 0, 3000, 1, 4), ("k", 3000, 0, 7, 1, 1), ("none", 3000, 3000, 0, None, None)]
    monkeypatch.setattr(profile, "PIECE", 1000)
    dealt = profile.column_counts(spark.read.parquet(str(tmp_path / "t")))
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().toString()
    assert sorted(map(tuple, dealt.collect())) == want
