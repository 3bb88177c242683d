"""The command line: profile, schema, query, plan, gen, bench, models and selftest."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession

from tabulon import pipeline
from tabulon import types as t
from tabulon.plans import engine, nl
from tabulon.plans.plan import PlanError
from tabulon.sources import generator

SHOWN_ROWS = 50


def session(workers: int | None = None) -> SparkSession:
    """A local session with what the engine's rules ask for."""
    builder = SparkSession.builder.master(f"local[{workers or '*'}]").appName("tabulon")
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.legacy.javaCharsets": "true", "spark.ui.enabled": "false"}
    return builder.config(map=settings).getOrCreate()


def table(outcome: engine.Outcome, rows: list[list]) -> str:
    """The first rows as a table of text."""
    cells = [outcome.plan.names, *([t.display(v, k) for v, k in zip(row, outcome.types, strict=True)] for row in rows[:SHOWN_ROWS])]
    widths = [max(map(len, column)) for column in zip(*cells, strict=True)]
    lines = ["  ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)).rstrip() for row in cells]
    more = [f"... {len(rows) - SHOWN_ROWS} more"] if len(rows) > SHOWN_ROWS else []
    return "\n".join([lines[0], "  ".join("-" * w for w in widths), *lines[1:], *more])


def as_json(outcome: engine.Outcome, rows: list[list]) -> str:
    """The result with its names, types and warnings."""
    return json.dumps({"columns": outcome.plan.names, "types": outcome.types, "rows": [[None if v is None else t.display(v, k) for v, k in zip(row, outcome.types, strict=True)] for row in rows], "warnings": outcome.warnings})


def _show(outcome: engine.Outcome, json_output: bool) -> None:
    rows = outcome.collect()
    if json_output:
        print(as_json(outcome, rows))
        return
    print(outcome.plan.to_text(), table(outcome, rows), outcome.report.to_text(), sep="\n\n")
    for warning in outcome.warnings:
        print(f"warning: {warning}", file=sys.stderr)


BENCH_PLAN = {"operations": [
    {"type": "project", "expr": "year(timestamp)", "as": "y"}, {"type": "filter", "predicate": "y == 2025"}, {"type": "group_by", "column": "country"},
    {"type": "aggregate", "function": "sum", "column": "amount", "as": "total"}, {"type": "sort", "column": "total", "order": "desc"},
]}


def bench_splits(spark: SparkSession, folder: str, rows: int, repeats: int) -> Iterator[str]:
    """Seconds of a grouped sum over generated text, for growing numbers of splits."""
    generator.generate(spark, folder, rows)
    found = pipeline.inspect(spark, folder, use_sidecar=False)
    yield "splits\tseconds\tMiB/s"
    splits = 1
    while splits <= max(1, spark.sparkContext.defaultParallelism):
        reports = []
        for _ in range(repeats):
            outcome = pipeline.run(found, BENCH_PLAN, engine.Options(partitions=splits))
            outcome.collect()
            reports.append(outcome.report)
        best = min(reports, key=lambda r: r.seconds)
        yield f"{splits}\t{best.seconds:.3f}\t{best.throughput:.1f}"
        splits *= 2


def selftest_of(spark: SparkSession, folder: str) -> list[str]:
    """What a generated file's scan gets wrong, over several splits and with corrupt rows."""
    totals = generator.generate(spark, folder, 5_000, corrupt=0.02, partitions=4)
    found = pipeline.inspect(spark, folder, use_sidecar=False)
    plan = {"operations": [{"type": "aggregate", "function": "count"}, {"type": "aggregate", "function": "sum", "column": "amount"}]}
    want, wrong = [totals.rows - totals.corrupted, totals.total_amount], []
    for splits in (1, 7):
        outcome = pipeline.run(found, plan, engine.Options(partitions=splits))
        got = outcome.collect()[0]
        if got != want or outcome.report.bad_rows != totals.corrupted:
            wrong.append(f"{splits} splits: {got} and {outcome.report.bad_rows} bad rows, not {want} and {totals.corrupted}")
    return wrong


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tabulon")
    parser.add_argument("--workers", type=int)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("profile", "schema", "query", "plan"):
        command = commands.add_parser(name)
        command.add_argument("file")
        if name == "schema":
            command.add_argument("--confirm", action="store_true")
        if name in ("query", "plan"):
            command.add_argument("question" if name == "query" else "plan")
            command.add_argument("--policy", default="skip")
            command.add_argument("--json", action="store_true")
            command.add_argument("--partitions", type=int)
    gen = commands.add_parser("gen")
    gen.add_argument("folder")
    gen.add_argument("--rows", type=int, default=100_000)
    gen.add_argument("--seed", type=int, default=generator.DEFAULT_SEED)
    gen.add_argument("--corrupt", type=float, default=0.0)
    gen.add_argument("--no-header", action="store_true")
    gen.add_argument("--null", type=float, default=0.01)
    gen.add_argument("--delimiter", default=",")
    gen.add_argument("--decimal", default=".")
    gen.add_argument("--files", type=int, default=1)
    bench = commands.add_parser("bench")
    bench.add_argument("folder")
    bench.add_argument("--rows", type=int, default=1_000_000)
    bench.add_argument("--repeats", type=int, default=3)
    commands.add_parser("models")
    selftest = commands.add_parser("selftest")
    selftest.add_argument("folder")
    args = parser.parse_args(arguments)
    spark = session(args.workers)
    try:
        if args.command == "gen":
            print(generator.generate(spark, args.folder, args.rows, args.seed, not args.no_header, args.corrupt, args.null, args.delimiter, args.decimal, args.files))
            return 0
        if args.command == "models":
            chosen, why = nl.resolve()
            print(f"{chosen.name}\t{why}")
            return 0
        if args.command == "bench":
            for line in bench_splits(spark, args.folder, args.rows, args.repeats):
                print(line)
            return 0
        if args.command == "selftest":
            wrong = selftest_of(spark, args.folder)
            print("\n".join(wrong) or "all answers are right")
            return 1 if wrong else 0
        found = pipeline.inspect(spark, args.file, use_sidecar=args.command != "profile")
        if args.command in ("profile", "schema"):
            if args.command == "schema" and args.confirm:
                pipeline.confirm(found)
            for note in found.notes:
                print(note)
            for c in found.schema.columns:
                print(f"{c.physical_name}\t{c.physical_type}\t{c.semantic_name}\t{c.semantic_type}\t{c.confidence:.2f}{' confirmed' * c.confirmed}")
            return 0
        options = engine.Options(policy=args.policy, partitions=args.partitions)
        if args.command == "query":
            provider, _ = nl.resolve()
            _show(pipeline.ask(found, args.question, provider, options), args.json)
        else:
            _show(pipeline.run(found, Path(args.plan).read_text(encoding="utf-8"), options), args.json)
        return 0
    except (PlanError, engine.Rejected, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
