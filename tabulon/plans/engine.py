"""Running plans over datasets: validate, scan, lower, report."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabulon import types as t
from tabulon.plans.lowering import column, lower, quoted
from tabulon.plans.plan import Plan, parse_plan
from tabulon.plans.pruning import ranges
from tabulon.plans.validator import Physical, Validation, validate
from tabulon.report import Report
from tabulon.sources.dataset import Dataset


#: A split of a file is at least this large.
LEAST_SPLIT = 4 << 20


class Rejected(ValueError):
    """A plan the validator doesn't accept."""

    def __init__(self, errors: list[str]) -> None:
        super().__init__("; ".join(errors))
        self.errors = errors


@dataclass
class Options:
    """How to run; ``policy`` is skip, quarantine or fail, and any other name means skip.

    ``partitions`` bounds the splits of the scan; ``measure_baseline`` runs the plan once more in one
    task, for the report's speed-up; ``workers`` is what the report counts with instead of Spark's own
    number of threads.
    """

    policy: str = "skip"
    compat_empty_global: bool = False
    partitions: int | None = None
    measure_baseline: bool = False
    workers: int | None = None
    chunk_rows: int | None = None  # accepted and not used: batches are Spark's matter


@dataclass
class Outcome:
    """The lazy result and what was found out about the plan."""

    df: DataFrame
    plan: Physical
    types: list[str]
    warnings: list[str]
    quarantine: DataFrame | None = None
    report: Report | None = None
    _parts: dict = field(default_factory=dict, repr=False)

    def collect(self) -> list[list]:
        """The rows; fills ``report``, and warns of sums that are too large for their type."""
        began = time.perf_counter()
        rows = [list(r) for r in self.df.collect()]
        seconds = time.perf_counter() - began
        baseline = None
        if (alone := self._parts.get("baseline")) is not None:
            began = time.perf_counter()
            alone.collect()
            baseline = time.perf_counter() - began
        seen: Observation = self._parts["seen"]
        counts = seen.get
        self.report = Report(
            file_bytes=self._parts["bytes"], records=counts["records"] - counts["bad"], bad_rows=counts["bad"], quarantined=counts["bad"] if self.quarantine is not None else 0,
            workers=self._parts["workers"], partitions=self._parts["partitions"], seconds=seconds, groups=len(rows) if self.plan.keys else 0,
            rows_after_filter=self._parts["kept"].get["rows"], limited=bool(self.plan.limit) and len(rows) >= self.plan.limit, baseline_seconds=baseline,
        )
        first = len(self.plan.keys)
        for k, a in enumerate(self.plan.aggregates):
            if a.function == "sum" and a.type == t.INT64 and any(r[first + k] is None for r in rows):
                self.warnings.append(f"a sum of '{a.column}' has no value: nothing to add up, or beyond 64 bits")
        return rows


def types_of(plan: Physical, schema: t.Schema) -> list[str]:
    """The physical type of each result column."""
    kinds = {alias: x.type for alias, x in plan.computed}
    kind = lambda ref: kinds[ref] if ref in kinds else schema.resolve(ref).physical_type
    if plan.aggregates:
        return [kind(ref) for _, ref in plan.keys] + [a.type for a in plan.aggregates]
    return [kind(ref) for _, ref in plan.output]


def check(dataset: Dataset, plan: Plan | str | dict, bounded: bool = True) -> Validation:
    return validate(plan if isinstance(plan, Plan) else parse_plan(plan), dataset.schema, bounded)


def run(dataset: Dataset, plan: Plan | str | dict, options: Options | None = None) -> Outcome:
    """The outcome of a plan; ``Rejected`` or ``PlanError`` if it isn't one for this dataset."""
    options = options or Options()
    found = check(dataset, plan)
    if not found.accepted:
        raise Rejected(found.errors)
    if options.partitions:
        dataset = split(dataset, options.partitions)
    scan = dataset.scan(found.plan.scanned, options.policy)
    out = _outcome(dataset, found, scan.rows, scan, options)
    if options.measure_baseline:
        again = dataset.scan(found.plan.scanned, options.policy)
        out._parts["baseline"] = _outcome(dataset, found, again.rows.coalesce(1), again, options).df
    return out


def split(dataset: Dataset, partitions: int) -> Dataset:
    """The dataset read in at most so many splits, none below ``LEAST_SPLIT`` bytes: rows aren't dealt anew for it."""
    size = dataset.bytes()
    wanted = max(1, min(partitions, size // LEAST_SPLIT))
    spark = SparkSession.active()
    session = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if session.conf.isModifiable(name):
            session.conf.set(name, value)
    session.conf.set("spark.sql.files.maxPartitionBytes", str(-(-size // wanted) or 1))
    session.conf.set("spark.sql.files.minPartitionNum", str(wanted))
    session.conf.set("spark.sql.files.openCostInBytes", "0")
    return dataset.on(session)


def _outcome(dataset: Dataset, found: Validation, source: DataFrame, scan, options: Options) -> Outcome:
    spark = source.sparkSession
    seen, kept = Observation(), Observation()
    source = source.observe(seen, F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(F.col(scan.bad).cast("bigint")), F.lit(0)).alias("bad"))
    good = source.where(~F.col(scan.bad)) if scan.checked else source
    good = good.select(*(quoted(n) for n in found.plan.scanned)) if found.plan.scanned else good
    # The filters run below the second count, and not again above it.
    env = {name: F.col(quoted(name)) for name in good.columns}
    for alias, typed in found.plan.computed:
        env[alias] = column(typed, env)
    for typed in found.plan.filters:
        good = good.where(column(typed, env))
    good = good.observe(kept, F.count(F.lit(1)).alias("rows"))
    df = lower(good, replace(found.plan, filters=[]), options.compat_empty_global)
    parts = {"seen": seen, "kept": kept, "bytes": dataset.bytes(), "workers": options.workers or spark.sparkContext.defaultParallelism, "partitions": options.partitions or 0}
    return Outcome(df, found.plan, types_of(found.plan, dataset.schema), [*found.warnings], scan.quarantine if options.policy == "quarantine" else None, _parts=parts)


def query(dataset: Dataset, plan: Plan | str | dict, compat_empty_global: bool = False, bounded: bool = True) -> DataFrame:
    """The plain lazy result of a plan, without the report's counters; not ``bounded`` it is for writing, not for bringing back."""
    found = check(dataset, plan, bounded)
    if not found.accepted:
        raise Rejected(found.errors)
    scan = dataset.scan(found.plan.scanned, "skip", ranges(found.plan))
    rows = scan.rows.where(~F.col(scan.bad)).drop(scan.bad) if scan.checked else scan.rows.drop(scan.bad)
    return lower(rows, found.plan, compat_empty_global)
