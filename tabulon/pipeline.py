"""From a file nobody has described to answers: inspect, confirm, ask."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

from tabulon import files
from tabulon import types as t
from tabulon.operators import infer, profile, sample
from tabulon.plans import engine, nl
from tabulon.plans.plan import Plan
from tabulon.sources import sidecar, sniff
from tabulon.sources.dataset import CsvDataset


@dataclass
class Inspection:
    """What is known of a file; ``cached`` if a kept schema spared the look."""

    dataset: CsvDataset
    profiles: list[profile.Profile] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    rows: int = 0
    exact: bool = False
    cached: bool = False

    @property
    def schema(self) -> t.Schema:
        return self.dataset.schema

    def count(self) -> int:
        """The exact number of rows; reads the whole file if ``rows`` is an estimate."""
        if not self.exact:
            self.rows, self.exact = self.dataset.count(), True
        return self.rows


def inspect(spark: SparkSession, path: str, use_sidecar: bool = True, proposals: list[infer.Hint] | None = None) -> Inspection:
    """Sniff, sample, profile and infer, unless a confirmed schema is kept next to the file."""
    if use_sidecar and (kept := sidecar.load(path)):
        return Inspection(CsvDataset(spark, path, kept), cached=True)
    seen = sniff.sniff(spark, path)
    raw = CsvDataset(spark, path, sniff.text_schema(seen.dialect))
    picked = sample.sample(raw)
    profiles = profile.profile(picked.rows, [*seen.dialect.names], seen.dialect)
    schema = infer.build(seen.dialect, profiles, path)
    named = proposals if proposals is not None else ([] if seen.dialect.has_header else infer.named_by_convention(infer.hints(profiles, False)))
    schema = infer.overlay(schema, named)
    if kept := sidecar.load(path):
        schema = overlay_confirmed(schema, kept)
    length = files.length(spark, path)
    n = profiles[0].rows if profiles else 0
    head = sniff.head_of(spark, path)
    per_row = len(head) / max(1, head.count(b"\n"))
    rows, exact = (picked.total, True) if picked.total is not None else profile.estimate_rows(length, n, round(n * per_row), picked.complete)
    return Inspection(CsvDataset(spark, path, schema), profiles, [*seen.notes, f"sample: {picked.method}"], rows, exact)


def overlay_confirmed(schema: t.Schema, kept: t.Schema) -> t.Schema:
    """Confirmed meanings of a kept schema, where the column at that place still has that name."""
    by_place = {c.index: c for c in kept.columns if c.confirmed}
    columns = [
        replace(c, semantic_name=k.semantic_name, semantic_type=k.semantic_type, confidence=k.confidence, confirmed=True) if (k := by_place.get(c.index)) and k.physical_name == c.physical_name else c
        for c in schema.columns
    ]
    return schema.with_columns(columns)


def confirm(found: Inspection, names: dict[str, str] | None = None, meanings: dict[str, str] | None = None) -> t.Schema:
    """Keep the schema as confirmed, after changes by physical name."""
    names, meanings = names or {}, meanings or {}
    columns = [
        replace(c, semantic_name=names.get(c.physical_name, c.semantic_name), semantic_type=t.semantic_type(meanings.get(c.physical_name, c.semantic_type)), confirmed=True)
        for c in found.schema.columns
    ]
    schema = found.schema.with_columns(columns)
    sidecar.save(schema, found.dataset.path)
    found.dataset.schema = schema
    return schema


def ask(found: Inspection, question: str, provider: nl.Provider | None = None, options: engine.Options | None = None) -> engine.Outcome:
    """The outcome of a question; its plan goes through the same validation as any other."""
    return run(found, (provider or nl.Mock()).plan(found.schema, question), options)


def run(found: Inspection, plan: Plan | str | dict, options: engine.Options | None = None) -> engine.Outcome:
    return engine.run(found.dataset, plan, options)
