"""Plans over files that keep arriving.

A plan without aggregates, sorts or limits works row by row, so Structured Streaming can run it as
it is; a grouped plan without a sort or limit runs with complete output.  Plans that need the whole
result at once are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon import types as t
from tabulon.plans.engine import Rejected
from tabulon.plans.lowering import lower
from tabulon.plans.plan import Plan, parse_plan
from tabulon.plans.validator import validate


def stream(spark: SparkSession, folder: str, schema: t.Schema, plan: Plan | str | dict, max_files: int = 16) -> tuple[DataFrame, str]:
    """(streaming result, output mode) of a plan over the Parquet files that come into a folder, typed by ``schema``."""
    parsed = plan if isinstance(plan, Plan) else parse_plan(plan)
    found = validate(parsed, schema)
    errors = found.errors + [f"{op.type} needs the whole result; it can't run on a stream" for op in parsed.operations if op.type in ("sort", "limit")]
    if errors:
        raise Rejected(errors)
    found.plan.limit = 0  # the default bound is for results that are brought back
    source = spark.readStream.schema(", ".join(f"`{c.physical_name}` {t.SPARK[c.physical_type].simpleString()}" for c in schema.columns)).option("maxFilesPerTrigger", max_files).parquet(folder)
    rows = source.select(*(F.col(f"`{schema.resolve(name).physical_name}`").alias(name) for name in found.plan.scanned))
    return lower(rows, found.plan), "complete" if found.plan.aggregates else "append"
