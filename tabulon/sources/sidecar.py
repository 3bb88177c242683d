"""Confirmed schemas kept as JSON next to their files."""

from __future__ import annotations

import json
from dataclasses import asdict, fields
from pathlib import Path

from pyspark.sql import SparkSession

from tabulon import files
from tabulon import types as t

SUFFIX = ".engine-schema.json"


def to_json(schema: t.Schema) -> str:
    columns = [asdict(c) for c in schema.columns]
    return json.dumps({"dataset": schema.dataset, "dialect": asdict(schema.dialect), "columns": columns}, indent=2, ensure_ascii=False)


def from_json(text: str) -> t.Schema:
    """A schema from its JSON; type names may be aliases, and unknown fields are passed over."""
    data = json.loads(text)
    known = {f.name for f in fields(t.Dialect)}
    dialect = t.Dialect(**{k: tuple(v) if k == "names" else v for k, v in data.get("dialect", {}).items() if k in known})
    columns = []
    for k, c in enumerate(data["columns"]):
        own = {"physical_type": t.physical_type(c.get("physical_type", "")), "semantic_type": t.semantic_type(c.get("semantic_type", ""))}
        columns.append(t.Column(c["physical_name"], int(c.get("index", k)), own["physical_type"], c.get("semantic_name", ""), own["semantic_type"], float(c.get("confidence", 0)), bool(c.get("confirmed", False))))
    return t.Schema(tuple(columns), dialect, data.get("dataset", ""))


def path_of(dataset: str) -> str:
    return dataset.rstrip("/") + SUFFIX


def _local(path: str) -> Path | None:
    """The path on this machine; None on another file system.  Plain files may be edited by hand, as no checksum is kept of them."""
    scheme, colon, rest = path.partition(":")
    if colon and scheme == "file":
        return Path("/" + rest.lstrip("/"))
    return None if "://" in path else Path(path)


def save(schema: t.Schema, dataset: str) -> str:
    """Keep the schema next to its file, on the same file system."""
    path, content = path_of(dataset), to_json(schema).encode()
    local = _local(path)
    if local:
        local.write_bytes(content)
    else:
        files.write(SparkSession.active(), path, content)
    return path


def load(dataset: str) -> t.Schema | None:
    """The kept schema, or None if there is none or it can't be read."""
    path = path_of(dataset)
    local = _local(path)
    try:
        if local:
            return from_json(local.read_text(encoding="utf-8"))
        spark = SparkSession.active()
        return from_json(files.read(spark, path).decode()) if files.exists(spark, path) else None
    except (OSError, ValueError, KeyError, TypeError):
        return None
