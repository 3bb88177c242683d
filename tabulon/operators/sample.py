"""Seeded samples of a file's records: a fixed number from all over it, or its head and some probes."""

from __future__ import annotations

import random
from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon import files
from tabulon.sources import sniff
from tabulon.sources.dataset import CsvDataset

# Fixed values of the sampling rules.
TARGET = 10_000
SEED = 20_260_101
SMALL_FILE = 64 << 20
HEAD_ROWS = 200
PROBES = 64
PROBE_ROWS = 256
_PROBE_BYTES = 64 << 10


@dataclass
class Sample:
    """Rows as text; ``complete`` if they are all of the file's, whose number is ``total`` where all were read."""

    rows: DataFrame
    complete: bool
    method: str
    total: int | None = None


def reservoir(dataset: CsvDataset, target: int = TARGET, seed: int = SEED) -> Sample:
    """The rows whose hashes with the seed are least: the same ones each time, each row alike likely to be one."""
    rows = dataset.texts()
    picked = rows.orderBy(F.xxhash64(*rows.columns, F.lit(seed)), *rows.columns).limit(target)
    total = dataset.count()
    return Sample(picked, total <= target, "reservoir", total)


def head_and_probes(dataset: CsvDataset, target: int = TARGET, seed: int = SEED) -> Sample:
    """The first rows, and rows after the next line end of random places; reads little of a large file."""
    spark, dialect = dataset.spark, dataset.schema.dialect
    held, width = files.below(spark, dataset.path), len(dataset.schema.columns)
    starts = [0, *accumulate(size for _, size in held)]
    encoding = {"windows-1250": "cp1250"}.get(dialect.encoding, dialect.encoding)
    cut = lambda raw, most, whole: [r for r, _ in sniff.records(raw.decode(encoding, "replace"), dialect.delimiter, dialect.quote, most, whole)]
    head = sniff.head_of(spark, dataset.path, sniff.HEAD_BYTES + 1)
    rows = cut(head[: sniff.HEAD_BYTES], HEAD_ROWS + dialect.has_header, len(head) <= sniff.HEAD_BYTES)[dialect.has_header :]
    if not dialect.quoted_newlines and starts[-1] > len(head):
        for at in sorted(random.Random(seed).sample(range(starts[-1]), min(PROBES, starts[-1]))):
            file = bisect_right(starts, at) - 1
            piece = files.read(spark, held[file][0], _PROBE_BYTES, at - starts[file])
            line_end = piece.find(b"\n")
            if line_end >= 0:
                rows += cut(piece[line_end + 1 :], PROBE_ROWS, False)
    rows = [tuple(r) for r in rows if len(r) == width][:target]
    names = ", ".join(f"c{k} string" for k in range(width))
    return Sample(spark.createDataFrame(rows, names), False, "head+offsets")


def sample(dataset: CsvDataset, target: int = TARGET, seed: int = SEED) -> Sample:
    small = files.length(dataset.spark, dataset.path) <= SMALL_FILE
    return (reservoir if small else head_and_probes)(dataset, target, seed)
