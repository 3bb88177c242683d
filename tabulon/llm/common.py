"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.files import fresh

#: Bytes that end a word: space and the controls tab to carriage return.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows of a small table that one task writes.
TASK_ROWS = 100_000
_UPPER = bytes(range(65, 91))
LOWER_AZ = bytes.maketrans(_UPPER, _UPPER.lower())


def written(df: DataFrame, name: str, rows: int | None = None, **options: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write ``df`` to the shared folder, return the table read back and its path.

    Where it is known that there are at most so many ``rows``, they are written by few tasks.  ``options``
    are those of the Parquet writer.
    """
    spark = df.sparkSession
    path = fresh(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // TASK_ROWS)))
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: For ``settings``: a write's shuffle files go when it has ended, not whenever the driver next collects garbage.
SHUFFLES_END = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}


@contextmanager
def settings(spark: SparkSession, **changed: str) -> Iterator[None]:
    """The session's settings (dots written as two underscores) within the block; before and after it they are as they were."""
    names = {name.replace("__", "."): value for name, value in changed.items()}
    old = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in old.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def crc_of_id(column: str) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, with A-Z lower-cased and nothing else changed."""
    if not text:
        return []
    return text.encode("utf-8", "replace").translate(LOWER_AZ).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
