"""Coarse clusters of vectors, fitted on a sample: they decide where rows lie, not what is found."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import written

_ROUNDS = 10
_SEED = 7


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The place of the nearest centre of each point."""
    out = np.empty(len(points), np.int64)
    squares = (centres**2).sum(axis=1)
    for start in range(0, len(points), 4096):
        out[start : start + 4096] = np.argmin(squares - 2 * points[start : start + 4096] @ centres.T, axis=1)
    return out


def k_means(points: np.ndarray, k: int, rounds: int = _ROUNDS) -> np.ndarray:
    """At most k centres by Lloyd's iterations from distinct points; an empty cluster keeps its centre."""
    distinct = np.unique(points, axis=0) if points.shape[1] else points[:1]
    centres = distinct[np.random.default_rng(_SEED).permutation(len(distinct))[:k]].copy()
    for _ in range(rounds if k > 1 else 1):
        at = nearest(points, centres)
        counts = np.bincount(at, minlength=len(centres))
        sums = np.stack([np.bincount(at, points[:, j], len(centres)) for j in range(points.shape[1])], axis=1) if points.shape[1] else centres
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def finite(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    limit = F.lit(float("inf"))
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)), F.lit(False))


def one_per_id(rows: DataFrame) -> DataFrame:
    """(vec_id, vector) rows with each id once, by the vector that sorts first.  Only ids that repeat are shuffled with their vectors."""
    repeated, _ = written(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"), "repeated-ids")
    if repeated.isEmpty():
        return rows
    first = rows.join(repeated, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    return rows.join(repeated, "vec_id", "left_anti").select("vec_id", "vector").unionByName(first)


def matrix(column, size: int) -> np.ndarray:
    """An Arrow column of lists as rows of ``size`` doubles, shorter lists being filled up with zeros."""
    lengths = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), np.float64)
    if (lengths == size).all():
        return flat.reshape(len(lengths), size)
    out = np.zeros((len(lengths), size))
    out[np.arange(size)[None] < lengths[:, None]] = flat
    return out


def sampled(rows: DataFrame, n: int, size: int) -> np.ndarray:
    """The vectors of the first n rows in the order of a hash of their ids."""
    column = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select("vector").toArrow().column(0).combine_chunks()
    return matrix(column, size) if len(column) else np.zeros((0, size))
