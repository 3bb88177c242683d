"""Approximate nearest neighbours by inner product: an inverted file with product-quantised residuals.

Coarse centroids and the codebooks of the residuals' sub-vectors are fitted on the first rows by a
hash of their ids: ``SAMPLE`` rows, or ``ROWS_PER_LIST`` for each list where that is more; every row is
indexed.  There are as many lists as the square root of the rows.  A query visits the lists whose
centroids have the largest inner product with it, scores a list's codes through asymmetric distance
tables, and computes exact products for the best ``RERANK`` codes of each cell and for
all others that could reach the k-th of these: whose table score is below it by no more than
``SIGMAS`` deviations of what quantisation, in a random direction, takes off.  Ties go to the smaller
id.  How many lists it visits is set on the sample: as few as held ``TARGET`` of
the exact neighbours of sampled queries there.  Data without clusters need most lists.

Queries travel in blocks: a block sends each cell, in one row, the vectors of those of its queries that
visit it.  The exact vectors lie with their codes, so candidates are reranked where they are found and
only the k best leave a cell.

A list is cut by a hash of the ids into cells of about ``CELL_ROWS`` rows, so a vector that is very
common fills many cells, not one.  A first round searches one cell of each query's nearest list; what it
finds sets a floor, below which later cells return nothing.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part,
and so do rows without an id.  Shorter vectors are filled up with zeros.  Rows that repeat an id
count once, by the vector that sorts first.  A query with fewer than k candidates within the lists
it visits visits all lists.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.files import delete
from tabulon.llm.ball_tree import top
from tabulon.llm.clusters import finite, k_means, matrix, nearest, one_per_id, sampled
from tabulon.llm.common import written

K = 20
SAMPLE = 20_000
ROWS_PER_LIST = 16
SUBVECTORS = 16
CODES = 256
CELL_ROWS = 4096
RERANK = 64
SIGMAS = 3.0
TARGET = 0.97
_QUERIES = 512
_TOGETHER = 128
_PAIRS = 1 << 15
_SEED = 7


@dataclass
class Model:
    """Centroids, codebooks (sub-vector, code, component) and how many lists a query visits."""

    centroids: np.ndarray
    codebooks: list[np.ndarray]
    cuts: list[int]
    probes: int

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = nearest(vectors, self.centroids)
        rest = vectors - self.centroids[lists]
        codes = [nearest(rest[:, a:b], book).astype(np.uint8) for a, b, book in zip(self.cuts, self.cuts[1:], self.codebooks, strict=False)]
        return lists, np.stack(codes, axis=1) if codes else np.zeros((len(vectors), 0), np.uint8)

    def decode(self, at: int, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes of one list stand for."""
        parts = [book[codes[:, j]] for j, book in enumerate(self.codebooks)]
        return self.centroids[at] + np.concatenate(parts, axis=1) if parts else np.zeros((len(codes), 0))

    def visits(self, queries: np.ndarray) -> np.ndarray:
        """Each query's lists, best first."""
        return np.argsort(-(queries @ self.centroids.T), axis=1, kind="stable")


def list_count(rows: int) -> int:
    return max(1, round(rows**0.5))


def fit(sample: np.ndarray, rows: int, target: float = TARGET, k: int = K) -> Model:
    """A model from sampled vectors of a table of so many rows."""
    size = sample.shape[1]
    lists = list_count(rows)
    centroids = k_means(sample, lists) if len(sample) else np.zeros((1, size))
    rest = sample - centroids[nearest(sample, centroids)] if len(sample) else sample
    cuts = [size * j // min(SUBVECTORS, max(1, size)) for j in range(min(SUBVECTORS, max(1, size)) + 1)]
    books = [k_means(rest[:, a:b], CODES) if len(rest) else np.zeros((1, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]
    model = Model(centroids, books, cuts, len(centroids))
    # Copies of one vector must not stand for the others: distinct vectors are asked and found.
    distinct = np.unique(sample, axis=0)
    asked = np.random.default_rng(_SEED).permutation(len(distinct))[:300]
    if len(distinct) > k:
        scores = distinct[asked] @ distinct.T
        scores[np.arange(len(asked)), asked] = -np.inf
        found = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        place = np.empty((len(asked), len(centroids)), np.int64)
        np.put_along_axis(place, model.visits(distinct[asked]), np.arange(len(centroids))[None], axis=1)
        ranks = np.sort(np.take_along_axis(place, nearest(distinct, centroids)[found], axis=1).reshape(-1))
        model.probes = int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)]) + 1
    return model


def _best(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n largest scores."""
    return np.arange(len(scores)) if len(scores) <= n else np.argpartition(scores, len(scores) - n)[len(scores) - n :]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products in doubles, added up from the first component on."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def _exact(vectors: np.ndarray, queries: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.concatenate([products(vectors[at[low : low + _PAIRS]], queries[of[low : low + _PAIRS]]) for low in range(0, max(1, len(at)), _PAIRS)])


def search_cell(model: Model, centroid: np.ndarray, ids: np.ndarray, codes: np.ndarray, vectors: np.ndarray, errors: np.ndarray, names: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, vec ids, exact scores) of each query's k best in a cell, from the codes and then exactly."""
    rough = np.repeat((queries @ centroid)[:, None], len(ids), axis=1)
    for j, (a, b) in enumerate(zip(model.cuts, model.cuts[1:], strict=False)):
        rough += (queries[:, a:b] @ model.codebooks[j].T)[:, codes[:, j]]
    rough[names[:, None] == ids[None]] = -np.inf
    # First the best codes; their k-th exact score is what any other row must be able to reach.
    picked = np.stack([_best(row, rerank) for row in rough])
    exact = _exact(vectors, queries, np.repeat(np.arange(len(names)), picked.shape[1]), picked.reshape(-1)).reshape(picked.shape)
    exact[np.take_along_axis(rough, picked, axis=1) == -np.inf] = -np.inf
    if picked.shape[1] >= k:
        floors = np.maximum(floors, np.partition(exact, picked.shape[1] - k, axis=1)[:, picked.shape[1] - k])
    reach = rough + (SIGMAS / max(1, vectors.shape[1]) ** 0.5) * np.linalg.norm(queries, axis=1)[:, None] * errors
    within = reach >= floors[:, None]
    np.put_along_axis(within, picked, True, axis=1)
    of, at = np.nonzero(within & (rough > -np.inf))
    exact = _exact(vectors, queries, of, at)
    good = ~(exact < floors[of])
    of, at, exact = of[good], at[good], exact[good]
    order = np.lexsort((ids[at], -exact, of))
    of, at, exact = of[order], at[order], exact[order]
    nth = np.arange(len(of)) - np.searchsorted(of, of)
    return names[of[nth < k]], ids[at[nth < k]], exact[nth < k]


def _rows(vectors: DataFrame) -> DataFrame:
    vector = F.transform("embedding", lambda x: x.cast("double"))
    whole = vectors.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")) & F.exists("embedding", lambda x: x != 0))
    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))


def assigned(rows: DataFrame, model: Model, size: int) -> DataFrame:
    """(vec_id, list, codes, flat) of every row; ``flat`` has the vector's doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column(1), size)
            lists, codes = model.encode(points)
            packed = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (codes, points)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists), *packed], ["vec_id", "list", "codes", "flat"])

    return rows.select("vec_id", "vector").mapInArrow(run, "vec_id long, list long, codes binary, flat binary")


def _cells(dealt: DataFrame) -> DataFrame:
    """(cell, list, ids, codes, vectors): the rows of each cell as arrays of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[0][0]:
                    yield one(held)
                    held = []
                held.append(row)
        if held:
            yield one(held)

    def one(held: list[tuple]) -> pa.RecordBatch:
        ids = np.array([h[2] for h in held], np.int64).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([held[0][0]]), pa.array([held[0][1]]), pa.array([ids]), *(pa.array([b"".join(h[k] for h in held)]) for k in (3, 4))], ["cell", "list", "ids", "codes", "vectors"])

    ordered = dealt.select("cell", "list", "vec_id", "codes", "flat").repartition("cell").sortWithinPartitions("cell", "vec_id")
    return ordered.mapInArrow(run, "cell long, list long, ids binary, codes binary, vectors binary")


def visits(queries: DataFrame, model: Model, size: int, cells: tuple[list[int], list[int]], first: bool, last: int | None) -> DataFrame:
    """(cell, ids, codes, vectors): which queries (query_id, vector, floor) each cell is asked by, in blocks; ``codes`` has their floors.

    In the first round a query visits one cell of its nearest list that has any; later it visits all
    cells of its lists up to the ``last``, but for that one.
    """
    start, pieces = np.array(cells[0], np.int64), np.array(cells[1], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, _QUERIES):
                part = batch.slice(low, _QUERIES)
                names, points = np.asarray(part.column(0)), matrix(part.column(1), size)
                floors = np.asarray(part.column(2).fill_null(-np.inf))
                order = model.visits(points)
                nearest_full = order[np.arange(len(names)), np.argmax(pieces[order] > 0, axis=1)]
                home = start[nearest_full] + names % np.maximum(pieces[nearest_full], 1)
                if first:
                    cell, of = home, np.arange(len(names))
                else:
                    lists = order[:, :last].reshape(-1)
                    of = np.repeat(np.repeat(np.arange(len(names)), order[:, :last].shape[1]), pieces[lists])
                    n = pieces[lists]
                    cell = np.repeat(start[lists] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    cell, of = cell[cell != home[of]], of[cell != home[of]]
                by_cell = np.argsort(cell, kind="stable")
                cell, of = cell[by_cell], of[by_cell]
                bounds = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)] if len(cell) else [0]
                groups = [of[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                for at in range(0, len(groups), 64):
                    some = groups[at : at + 64]
                    columns = [pa.array(cell[bounds[at : at + len(some)]], pa.int64()), *(pa.array([x[g].tobytes() for g in some], pa.binary()) for x in (names, floors, points))]
                    yield pa.RecordBatch.from_arrays(columns, ["cell", "ids", "codes", "vectors"])

    return queries.select("vec_id", "vector", "floor").mapInArrow(run, "cell long, ids binary, codes binary, vectors binary")


def _searched(cells: DataFrame, asked: DataFrame, model: Model, size: int, k: int, rerank: int) -> DataFrame:
    """(query_id, cell, vec_id, score) of each query in each of its cells; a task holds a cell and a block of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell: tuple | None = None
        for batch in batches:
            for at in range(batch.num_rows):
                name, is_cell, place, ids, codes, flat = (batch.column(c)[at].as_py() for c in range(6))
                names = np.frombuffer(ids, np.int64)
                vectors = np.frombuffer(flat, np.float64).reshape(len(names), size)
                if is_cell:
                    own = np.frombuffer(codes, np.uint8).reshape(len(names), -1)
                    cell = (name, model.centroids[place], names, own, vectors, np.linalg.norm(vectors - model.decode(place, own), axis=1))
                elif cell and name == cell[0]:
                    floors = np.frombuffer(codes, np.float64)
                    for low in range(0, len(names), _TOGETHER):
                        part = slice(low, low + _TOGETHER)
                        found = search_cell(model, *cell[1:], names[part], vectors[part], floors[part], k, rerank)
                        yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(np.full(len(found[0]), name)), pa.array(found[1]), pa.array(found[2])], ["query_id", "cell", "vec_id", "score"])

    stored = cells.select("cell", F.lit(True).alias("is_cell"), "list", "ids", "codes", "vectors")
    told = asked.select("cell", F.lit(False).alias("is_cell"), F.lit(None).cast("long").alias("list"), "ids", "codes", "vectors")
    dealt = stored.unionByName(told).repartition("cell").sortWithinPartitions("cell", F.col("is_cell").desc())
    return dealt.mapInArrow(run, "query_id long, cell long, vec_id long, score double")


def search(vectors: DataFrame, queries: Column, k: int = K, target: float = TARGET, cell_rows: int = CELL_ROWS, rerank: int = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for every row for which ``queries`` holds."""
    spark = vectors.sparkSession
    rows, rows_path = written(_rows(vectors), "vectors")
    rows = one_per_id(rows)
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("size")).first()
    n, size = facts.n, facts.size or 0
    model = fit(sampled(rows, max(SAMPLE, ROWS_PER_LIST * list_count(n)), size), n, target, k)
    lists = len(model.centroids)

    index, index_path = written(assigned(rows, model, size), "index")
    # As many counts as lists come to the driver: the square root of the rows.
    counts = dict(index.groupBy("list").count().collect())
    pieces = [-(-counts.get(j, 0) // cell_rows) for j in range(lists)]
    first_cell = np.concatenate([[0], np.cumsum(pieces)])[:-1].tolist()
    cell_of = _cell_of(first_cell, pieces)
    cells, cells_path = written(_cells(index.mapInArrow(cell_of, "cell long, list long, vec_id long, codes binary, flat binary")), "cells")

    asked, asked_path = written(rows.where(queries).withColumn("floor", F.lit(None).cast("double")), "queries")
    of_lists = (first_cell, pieces)
    nearest_found, nearest_path = written(_searched(cells, visits(asked, model, size, of_lists, True, None), model, size, k, rerank), "nearest")
    floors = nearest_found.groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("query_id", "floor")
    told, told_path = written(asked.drop("floor").join(floors, asked["vec_id"] == F.col("query_id"), "left").select("vec_id", "vector", "floor"), "floors")
    found, found_path = written(nearest_found.unionByName(_searched(cells, visits(told, model, size, of_lists, False, model.probes), model, size, k, rerank)), "found")
    paths = [rows_path, index_path, cells_path, asked_path, nearest_path, told_path]

    if model.probes < lists:
        # Queries that came to fewer than k candidates visit the other lists too.
        enough = found.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
        short, short_path = written(asked.join(enough, asked["vec_id"] == enough["query_id"], "left_anti"), "short")
        paths.append(short_path)
        if not short.isEmpty():
            more = _searched(cells, visits(short, model, size, of_lists, False, None), model, size, k, rerank)
            paths.append(found_path)
            found, _ = written(found.unionByName(more).dropDuplicates(["query_id", "vec_id"]), "found")
    delete(spark, *paths)
    return top(found.drop("cell"), k)


def _cell_of(first: list[int], pieces: list[int]):
    """Deals the rows of each list to its cells by their ids."""
    start, n = np.array(first, np.int64), np.maximum(np.array(pieces, np.int64), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = np.asarray(batch.column(1))
            mixed = np.asarray(batch.column(0)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
            cells = start[lists] + (mixed % n[lists].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cells), batch.column(1), batch.column(0), batch.column(2), batch.column(3)], ["cell", "list", "vec_id", "codes", "flat"])

    return run
