"""Exact largest inner products by branch and bound in ball trees.

The rows are dealt to shards by their ids, and every shard builds a ball tree: nodes are split at the
median of the coordinate that varies most, down to leaves of ``LEAF`` vectors, and know their centre
and radius.  A query's inner product with a vector of a node is at most its product with the centre
plus its length times the radius.  A query visits nodes in the order of that bound, and ends when
the bound is below the worst of the k best scores so far.

Rows lie in shards by coarse clusters (``clusters``), of at most ``MAX_CLUSTERS`` centres, whose centres
and radii are all that comes to the driver; a cluster of many rows is cut into shards by a hash of
the ids.  Queries come in blocks by the cluster they point to most.  A block first searches one shard of
that cluster; the k-th scores found there are shared.  In the second round a query is sent to the
shards of those clusters alone whose bound reaches its k-th score, and a task hands the k-th score on
from each tree to the next.  Blocks of queries and shards are of bounded size, and a task holds one
shard's tree and one block at a time.

Scores are integers: each component x counts as floor(256 * x), and products are exact.

Defined cases: vectors that are null or hold null or non-finite components take no part, neither as
queries nor as candidates, and so do rows without an id.  Vectors of different lengths are compared
over the components both have; an empty vector scores 0 with all.  Ties go to the smaller id.  Rows
that repeat an id count once, by the vector that sorts first.  A product beyond 64 bits
counts as the 64-bit number next to it.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.files import delete
from tabulon.llm.clusters import finite, k_means, matrix, nearest, one_per_id, sampled
from tabulon.llm.common import written

SCALE = 256
K = 5
LEAF = 64
SHARD_ROWS = 8192
BLOCK_QUERIES = 256
GROUP = 32
#: Rows that the clusters are fitted on, and the most clusters there are.
SAMPLE = 20_000
MAX_CLUSTERS = 1024
_EXACT = float(1 << 53)
_LEAST = -(1 << 63)


class Tree:
    """A ball tree over integer-valued vectors, kept as doubles; ids ascend within a leaf."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> None:
        order = np.arange(len(ids))
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self.children: list[tuple[int, int]] = []
        self.ranges: list[tuple[int, int]] = []
        stack = [(0, len(ids), -1, 0)]
        while stack:
            low, high, parent, side = stack.pop()
            node = len(self.centres)
            if parent >= 0:
                pair = self.children[parent]
                self.children[parent] = (node, pair[1]) if side == 0 else (pair[0], node)
            part = vectors[order[low:high]]
            centre = part.mean(axis=0)
            self.centres.append(centre)
            self.radii.append(float(np.sqrt(((part - centre) ** 2).sum(axis=1).max())))
            self.children.append((-1, -1))
            self.ranges.append((low, high))
            spread = part.max(axis=0) - part.min(axis=0) if part.shape[1] else np.zeros(1)
            if high - low <= leaf or not spread.any():
                order[low:high] = order[low:high][np.argsort(ids[order[low:high]])]
                continue
            mid = (high - low) // 2
            order[low:high] = order[low:high][np.argpartition(part[:, int(np.argmax(spread))], mid)]
            stack += [(low, low + mid, node, 0), (low + mid, high, node, 1)]
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        self.centre = np.array(self.centres)
        self.radius = np.array(self.radii)

    def search(self, query: np.ndarray, own: int, k: int, best: list[tuple[int, int]], floor: int | None) -> list[tuple[int, int]]:
        """The k best (score, -id) of this tree and of ``best``; none below ``floor`` is needed."""
        best = sorted(best)
        bounds = upper_bounds(query[None], self.centre, self.radius)[0]
        exact = np.abs(query).sum() * np.abs(self.vectors).max(initial=0) < _EXACT
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            kth = best[0][0] if len(best) == k else floor
            if kth is not None and -bound < kth:
                break
            left, right = self.children[node]
            if left >= 0:
                heapq.heappush(queue, (-bounds[left], left))
                heapq.heappush(queue, (-bounds[right], right))
                continue
            low, high = self.ranges[node]
            if exact:
                scores = (self.vectors[low:high] @ query).astype(np.int64)
            else:
                scores = np.array([_product(v, query) for v in self.vectors[low:high]], np.int64)
            take = np.ones(high - low, bool) if kth is None else scores >= kth
            take &= self.ids[low:high] != own
            for at in np.flatnonzero(take).tolist():
                item = (int(scores[at]), -int(self.ids[low + at]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return best


def _product(a: np.ndarray, b: np.ndarray) -> int:
    total = sum(int(x) * int(y) for x, y in zip(a, b, strict=True))
    return min(max(total, -(1 << 63)), (1 << 63) - 1)


def upper_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """(query, ball): what no inner product of a query with a vector in the ball exceeds, however doubles round."""
    length = np.linalg.norm(queries, axis=1)[:, None]
    bounds = queries @ centres.T + length * radii
    bounds = bounds + 1e-9 * (np.abs(bounds) + length * (radii + np.linalg.norm(centres, axis=1))) + 1e-6
    return np.where(np.isnan(bounds), np.inf, bounds)  # of numbers too large for doubles nothing is known


def _unpacked(ids: bytes, vectors: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    names = np.frombuffer(ids, np.int64)
    return names, np.frombuffer(vectors, np.float64).reshape(len(names), size)


def packed(rows: DataFrame, group: str) -> DataFrame:
    """(group, ids, vectors): the rows (group, vec_id, flat) of each group as two arrays of bytes.  Groups are of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, vectors = None, [], []

        def one() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([b"".join(vectors)])], [group, "ids", "vectors"])

        for batch in batches:
            for key, vec_id, vector in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if key != name and ids:
                    yield one()
                    ids, vectors = [], []
                name = key
                ids.append(vec_id)
                vectors.append(vector)
        if ids:
            yield one()

    ordered = rows.select(group, "vec_id", "flat").repartition(group).sortWithinPartitions(group, "vec_id")
    return ordered.mapInArrow(run, f"{group} long, ids binary, vectors binary")


def _placed(rows: DataFrame, centres: np.ndarray, size: int) -> DataFrame:
    """(vec_id, flat, cluster, distance, home): where each row lies, and the cluster it points to most as a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix(batch.column(1), size)
            at = nearest(points, centres)
            away = np.sqrt(((points - centres[at]) ** 2).sum(axis=1))
            home = np.concatenate([np.argmax(points[k : k + 4096] @ centres.T, axis=1) for k in range(0, max(1, len(points)), 4096)])
            flat = [row.tobytes() for row in points]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flat, pa.binary()), pa.array(at), pa.array(away), pa.array(home)], ["vec_id", "flat", "cluster", "distance", "home"])

    return rows.select("vec_id", "vector").mapInArrow(run, "vec_id long, flat binary, cluster long, distance double, home long")


def _dealt(rows: DataFrame, column: str, counts: dict[int, int], most: int, clusters: int, name: str) -> tuple[DataFrame, list[int], list[int]]:
    """``rows`` with ``name``: pieces of each cluster of about ``most`` rows; also where each cluster's pieces begin, and how many there are."""
    pieces = [-(-counts.get(c, 0) // most) for c in range(clusters)]
    first = np.concatenate([[0], np.cumsum(pieces)])[:-1].tolist()
    of = F.array(*(F.struct(F.lit(a).cast("long").alias("first"), F.lit(max(1, n)).cast("long").alias("n")) for a, n in zip(first, pieces, strict=True)))
    place = F.element_at(of, (F.col(column) + 1).cast("int"))
    return rows.withColumn(name, place["first"] + F.pmod(F.xxhash64("vec_id"), place["n"])), first, pieces


def search(vectors: DataFrame, queries: Column, k: int = K, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of every row for which ``queries`` holds.

    ``vectors`` has vec_id and embedding; ``queries`` is a condition on vec_id.
    """
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("double"))
    whole = F.transform("embedding", lambda x: (F.lit(float(SCALE)) * x.cast("double")))
    rows = vectors.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")))
    # floor() of a double gives a long; components beyond one are whole numbers as they are.
    vector = F.transform(F.arrays_zip(scaled.alias("f"), whole.alias("w")), lambda x: F.when(F.abs(x["w"]) < 2.0**62, x["f"]).otherwise(x["w"]))
    rows, rows_path = written(rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")), "scaled-vectors")
    rows = one_per_id(rows)
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("size")).first()
    n, size = facts.n, facts.size or 0
    wanted = max(1, min(MAX_CLUSTERS, -(-n // shard_rows)))
    centres = k_means(sampled(rows, SAMPLE, size), wanted) if n else np.zeros((1, size))
    clusters = len(centres)
    placed, placed_path = written(_placed(rows, centres, size), "placed-vectors")
    by_cluster = {r.cluster: r for r in placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("radius")).collect()}
    by_home = {r.home: r.n for r in placed.where(queries).groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}
    radii = np.array([by_cluster[c].radius if c in by_cluster else 0.0 for c in range(clusters)])
    cut, first_shard, pieces = _dealt(placed, "cluster", {c: r.n for c, r in by_cluster.items()}, shard_rows, clusters, "shard")
    shard, shard_path = written(packed(cut, "shard"), "shards")
    asked, first_block, blocks = _dealt(placed.where(queries), "home", by_home, block_queries, clusters, "block")
    block, block_path = written(packed(asked, "block"), "query-blocks")
    home_of = np.repeat(np.arange(clusters), blocks)
    full = np.flatnonzero(np.array(pieces)) if n else np.zeros(0, np.int64)

    def home(at: int) -> int:
        """A shard of the cluster that a block's queries point to, or of the next one that has rows."""
        cluster = int(full[min(np.searchsorted(full, home_of[at]), len(full) - 1)])
        return first_shard[cluster] + at % pieces[cluster]

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = [home(at) for at in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), *batch.columns, pa.nulls(batch.num_rows, pa.binary())], ["shard", "block", "ids", "vectors", "floors"])

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, ids, flat, floors in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                names, points = _unpacked(ids, flat, size)
                known = {f["query_id"]: f["floor"] for f in floors or ()}
                reached = np.array([known.get(i, _LEAST) for i in names.tolist()], np.int64)
                near = (upper_bounds(points, centres, radii) >= reached[:, None]) | (reached == _LEAST)[:, None]
                for cluster in np.flatnonzero(near.any(axis=0)).tolist():
                    some = near[:, cluster]
                    shards = [s for s in range(first_shard[cluster], first_shard[cluster] + pieces[cluster]) if s != home(at)]
                    values = [x[some].tobytes() for x in (names, points, reached)]
                    for low in range(0, len(shards), 64):
                        part = shards[low : low + 64]
                        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([at] * len(part), pa.int64()), *(pa.array([v] * len(part), pa.binary()) for v in values)], ["shard", "block", "ids", "vectors", "floors"])

    told = "shard long, block long, ids binary, vectors binary, floors binary"
    first, first_path = written(_round(shard, written(block.select("block", "ids", "vectors").mapInArrow(at_home, told), "asked")[0], size, k), "first-scores")
    kth = first.groupBy("block", "query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    floors = kth.groupBy("block").agg(F.collect_list(F.struct("query_id", "floor")).alias("floors"))
    others, others_path = written(block.join(floors, "block", "left").select("block", "ids", "vectors", "floors").mapInArrow(elsewhere, told), "asked")
    found, _ = written(first.unionByName(_round(shard, others, size, k)).drop("block"), "scores")
    delete(vectors.sparkSession, rows_path, placed_path, shard_path, block_path, first_path, others_path)
    return top(found, k)


def top(found: DataFrame, k: int) -> DataFrame:
    """Each query's k largest scores of all tasks, ties to the smaller id."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _round(shard: DataFrame, told: DataFrame, size: int, k: int) -> DataFrame:
    """(block, query_id, vec_id, score): the k best of each block's queries in the shards they are paired with.

    Each shard is sent once for ``GROUP`` blocks; a task builds its tree and then takes these blocks
    one by one.  It goes through all its shards for one group before the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, group_now = None, None
        reached: dict[int, int] = {}
        for batch in batches:
            for group, block, ids, vectors, floors in zip(*(batch.column(c).to_pylist() for c in range(1, 6)), strict=True):
                if block < 0:
                    tree = Tree(*_unpacked(ids, vectors, size))
                    if group != group_now:
                        group_now, reached = group, {}
                    continue
                names, points = _unpacked(ids, vectors, size)
                given = np.frombuffer(floors, np.int64).tolist() if floors else [_LEAST] * len(names)
                out: tuple[list, list, list, list] = ([], [], [], [])
                for own, query, floor in zip(names.tolist(), points, given, strict=True):
                    known = max(floor, reached.get(own, _LEAST))
                    best = tree.search(query, own, k, [], None if known == _LEAST else known)
                    if len(best) == k:
                        reached[own] = max(best[0][0], known)
                    for score, negative in best:
                        out[0].append(block)
                        out[1].append(own)
                        out[2].append(-negative)
                        out[3].append(score)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["block", "query_id", "vec_id", "score"])

    asked = told.select("shard", F.floor(F.col("block") / GROUP).alias("group"), "block", "ids", "vectors", "floors")
    trees = asked.select("shard", "group").distinct().join(shard, "shard").select("shard", "group", F.lit(-1).cast("long").alias("block"), "ids", "vectors", F.lit(None).cast("binary").alias("floors"))
    dealt = trees.unionByName(asked).repartition("shard", "group").sortWithinPartitions("group", "shard", "block")
    return dealt.mapInArrow(run, "block long, query_id long, vec_id long, score long")
