"""Length buckets with the least padding, and batches of a token budget within them.

Texts become token ids, and every row is padded to its bucket's length.  The bucket lengths are chosen
by dynamic programming over the histogram of all lengths, exactly, so that no other choice of as many
lengths pads less.  Only the histogram comes to the driver: D different lengths are D * (D - 1) / 2
tokens at least, so it has fewer than 1 + sqrt(2 * tokens) rows.  As the padding obeys the quadrangle inequality,
the best last cuts ascend with the length, and a layer of the programme takes D * log(D) steps.

A batch of a bucket holds as many rows as fit the budget when padded, one at least.  Each task fills
batches from its own rows, one open batch for each bucket, so no text is shuffled; what is left
over, less than a batch for each bucket and task, is dealt by bucket and by groups of ``MERGED`` tasks, and
again, until there is one group.  Only each bucket's last batch can be short.

Defined cases: a null text has no tokens, like an empty one.  Rows without a doc_id are packed like
others.  Repeated rows take a place each.  An empty table gives an empty result.  A row longer than
the budget is a batch of its own.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.files import delete
from tabulon.llm.common import settings, written

BUCKETS = 16
TOKEN_BUDGET = 32_768
MERGED = 64
#: Bytes of rows that go to Python at a time: the executor and its workers hold several such batches for each task.
_BATCH = {"spark__sql__execution__arrow__maxBytesPerBatch": "4m"}
#: Bytes of a row group of batches.  Spark's reader decodes up to 4096 rows of a row group at once, and a batch is one row.
GROUP_BYTES = 4 << 20
PAD = 0
_ROWS = "bucket int, part long, doc_ids array<long>, n_tokens array<long>, ids binary"
#: ``ids`` of a full batch are padded; what is left over has them in ``rest``, so that reading it reads no full batch.
_FILLED = f"full boolean, number long, {_ROWS}, rest binary"


def _best_cuts(before: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j: the least padded size of bins 0..j, of which i..j share a bucket and those before i cost before[i]; and that i, the least of equals."""
    n = len(lengths)
    cost, cut = np.empty(n, np.int64), np.zeros(n, np.int64)
    low, high, first, last = (np.array([x]) for x in (0, n, 0, n - 1))  # bins [low, high), whose cuts are in [first, last]
    while len(low):
        mid = (low + high) // 2
        size = np.minimum(last, mid) - first + 1
        starts = np.cumsum(size) - size
        i = np.arange(size.sum()) - np.repeat(starts - first, size)
        j = np.repeat(mid, size)
        sizes = before[i] + lengths[j] * (rows[j + 1] - rows[i])
        cost[mid] = least = np.minimum.reduceat(sizes, starts)
        is_least = np.flatnonzero(sizes == np.repeat(least, size))
        cut[mid] = i[is_least[np.searchsorted(is_least, starts)]]
        low, high, first, last = (np.concatenate(x) for x in ((low, mid + 1), (mid, high), (first, cut[mid]), (cut[mid], last)))
        some = low < high
        low, high, first, last = low[some], high[some], first[some], last[some]
    return cost, cut


def choose(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """At most so many of the lengths (ascending, distinct) as bucket lengths, with the least total padding."""
    n = len(lengths)
    if n <= buckets:
        return lengths.tolist()
    rows = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    lengths = lengths.astype(np.int64)
    cost = lengths * rows[1:]  # bins 0..j in one bucket: their padded size
    cuts = [np.zeros(n, np.int64)]
    for _ in range(1, buckets):
        cost, cut = _best_cuts(np.concatenate([[0], cost[:-1]]), lengths, rows)
        cuts.append(cut)
    chosen, j = [], n - 1
    for cut in reversed(cuts):
        if j < 0:
            break
        chosen.append(int(lengths[j]))
        j = int(cut[j]) - 1
    return chosen[::-1]


class Batches:
    """The open batch of each bucket in one task; batches come out as they fill."""

    def __init__(self, lengths: list[int], budget: int, part: int) -> None:
        self.lengths, self.part, self.made = lengths, part, [0] * len(lengths)
        self.per_batch = [max(1, budget // max(1, n)) for n in lengths]
        self.open: list[list[tuple]] = [[] for _ in lengths]
        self.out: list[tuple] = []

    def add(self, bucket: int, doc_id: int | None, ids: np.ndarray) -> None:
        rows = self.open[bucket]
        rows.append((doc_id, ids))
        if len(rows) == self.per_batch[bucket]:
            self.close(bucket, True)

    def close(self, bucket: int, full: bool) -> None:
        """The bucket's open batch, padded, or as what is left over: one row after the other."""
        rows, width = self.open[bucket], self.lengths[bucket]
        if not rows:
            return
        if full:
            matrix = np.full((len(rows), width), PAD, "<u4")
            for line, (_, ids) in zip(matrix, rows, strict=True):
                line[: len(ids)] = ids
        else:
            matrix = np.concatenate([ids for _, ids in rows]).astype("<u4")
        self.out.append((full, self.made[bucket], bucket, self.part, [i for i, _ in rows], [len(ids) for _, ids in rows], *((matrix.tobytes(), None) if full else (None, matrix.tobytes()))))
        self.made[bucket] += full
        self.open[bucket] = []

    def taken(self, least: int = 32) -> Iterator[pa.RecordBatch]:
        if len(self.out) >= least:
            types = [pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            names = ["full", "number", "bucket", "part", "doc_ids", "n_tokens", "ids", "rest"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.out, strict=True), types, strict=True)], names)
            self.out = []

    def closed(self, full: bool) -> Iterator[pa.RecordBatch]:
        for bucket in range(len(self.lengths)):
            self.close(bucket, full)
        yield from self.taken(1)


def _fill_texts(lengths: list[int], budget: int):
    bounds = np.array(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Batches(lengths, budget, TaskContext.get().partitionId())
        for batch in batches:
            at = np.searchsorted(bounds, np.asarray(batch.column(1))).tolist()
            for bucket, doc_id, ids in zip(at, batch.column(0).to_pylist(), batch.column(2), strict=True):
                made.add(bucket, doc_id, np.frombuffer(ids.as_py(), "<u4"))
                yield from made.taken()
        yield from made.closed(False)

    return run


def _fill_rest(lengths: list[int], budget: int, last: bool):
    """Batches of what was left over, from rows (group, bucket, part, doc_ids, n_tokens, rest) in this order; in the last round the open ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made = None, None
        for batch in batches:
            for group, bucket, _, doc_ids, n_tokens, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (group, bucket) != now:
                    if made is not None:
                        yield from made.closed(last)
                    now, made = (group, bucket), Batches(lengths, budget, group)
                flat = np.frombuffer(ids, "<u4")
                for doc_id, own in zip(doc_ids, np.split(flat, np.cumsum(n_tokens)[:-1]), strict=True):
                    made.add(bucket, doc_id, own)
                    yield from made.taken()
        if made is not None:
            yield from made.closed(last)

    return run


def batches(rows: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """(bucket, bucket_length, batch, doc_ids, n_tokens, ids): the batches of rows (doc_id, n_tokens, ids).

    ``ids`` are little-endian unsigned 32-bit integers; a batch has its rows' ids, each row padded to
    ``bucket_length`` with ``PAD``.  ``rows`` should be a written table: it is read twice.
    """
    histogram = rows.groupBy("n_tokens").count().toArrow()
    order = np.argsort(np.asarray(histogram.column(0)))
    lengths = choose(np.asarray(histogram.column(0))[order], np.asarray(histogram.column(1))[order], buckets)
    groups = {"parquet.block.size": str(GROUP_BYTES)} | {f"parquet.{x}.size.row.check.min": "4" for x in ("block", "page")}
    with settings(rows.sparkSession, **_BATCH):
        filled, _ = written(rows.select("doc_id", "n_tokens", "ids").mapInArrow(_fill_texts(lengths, budget), _FILLED), "batches", **groups)
    parts = (filled.agg(F.max("part").alias("part")).first().part or 0) + 1
    rest, full = filled, [filled.where("full").drop("rest").withColumn("round", F.lit(0))]
    while parts:
        last = parts <= MERGED
        grouped = rest.where("not full").select(F.expr(f"part div {MERGED}").alias("group"), "bucket", "part", "doc_ids", "n_tokens", "rest")
        dealt = grouped.repartition("group", "bucket").sortWithinPartitions("group", "bucket", "part")
        with settings(rows.sparkSession, **_BATCH):
            rest, _ = written(dealt.mapInArrow(_fill_rest(lengths, budget, last), _FILLED), "batches", **groups)
        full.append(rest.where("full").drop("rest").withColumn("round", F.lit(len(full))))
        parts = 0 if last else -(-parts // MERGED)
    made = full[0]
    for more in full[1:]:
        made = made.unionByName(more)
    # Batches are numbered within buckets by the counts of each task and round.  Tasks number their own, so what
    # the batches are joined with has a row for each task, not one for each batch, and the ids aren't shuffled for it.
    counts = made.groupBy("bucket", "round", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("round", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_task = F.map_from_entries(F.collect_list(F.struct("bucket", "before")))
    starts, _ = written(counts.select("bucket", "round", "part", before.alias("before")).groupBy("round", "part").agg(of_task.alias("before")), "batch-starts")
    width = F.element_at(F.array(*(F.lit(n).cast("long") for n in lengths or [0])), F.col("bucket") + 1)
    batch = F.element_at("before", F.col("bucket")) + F.col("number")
    return made.join(starts, ["round", "part"]).select("bucket", width.alias("bucket_length"), batch.alias("batch"), "doc_ids", "n_tokens", "ids")


def places(made: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_length, batch, slot) of every row in batches."""
    rows = F.posexplode(F.arrays_zip(F.col("doc_ids").alias("doc_id"), F.col("n_tokens").alias("n")))
    return made.select("bucket", "bucket_length", "batch", rows.alias("slot", "row")).select("row.doc_id", F.col("row.n").alias("n_tokens"), "bucket", "bucket_length", "batch", F.col("slot").cast("long").alias("slot"))


_encoders: dict[tuple[str, str], Callable[[str], np.ndarray]] = {}


def encoder(ranks: str, pattern: str) -> Callable[[str], np.ndarray]:
    """One encoder of a file of byte pairs' ranks in each worker."""
    if (ranks, pattern) not in _encoders:
        import tiktoken

        with open(ranks, "rb") as lines:
            known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encoders[ranks, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=known, special_tokens={}).encode_ordinary
    return _encoders[ranks, pattern]


def encoded(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = [np.array(encode(t), "<u4").tobytes() if t else b"" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def pack_documents(docs: DataFrame, ranks: str, pattern: str, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """The batches of all documents' token ids (see ``batches``)."""
    with settings(docs.sparkSession, **_BATCH):
        rows, path = written(encoded(docs, ranks, pattern), "token-ids")
    made = batches(rows, buckets, budget)
    delete(docs.sparkSession, path)
    return made
