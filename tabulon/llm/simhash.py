"""Near-duplicate groups by SimHash: fingerprints within a few bits of each other are linked.

Links are found by binary tries joined with themselves: pairs of nodes go down together, add up the
bits in which they differ and end where that exceeds the budget.  With a budget of d bits, two
linked fingerprints agree in one of d + 1 blocks of bits.  So each fingerprint is sent to d + 1
cells, by the value of each block, and the tries of the cells, with the block's bits on top, are
joined apart from each other.  Distinct fingerprints only: copies meet beforehand.  A cell with more
than ``CELL_ROWS`` fingerprints is dealt anew by its next bits, into cells for pairs of trie nodes
that are within the budget, until none is that large or the bits are used up.  Of what a task finds
it returns a spanning forest, which keeps the components and is no longer than its input.

Defined cases: a text that is null or has no words has fingerprint zero, which links like any other.
A row without a doc_id has a fingerprint but takes no part in links; its component is null.
Repeated rows share a component.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.files import delete
from tabulon.llm.common import words, written
from tabulon.llm.components import components
from tabulon.llm.fingerprints import distinct_hashes, prefix, sampled_fingerprints, similarity, wide_fingerprint, with_fingerprints

BITS = 64
BUDGET = 2
CELL_ROWS = 1000
_STEP = 4
_BATCH = 50_000
_PAIRS = 1 << 19
_LEAF = 16


def _ones(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def join_tries(prints: np.ndarray, pairs: tuple[np.ndarray, ...], budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of fingerprints within ``budget`` bits, for pairs of trie roots.

    ``prints`` (uint64, or rows of several as one long fingerprint) is sorted within each trie, which is a range of places.  A pair is (low,
    high) of the one trie, (low, high) of the other, and 0 bits spent; the same range twice stands
    for a trie with itself, whose pairs come once.
    """
    prints = prints.reshape(len(prints), -1)
    stack = [(0, tuple(np.asarray(p, np.int64) for p in pairs))]
    while stack:
        depth, (a, b, c, d, spent) = stack.pop()
        if len(a) > _PAIRS:
            half = len(a) // 2
            stack += [(depth, tuple(x[half:] for x in (a, b, c, d, spent))), (depth, tuple(x[:half] for x in (a, b, c, d, spent)))]
            continue
        small = ((b - a) * (d - c) <= _LEAF) | (depth == BITS * prints.shape[1])
        if small.any():
            x, y, w = a[small], c[small], d[small] - c[small]
            size = (b[small] - x) * w
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            w = np.repeat(w, size)
            i, j = np.repeat(x, size) + at // w, np.repeat(y, size) + at % w
            near = (_ones(prints[i] ^ prints[j]).sum(axis=1) <= budget) & ((np.repeat(x != y, size)) | (i < j))
            yield i[near], j[near]
            a, b, c, d, spent = (x[~small] for x in (a, b, c, d, spent))
        if not len(a):
            continue
        word, bit = prints[:, depth // BITS], np.uint64(BITS - 1 - depth % BITS)
        ones = np.concatenate([[0], np.cumsum((word >> bit & np.uint64(1)).astype(np.int64))]) if len(prints) < 4 * len(a) else None
        if ones is None:
            mid_a, mid_b = _first_one(word, a, b, bit), _first_one(word, c, d, bit)
        else:
            mid_a, mid_b = b - (ones[b] - ones[a]), d - (ones[d] - ones[c])
        self_pair = (a == c) & (b == d)
        down = [(a, mid_a, c, mid_b, spent), (mid_a, b, mid_b, d, spent), (a, mid_a, mid_b, d, spent + 1)]
        down.append(tuple(x[~self_pair] for x in (mid_a, b, c, mid_b, spent + 1)))
        a, b, c, d, spent = (np.concatenate(x) for x in zip(*down, strict=True))
        live = (b > a) & (d > c) & (spent <= budget)
        stack.append((depth + 1, tuple(x[live] for x in (a, b, c, d, spent))))


def _first_one(word: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.uint64) -> np.ndarray:
    """The place in each range of the first fingerprint with a 1 at a bit, by bisection."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        one = (word[np.minimum(mid, len(word) - 1)] >> bit & np.uint64(1)).astype(bool)
        high = np.where(open_ & one, mid, high)
        low = np.where(open_ & ~one, mid + 1, low)
    return low


def unite(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after linking places i and j; each label is the least place of its group."""
    while len(i):
        x, y = labels[i], labels[j]
        apart = x != y
        if not apart.any():
            break
        i, j = i[apart], j[apart]
        np.minimum.at(labels, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (labels != (up := labels[labels])).any():
            labels = up
    return labels


def _forest(cells: np.ndarray, sides: np.ndarray, prints: np.ndarray, docs: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in whole cells, as pairs of doc ids; rows sorted by cell, side, fingerprint."""
    starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    ends = np.append(starts[1:], len(cells))
    side = [np.concatenate([[0], np.cumsum(sides == s)]) for s in (0, 1)]
    mid1 = starts + side[0][ends] - side[0][starts]
    mid2 = mid1 + side[1][ends] - side[1][starts]
    pairs = [(starts, mid1, starts, mid1), (mid1, mid2, mid2, ends)]
    a, b, c, d = (np.concatenate(x) for x in zip(*pairs, strict=True))
    live = (b > a) & (d > c) & ~((a == c) & (b - a < 2))
    labels = np.arange(len(cells))
    for i, j in join_tries(prints, (a[live], b[live], c[live], d[live], np.zeros(live.sum(), np.int64)), budget):
        labels = unite(labels, i, j)
    child = np.flatnonzero(labels != np.arange(len(labels)))
    return docs[child], docs[labels[child]]


def _forests(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            held.append(np.stack([np.asarray(batch.column(k)) for k in range(4)]))
            rows += batch.num_rows
            if rows < _BATCH:
                continue
            all_rows = np.concatenate(held, axis=1)
            cut = int(np.searchsorted(all_rows[0], all_rows[0, -1]))  # the last cell may go on
            held, rows = [all_rows[:, cut:]], all_rows.shape[1] - cut
            if cut:
                yield out(all_rows[:, :cut])
        if rows:
            yield out(np.concatenate(held, axis=1))

    def out(rows: np.ndarray) -> pa.RecordBatch:
        prints = rows[2].view(np.uint64) ^ np.uint64(1 << 63)  # was sorted as a signed number
        a, b = _forest(rows[0], rows[1], prints, rows[3], budget)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _bits(value: Column, start: Column, n: int) -> Column:
    """``n`` bits of a long from ``start`` on, 0 being the highest."""
    shifted = F.call_function("shiftrightunsigned", value, (F.lit(BITS - n) - start).cast("int"))
    return shifted.bitwiseAND(F.lit((1 << n) - 1))


def cells(prints: DataFrame, budget: int = BUDGET, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, list[str]]:
    """(cell, side, fp, doc) such that any two fingerprints within the budget meet in a cell.

    ``prints`` has distinct fp and a doc each.  Within a cell, side 0 is to be joined with itself
    and side 1 with side 2; fp is turned round so that the bits of the cell's block come first.
    Also returns the paths of tables to delete afterwards.
    """
    blocks = budget + 1
    bounds = [BITS * k // blocks for k in range(blocks + 1)]
    turned = F.expr("shiftleft(fp, start) | case when start = 0 then 0L else shiftrightunsigned(fp, 64 - start) end")
    widths = F.array(*(F.struct(F.lit(k).alias("block"), F.lit(low).alias("start"), F.lit(high - low).alias("depth")) for k, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False))))
    now = prints.select("fp", "doc", F.explode(widths).alias("w")).select("fp", "doc", "w.*")
    top = F.expr("shiftrightunsigned(fp, 64 - depth)")
    now = now.withColumn("fp", turned).select(F.xxhash64("block", top).alias("cell"), F.lit(0).cast("long").alias("side"), "fp", "doc", "depth", F.lit(0).alias("spent"))
    parts, paths = [], []
    masks = [F.array(*(F.lit(m).cast("long") for m in range(1 << _STEP) if m.bit_count() <= left)) for left in range(budget + 1)]
    for _ in range(BITS // _STEP):
        large, path = written(now.groupBy("cell").count().where(F.col("count") > cell_rows).select("cell", F.lit(True).alias("large")), "large-cells")
        paths.append(path)
        if large.isEmpty():
            break
        marked = now.join(large, "cell", "left")
        done = F.col("large").isNull() | (F.col("depth") > BITS - _STEP)
        parts.append(marked.where(done).select("cell", "side", "fp", "doc"))
        own = _bits(F.col("fp"), F.col("depth"), _STEP)
        ball = F.element_at(F.array(*masks[::-1]), F.col("spent") + 1)
        pair = marked.where(~done).withColumn("own", own).withColumn("mask", F.explode(ball)).withColumn("other", F.col("own").bitwiseXOR(F.col("mask")))
        side = F.when((F.col("side") > 0) | (F.col("mask") == 0), F.col("side")).otherwise(F.when(F.col("own") < F.col("other"), 1).otherwise(2)).cast("long")
        first = F.when(F.col("side") == 1, F.col("own")).when(F.col("side") == 2, F.col("other")).otherwise(F.least("own", "other"))
        second = F.when(F.col("side") == 1, F.col("other")).when(F.col("side") == 2, F.col("own")).otherwise(F.greatest("own", "other"))
        deeper = pair.select(F.xxhash64("cell", first, second).alias("cell"), side.alias("side"), "fp", "doc", (F.col("depth") + _STEP).alias("depth"), (F.col("spent") + F.bit_count("mask")).alias("spent"))
        now, path = written(deeper, "cells")
        paths.append(path)
    for part in parts:
        now = now.select("cell", "side", "fp", "doc").unionByName(part)
    return now.select("cell", "side", "fp", "doc"), paths


def links(prints: DataFrame, budget: int = BUDGET, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, list[str]]:
    """(a, b) pairs of doc ids whose fingerprints are linked, enough of them to keep the components."""
    dealt, paths = cells(prints, budget, cell_rows)
    rows = dealt.repartition("cell").sortWithinPartitions("cell", "side", F.col("fp").bitwiseXOR(F.lit(-(1 << 63)).cast("long")))
    rows = rows.select("cell", "side", F.col("fp").bitwiseXOR(F.lit(-(1 << 63)).cast("long")).alias("fp"), "doc")
    return rows.mapInArrow(_forests(budget), "a long, b long"), paths


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``df``."""
    spark = df.sparkSession
    docs, _ = written(with_fingerprints(df, doc_id, text, size), "fingerprints")
    return grouped(spark, docs, budget)


def grouped(spark, docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fp, component_id) from a written table of (doc_id, fp)."""
    prints, prints_path = written(docs.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc")), "prints")
    found, paths = links(prints, budget)
    labels = components(found, "a", "b")
    # The table of prints with their components: one row for each distinct fingerprint.
    named = prints.join(labels, prints["doc"] == labels["node"], "left").select("fp", F.coalesce("component", "doc").alias("component_id"))
    named, _ = written(named, "components")
    delete(spark, prints_path, *paths)
    at = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return docs.join(named, "fp", "left").select("doc_id", "fp", at.alias("component_id"))


#: Samples of a text's shingles, shingles in each, and words in a shingle, for ``similar_groups``.
SAMPLES = 18
SAMPLED = 4
SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Texts of so many distinct shingles or fewer, whose samples agree less often, are found by exact prefixes.
SHORT = 20
#: Words of a long fingerprint, and the bits of it in which texts alike by 0.8 may differ: 48 are expected
#: at most, with a deviation of 6.3 (four shingles out of five), and 39 for long texts.
WIDTH = 4
LONG_BUDGET = 74
#: Texts and characters in a block of a cell whose texts are all compared.
BLOCK_ROWS = 256
BLOCK_CHARS = 1_000_000


def path_keys(hashes: np.ndarray, threshold: float) -> tuple[list[int], list[int]]:
    """(sample, fingerprint) of each cell of a text with these shingles.  Two texts alike by the threshold share one surely if one of them is short, else but for one time in 5,000 at 0.8.

    A pair with a short text has no text beyond SHORT / threshold, so that up to there both get the
    shingles of their prefixes, as sample -1; beyond ``SHORT`` texts get samples.
    """
    short = prefix(hashes, threshold) if 0 < len(hashes) <= SHORT / threshold else hashes[:0]
    prints = sampled_fingerprints(hashes, SAMPLES, SAMPLED) if len(hashes) > SHORT else hashes[:0]
    return [-1] * len(short) + [*range(len(prints))], np.concatenate([short, prints]).view(np.int64).tolist()


def _signatures(rows: DataFrame, size: int, threshold: float) -> DataFrame:
    """(doc_id, h1, h2, chars, samples, prints, long): a text's cells and its long fingerprint, of (doc_id, h1, h2, chars, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                made: list[tuple] = []
                for text in part.column(4).to_pylist():
                    hashes = distinct_hashes(text, size)
                    made.append((*path_keys(hashes, threshold), wide_fingerprint(hashes, WIDTH).astype("<u8").tobytes()))
                samples, prints, long = zip(*made, strict=True)
                columns = [*(part.column(k) for k in range(4)), pa.array(samples, pa.list_(pa.int32())), pa.array(prints, pa.list_(pa.int64())), pa.array(long, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "h1", "h2", "chars", "samples", "prints", "long"])

    return rows.mapInArrow(run, "doc_id long, h1 long, h2 long, chars long, samples array<int>, prints array<long>, long binary")


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([np.asarray(batch.column(k)) for k in range(keys)])
        cuts = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            key = values[:, low].tolist()
            if key != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held)


def _within_budget(budget: int):
    """The pairs (doc, first, long_a, long_b) whose long fingerprints are within the budget."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u8").reshape(batch.num_rows, -1) for k in (2, 3))
            near = pa.array(_ones(a ^ b).sum(axis=1) <= budget) if batch.num_rows else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(near) for k in (0, 1)], ["doc", "first"])

    return run


def _near_in_blocks(budget: int):
    """Of pairs of blocks of a cell, the rows whose long fingerprint is within the budget of one of another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, 4):
            prints = np.frombuffer(b"".join(group.column("long").to_pylist()), "<u8").reshape(group.num_rows, -1).astype(np.uint64)
            first = np.asarray(group.column("own")) == group.column("x")[0].as_py()
            order = np.lexsort((*prints.T[::-1], ~first))
            parts = np.asarray(group.column("component"))[order]
            n, mid = len(order), int(first.sum())
            ranges = ([0], [n], [0], [n]) if mid == n else ([0], [mid], [mid], [n])
            marked = np.zeros(n, bool)
            for i, j in join_tries(prints[order], tuple(np.array(x) for x in (*ranges, [0])), budget):
                apart = parts[i] != parts[j]
                marked[i[apart]] = marked[j[apart]] = True
            if marked.any():
                yield from group.select(["sample", "fp", "x", "y", "node", "component"]).take(pa.array(order[marked])).to_batches()

    return run


def _alike_in_blocks(size: int, threshold: float):
    """A spanning forest of the links among the texts of a pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, 4):
            yield block(group)

    def block(group: pa.Table) -> pa.RecordBatch:
        docs, parts = (np.asarray(group.column(name)) for name in ("node", "component"))
        child = root = np.empty(0, np.int64)
        if (parts != parts[0]).any():
            sets = [distinct_hashes(t, size) for t in group.column("text").to_pylist()]
            n = np.array([len(x) for x in sets], np.int64)
            owner = np.repeat(np.arange(len(sets)), n)
            _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
            shared = count > 1  # only these count in an overlap
            owner, column = owner[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
            both = np.zeros((len(sets), len(sets)))
            step = max(1, (1 << 24) // len(sets))
            by_column = np.argsort(column, kind="stable")
            owner, column = owner[by_column], column[by_column]
            for low in range(0, int(shared.sum()), step):
                a, b = np.searchsorted(column, (low, low + step))
                has = np.zeros((len(sets), min(step, int(shared.sum()) - low)), np.float32)
                has[owner[a:b], column[a:b] - low] = 1
                both += has @ has.T
            either = n[:, None] + n[None] - both
            i, j = np.nonzero(np.triu((both / np.maximum(either, 1) >= threshold) & (parts[:, None] != parts[None]), 1))
            labels = unite(np.arange(len(sets)), i, j)
            child = np.flatnonzero(labels != np.arange(len(labels)))
            child, root = docs[child], docs[labels[child]]
        return pa.RecordBatch.from_arrays([pa.array(child, pa.int64()), pa.array(root, pa.int64())], ["a", "b"])

    return run


def _rest(others: DataFrame, labels: DataFrame, classes: DataFrame, texts_of, size: int, threshold: float, paths: list[str]) -> DataFrame | None:
    """(a, b) links among the texts of a cell besides its first, where ``labels`` leave these in several components; None if there are none.

    All texts of such a cell are compared, in pairs of blocks of about ``BLOCK_ROWS`` texts and
    ``BLOCK_CHARS`` characters, each pair in a group of its own: first the tries of their long
    fingerprints are joined, then the texts that this leaves.  Cells with the same texts count once.
    """
    at = others.join(labels, others["doc"] == labels["node"], "left").select("sample", "fp", "doc", F.coalesce("component", "doc").alias("component"))
    ends = at.groupBy("sample", "fp").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"), F.bit_xor(F.xxhash64("doc")).alias("docs"))
    open_ = ends.where("low <> high").groupBy("n", "docs").agg(F.min(F.struct("sample", "fp")).alias("p")).select("p.*")
    members, path = written(at.join(open_, ["sample", "fp"], "left_semi").join(classes.select("node", "chars", "long"), F.col("doc") == F.col("node")).drop("doc"), "open-cells")
    paths.append(path)
    if members.isEmpty():
        return None
    blocks = members.groupBy("sample", "fp").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("chars") / BLOCK_CHARS, F.lit(1.0))).cast("long").alias("blocks"))
    dealt = members.join(blocks, ["sample", "fp"]).withColumn("own", F.pmod(F.xxhash64("node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keys = ("sample", "fp", "x", "y")
    dealt = dealt.select(F.col("sample").cast("long").alias("sample"), "fp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "component", "long")
    near = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_near_in_blocks(LONG_BUDGET), "sample long, fp long, x long, y long, node long, component long")
    near, path = written(near, "near-rows")
    paths.append(path)
    if near.isEmpty():
        return None
    texts = near.join(texts_of(near.select("node").distinct()), "node").select(*keys, "node", "component", "text")
    found, path = written(texts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_alike_in_blocks(size, threshold), "a long, b long"), "links")
    paths.append(path)
    return None if found.isEmpty() else found


def similar_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, threshold: float = SIMILARITY) -> DataFrame:
    """(h1, h2, doc_id, kept_h1, kept_h2, kept_id) for each distinct text: its two hashes (``text_keys``), its least doc_id, and those of the text of its group that has the least doc_id.

    Groups are the components of texts whose sets of shingles are alike by the threshold.  Texts this
    alike differ in about ten of 64 SimHash bits, too many for blocks of equal bits to find them by.
    So the tries are dealt into cells by SimHash fingerprints of ``SAMPLES`` samples, each of the
    ``SAMPLED`` shingles that come first in an order of its own, independent of the others: two texts
    alike by 0.8 share one of these cells but for one in 5,000, and short texts surely, by single
    shingles (``path_keys``).  Within a cell texts are compared by fingerprints of ``WIDTH`` * 64 bits
    with an error budget of ``LONG_BUDGET`` bits, and those within it by their whole sets of
    shingles: each text with the first of its cell, and then, where this leaves several components
    among the others there, all of these with each other, by joining their tries.  Equal texts meet
    beforehand.  Groups are of texts, so rows that share a doc_id but not the text don't
    mix; a row without a doc_id comes after all others of its group.
    """
    spark = df.sparkSession
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), *text_keys(F.col(text)), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("chars"), F.col(text).alias("text"))
    signed, signed_path = written(_signatures(rows, size, threshold), "signatures")
    by_text = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.any_value("chars").alias("chars"), F.any_value("long").alias("long"), F.any_value(F.arrays_zip("samples", "prints")).alias("paths"))
    # The numbers are read back from what is written here, once.
    classes, classes_path = written(by_text.withColumn("node", F.monotonically_increasing_id()), "classes")
    paths = [signed_path, classes_path]

    def texts_of(nodes: DataFrame) -> DataFrame:
        """(node, text), read from one row of each class."""
        wanted = classes.join(nodes, "node", "left_semi").select("node", F.col("h1").alias("k1"), F.col("h2").alias("k2"), F.col("doc_id").alias("id"))
        found = rows.join(wanted, (rows["h1"] == F.col("k1")) & (rows["h2"] == F.col("k2")) & rows["doc_id"].eqNullSafe(F.col("id")))
        table, path = written(found.select("node", "text").dropDuplicates(["node"]), "texts")
        paths.append(path)
        return table

    prints = classes.select(F.col("node").alias("doc"), "long", F.explode("paths").alias("p")).select("doc", "long", F.col("p.samples").alias("sample"), F.col("p.prints").alias("fp"))
    first = F.min(F.struct("doc", "long")).alias("first")
    ends, path = written(prints.groupBy("sample", "fp").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "cell-firsts")
    paths.append(path)
    others, path = written(prints.join(ends, ["sample", "fp"]).where("doc <> first.doc"), "cell-others")
    paths.append(path)
    asked = others.select("doc", F.col("first.doc").alias("first"), "long", F.col("first.long").alias("first_long"))
    pairs, path = written(asked.mapInArrow(_within_budget(LONG_BUDGET), "doc long, first long").distinct(), "pairs")
    paths.append(path)
    texts = texts_of(pairs.select(F.col("doc").alias("node")).union(pairs.select(F.col("first").alias("node"))).distinct())
    both = pairs.join(texts.toDF("doc", "a"), "doc").join(texts.toDF("first", "b"), "first").select("doc", "first", "a", "b")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similarity(a, b, size) >= threshold for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(mask) for k in (0, 1)], ["a", "b"])

    found, path = written(both.mapInArrow(alike, "a long, b long"), "links")
    paths.append(path)
    labels = components(found, "a", "b")
    rest = _rest(others, labels, classes, texts_of, size, threshold, paths)
    if rest is not None:
        labels = components(labels.toDF("a", "b").unionByName(rest), "a", "b")
    named = classes.join(labels, "node", "left").select("h1", "h2", "doc_id", F.coalesce("component", "node").alias("component"))
    named, path = written(named, "components")
    paths.append(path)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("kept_id"), F.col("h1").alias("kept_h1"), F.col("h2").alias("kept_h2"))).alias("k")
    kept, path = written(named.groupBy("component").agg(first).select("component", "k.kept_h1", "k.kept_h2", "k.kept_id"), "kept")
    paths.append(path)
    result, _ = written(named.join(kept, "component").drop("component"), "groups")
    delete(spark, *paths)
    return result


def text_keys(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a text, equal for equal texts; a null text counts as an empty one."""
    whole = F.coalesce(text, F.lit(""))
    return F.xxhash64(whole).alias("h1"), F.xxhash64(F.lit(1), whole).alias("h2")


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE_WORDS, threshold: float = SIMILARITY) -> DataFrame:
    """One row of each group of ``similar_groups``: of its least doc_id's, and of repeats of that the first by a hash of the whole row."""
    kept = similar_groups(docs, doc_id, text, size, threshold).select("kept_h1", "kept_h2", "kept_id").distinct()
    h1, h2 = text_keys(docs[text])
    own = docs[doc_id].cast("long")
    rows = docs.join(kept, (h1 == kept["kept_h1"]) & (h2 == kept["kept_h2"]) & own.eqNullSafe(kept["kept_id"]))
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    one = rows.select("kept_h1", "kept_h2", row).groupBy("kept_h1", "kept_h2").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
    return one.select("row.*")


def near_duplicates(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hexadecimal and component of every document."""
    found = groups(df)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
