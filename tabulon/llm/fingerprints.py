"""64-bit SimHash fingerprints of word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tabulon.llm.common import words

SEED = 42
_BLOCK = 1 << 16


def shingle_hashes(text: str | None, size: int) -> Iterator[np.ndarray]:
    """XXH64 of the text's shingles, repeats included, in blocks; fewer words than ``size`` make one shingle."""
    parts = words(text)
    if not parts:
        return
    joined = b" ".join(parts)
    ends = list(accumulate(map(len, parts), lambda end, n: end + n + 1))
    starts = [0, *(end + 1 for end in ends)]
    digest = xxhash.xxh64_digest
    last = ends[size - 1 :] or ends[-1:]
    for low in range(0, len(last), _BLOCK):
        yield np.frombuffer(b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[low : low + _BLOCK], last[low : low + _BLOCK], strict=False)]), ">u8")


def fingerprint(text: str | None, size: int = 3) -> int:
    """The majority bits of the shingles' hashes: 1 where over half have a 1; 0 for a text without words."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, size):
        bits = np.unpackbits(hashes.view(np.uint8)).view(np.uint64).reshape(-1, 8)
        sums = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)  # a byte holds the sum of 255 bits
        ones += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def with_fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t, size) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return df.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"`{text}` as text").mapInArrow(run, "doc_id long, fp long")


def _mixed(hashes: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The hashes put into an order for each seed, independent of the others (splitmix64's finaliser over hash plus seed)."""
    x = hashes[None] + seeds[:, None]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _seeds(n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(k.to_bytes(4, "little"), SEED) for k in range(n)], np.uint64)


_WIDE_SEEDS = ~_seeds(16)


def prefix(text_hashes: np.ndarray, threshold: float) -> np.ndarray:
    """The first of a text's distinct hashes in one order for all texts, so many that any two texts alike by the threshold share one of them."""
    n = len(text_hashes)
    needed = int(np.ceil(threshold * n - 1e-9))
    return text_hashes[np.argsort(_mixed(text_hashes, _seeds(1))[0])[: n - needed + 1]]


def distinct_hashes(text: str | None, size: int) -> np.ndarray:
    blocks = [*shingle_hashes(text, size)]
    return np.unique(np.concatenate(blocks).astype(np.uint64)) if blocks else np.empty(0, np.uint64)


def sampled_fingerprints(hashes: np.ndarray, samples: int, shingles: int) -> np.ndarray:
    """SimHash fingerprints of ``samples`` samples of a text's distinct shingles, each the ``shingles`` that come first in an order of its own."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    seeds = _seeds(samples)
    picked = np.empty((samples, min(shingles, len(hashes))), np.uint64)
    for low in range(0, samples, step := max(1, (1 << 20) // len(hashes))):
        orders = _mixed(hashes, seeds[low : low + step])
        first = np.argpartition(orders, shingles - 1, axis=1)[:, :shingles] if len(hashes) > shingles else np.broadcast_to(np.arange(len(hashes)), orders.shape)
        picked[low : low + step] = hashes[first]
    bits = np.unpackbits(picked.astype(">u8").view(np.uint8).reshape(samples, -1, 8), axis=2)
    ones = bits.sum(axis=1, dtype=np.int64)
    return np.packbits(2 * ones > picked.shape[1], axis=1).view(">u8").reshape(-1).astype(np.uint64)


def wide_fingerprint(hashes: np.ndarray, width: int) -> np.ndarray:
    """A SimHash fingerprint of ``width`` times 64 bits of a text's distinct shingles, each word from hashes of its own."""
    ones = np.zeros((width, 64), np.int64)
    for low in range(0, len(hashes), _BLOCK):
        mixed = _mixed(hashes[low : low + _BLOCK], _WIDE_SEEDS[:width])
        bits = np.unpackbits(mixed.astype(">u8").view(np.uint8).reshape(width, -1, 8), axis=2)
        ones += bits.sum(axis=1, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), axis=1).view(">u8").reshape(-1).astype(np.uint64)


def similarity(a: str | None, b: str | None, size: int) -> float:
    """Jaccard similarity of two texts' sets of shingles; 1 for two texts without words."""
    x, y = (distinct_hashes(t, size) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0
