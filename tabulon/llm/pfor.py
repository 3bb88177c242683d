"""Binary frames of token ids: patched frame-of-reference blocks under an index.

All numbers are little-endian.  A frame holds whole documents:

    magic ``TPF1`` | u32 bytes in the frame | u32 partition | u32 sequence | u64 ids of the partition
    before this frame | u32 documents | u32 ids | u32 blocks
    documents' ids, i64 each | null flags of these, u8 each | documents' lengths, u32 each
    index: where each block starts, u32 each, counted from the end of the index
    blocks

A block holds ``BLOCK`` ids (the last one may stand for fewer):

    u32 minimum | u8 width | u8 unused | u16 exceptions
    the ids less the minimum, their low ``width`` bits packed, low bits first
    exceptions' places, u8 each | exceptions' whole values less the minimum, u32 each

The width is the ``PERCENTILE`` of the bit lengths in the block; longer values are exceptions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

MAGIC = b"TPF1"
BLOCK = 128
PERCENTILE = 0.9
_HEAD = np.dtype([("magic", "S4"), ("bytes", "<u4"), ("partition", "<u4"), ("sequence", "<u4"), ("first", "<u8"), ("documents", "<u4"), ("ids", "<u4"), ("blocks", "<u4")])
_BLOCK_HEAD = np.dtype([("minimum", "<u4"), ("width", "u1"), ("unused", "u1"), ("exceptions", "<u2")])
HEAD_BYTES = _HEAD.itemsize


def pack(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[np.ndarray, np.ndarray]:
    """(block starts, bytes of the blocks) of ids below 2**32."""
    count = -(-len(ids) // BLOCK)
    if not count:
        return np.empty(0, np.uint32), np.empty(0, np.uint8)
    padded = np.empty(count * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    padded[len(ids) :] = ids[-1]
    values = padded.reshape(count, BLOCK)
    minimum = values.min(axis=1)
    values = values - minimum[:, None]
    lengths = np.frexp(values.astype(np.float64))[1].astype(np.uint8)  # bit lengths
    rank = min(BLOCK, max(1, int(np.ceil(percentile * BLOCK)))) - 1
    width = np.partition(lengths, rank, axis=1)[:, rank]
    outlier = lengths > width[:, None]
    exceptions = outlier.sum(axis=1)
    packed = BLOCK // 8 * width.astype(np.int64)
    sizes = _BLOCK_HEAD.itemsize + packed + 5 * exceptions
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)

    head = np.zeros(count, _BLOCK_HEAD)
    head["minimum"], head["width"], head["exceptions"] = minimum, width, exceptions
    out[starts[:, None] + np.arange(_BLOCK_HEAD.itemsize)] = head.view(np.uint8).reshape(count, -1)
    body = starts + _BLOCK_HEAD.itemsize
    for w in np.unique(width[width > 0]).tolist():
        of = np.flatnonzero(width == w)
        bits = np.unpackbits(values[of].astype("<u4").view(np.uint8).reshape(-1, BLOCK, 4), axis=2, bitorder="little")[:, :, :w]
        out[body[of][:, None] + np.arange(BLOCK // 8 * w)] = np.packbits(bits.reshape(len(of), -1), axis=1, bitorder="little")
    if exceptions.any():
        block, place = np.nonzero(outlier)
        nth = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        at = (body + packed)[block]
        out[at + nth] = place
        at = at + exceptions[block] + 4 * nth
        out[at[:, None] + np.arange(4)] = values[outlier].astype("<u4").view(np.uint8).reshape(-1, 4)
    return starts.astype(np.uint32), out


def unpack(starts: np.ndarray, blocks: np.ndarray, n: int) -> np.ndarray:
    """The ids (uint32) of blocks that begin at ``starts``."""
    count = len(starts)
    starts = starts.astype(np.int64)
    if not count:
        return np.empty(0, np.uint32)
    head = blocks[starts[:, None] + np.arange(_BLOCK_HEAD.itemsize)].copy().view(_BLOCK_HEAD).reshape(-1)
    width, exceptions = head["width"].astype(np.int64), head["exceptions"].astype(np.int64)
    body = starts + _BLOCK_HEAD.itemsize
    values = np.zeros((count, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        of = np.flatnonzero(width == w)
        bits = np.unpackbits(blocks[body[of][:, None] + np.arange(BLOCK // 8 * w)], axis=1, bitorder="little").reshape(len(of), BLOCK, w)
        whole = np.zeros((len(of), BLOCK, 32), np.uint8)
        whole[:, :, :w] = bits
        values[of] = np.packbits(whole, axis=2, bitorder="little").view("<u4")[:, :, 0]
    if exceptions.any():
        block = np.repeat(np.arange(count), exceptions)
        nth = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
        at = (body + BLOCK // 8 * width)[block]
        place = blocks[at + nth]
        at = at + exceptions[block] + 4 * nth
        values[block, place] = blocks[at[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
    values += head["minimum"][:, None]
    return values.reshape(-1)[:n]


def frame(doc_ids: list[int | None], documents: list[np.ndarray], partition: int, sequence: int, first: int) -> bytes:
    """One frame of whole documents."""
    ids = np.concatenate(documents) if documents else np.empty(0, np.uint32)
    starts, blocks = pack(ids)
    head = np.zeros(1, _HEAD)
    tail = [np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], np.uint8), np.array([len(d) for d in documents], "<u4"), starts.astype("<u4"), blocks]
    size = HEAD_BYTES + sum(x.nbytes for x in tail)
    head[0] = (MAGIC, size, partition, sequence, first, len(documents), len(ids), len(starts))
    return b"".join(x.tobytes() for x in (head, *tail))


@dataclass
class Frame:
    """The header of a frame and where its bytes are in a file."""

    partition: int
    sequence: int
    first: int
    documents: int
    ids: int
    blocks: int
    start: int
    end: int


def frames(content: bytes, gap: int = 1) -> Iterator[Frame]:
    """The frames of a file, with ``gap`` bytes after each."""
    at = 0
    while at < len(content):
        head = np.frombuffer(content, _HEAD, 1, at)[0]
        if bytes(head["magic"]) != MAGIC or at + int(head["bytes"]) > len(content):
            raise ValueError(f"no frame at byte {at}")
        numbers = [int(head[name]) for name in ("partition", "sequence", "first", "documents", "ids", "blocks")]
        yield Frame(*numbers, at, at + int(head["bytes"]))
        at += int(head["bytes"]) + gap


def documents(content: bytes, one: Frame) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids of the partition before it, its ids) of each document in a frame."""
    at = one.start + HEAD_BYTES
    doc_ids = np.frombuffer(content, "<i8", one.documents, at)
    at += doc_ids.nbytes
    null = np.frombuffer(content, np.uint8, one.documents, at)
    at += null.nbytes
    lengths = np.frombuffer(content, "<u4", one.documents, at)
    at += lengths.nbytes
    starts = np.frombuffer(content, "<u4", one.blocks, at)
    at += starts.nbytes
    ids = unpack(starts, np.frombuffer(content, np.uint8, one.end - at, at), one.ids)
    ends = np.cumsum(lengths.astype(np.int64))
    for doc_id, is_null, end, n in zip(doc_ids.tolist(), null.tolist(), ends.tolist(), lengths.tolist(), strict=True):
        yield (None if is_null else doc_id), one.first + end - n, ids[end - n : end]


def ids_between(content: bytes, one: Frame, low: int, high: int) -> np.ndarray:
    """Ids low to high of a frame, unpacking only the blocks that hold them."""
    at = one.start + HEAD_BYTES + 13 * one.documents
    starts = np.frombuffer(content, "<u4", one.blocks, at)
    blocks = np.frombuffer(content, np.uint8, one.end - at - starts.nbytes, at + starts.nbytes)
    b, e = low // BLOCK, -(-high // BLOCK)
    return unpack(starts[b:e], blocks, min(one.ids, e * BLOCK) - b * BLOCK)[low - b * BLOCK : high - b * BLOCK]
