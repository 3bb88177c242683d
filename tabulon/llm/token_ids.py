"""Tokenized corpora as files of frames (see ``pfor``), written and read by Spark.

With a tokenizer that lower-cases and keeps words by the pattern ``_WORDS``, texts are cut at ASCII
white space, where no token can reach across, and A-Z are lower-cased, as the tokenizer does itself (but not in
texts that hold ``<|``: its own tokens are found before that, in their one spelling).  Cutting, telling pieces
apart and putting ids in their places are done on columns; each distinct piece is encoded once per worker while
it is remembered.  Any other tokenizer gets whole texts.

Rows are dealt by ranges of doc_id before they are encoded, so the files, in order of their frames'
partition and sequence, hold the documents in ascending order.  Files go through Spark's text
writer, which puts one byte after each frame, and come back through its binary reader.

Defined cases: a null text is an empty one, whose only id is the end id.  Null doc_ids come first.
Rows with the same doc_id are ordered by their texts; repeated rows are all kept.  An empty table
makes no frames.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.files import delete, fresh
from tabulon.llm import pfor
from tabulon.llm.common import written

END_ID = 2
FRAME_IDS = 1 << 16
FRAMES_PER_FILE = 64
_REMEMBERED = 350_000
_REMEMBERED_BYTES = 32 << 20
_TOGETHER = 512
#: Bytes of text whose pieces are told apart at once.
_SLICE = 8 << 20
_LOOKED_UP = 100_000
#: What word_bpe_49k.json keeps as words, given by its pre-tokenizer.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_END = "</w>"
_MARKS = b".,;:!?*&%$#|-)]}"
#: Letters of every Unicode version in use that are still one letter each when composed and lower-cased.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u052f\u4e00-\u9fa5\uac00-\ud7a3]+")


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts in runs of up to _SLICE bytes, or of one."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, before = 0, 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(ends, before + _SLICE, "right")))
        yield texts.slice(start, end - start)
        start, before = end, int(ends[end - 1])


def _plain(piece: bytes) -> bool:
    """Whether a piece is letters that certainly make one word."""
    return piece.isalpha() or (not piece.isascii() and _LETTERS.fullmatch(piece.decode()) is not None)


def _parts(piece: bytes) -> tuple[bytes, ...]:
    """Letters with marks after them are two words, of which each may be known; any other piece stays whole."""
    stem = piece.rstrip(_MARKS)
    return (stem, piece[len(stem) :]) if len(stem) < len(piece) and _plain(stem) else (piece,)


class PieceEncoder:
    """The tokenizers library with a bounded memory of pieces."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        splits = [p.get("pattern", {}).get("Regex") for p in (parts["pre_tokenizer"] or {}).get("pretokenizers", ())]
        normal = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", ())]
        marked = all(t["content"].startswith("<|") for t in parts["added_tokens"])
        self.by_pieces = _WORDS in splits and normal == ["NFC", "Replace", "Lowercase"] and marked and parts["model"].get("end_of_word_suffix") == _WORD_END
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True
        # Two generations: when the younger is full it becomes the older, of which only what is asked again stays.
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.known_bytes = 0

    def encode(self, texts: list[str | None] | pa.Array) -> Iterator[np.ndarray]:
        """Ids (uint32) of each text."""
        for some in _slices(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())):
            if self.by_pieces:
                yield from self._by_pieces(some.fill_null(""))
                continue
            for start in range(0, len(some), 256):
                whole = [t or "" for t in some.slice(start, 256).to_pylist()]
                yield from (np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False))

    def _by_pieces(self, texts: pa.Array) -> Iterator[np.ndarray]:
        split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        pieces = split.flatten().dictionary_encode()
        if not len(pieces):
            yield from (np.empty(0, np.uint32) for _ in range(len(texts)))
            return
        distinct = pieces.dictionary.cast(pa.large_binary())
        found = [ids for start in range(0, len(distinct), _LOOKED_UP) for ids in self._find(distinct.slice(start, _LOOKED_UP).to_pylist())]
        ids = pa.array(found, pa.large_binary()).take(pieces.indices)
        starts = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset) // 4
        flat = np.frombuffer(ids.buffers()[2], np.uint32, starts[-1]) if starts[-1] else np.empty(0, np.uint32)
        offsets = split.offsets.to_numpy()
        bounds = starts[offsets - offsets[0]].tolist()
        yield from (flat[low:high] for low, high in zip(bounds, bounds[1:], strict=False))

    def _find(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of distinct pieces."""
        known, before = self.known, self.before
        found = [*map(known.get, pieces)]
        missing = [(at, _parts(pieces[at])) for at, ids in enumerate(found) if ids is None]
        needed = {part for _, parts in missing for part in parts}.difference(known)
        again = {part: before[part] for part in needed.intersection(before)}
        known.update(again)
        self.known_bytes += sum(map(len, again)) + sum(map(len, again.values()))
        todo = [*needed.difference(again)]
        for start in range(0, len(todo), _TOGETHER):
            self._learn(todo[start : start + _TOGETHER])
        for at, parts in missing:
            found[at] = b"".join([known[part] for part in parts])
        if len(known) > _REMEMBERED or self.known_bytes > _REMEMBERED_BYTES:
            self.before, self.known, self.known_bytes = known, {}, 0
        return found

    def _learn(self, pieces: list[bytes]) -> None:
        """Encode pieces together.  Those of plain letters are one word each, which its last token ends; of others the library tells the piece of every id."""
        plain, other = [], []
        for piece in pieces:
            (plain if _plain(piece) else other).append(piece)
        if plain:
            one = self.tokenizer.encode_batch_fast([b" ".join(plain).decode()], add_special_tokens=False)[0]
            ids = np.array(one.ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(plain) and ends[-1] == len(ids):
                self._keep(plain, ids, [0, *ends.tolist()])
            else:
                other = pieces
        if other:
            one = self.tokenizer.encode_batch([[piece.decode() for piece in other]], is_pretokenized=True, add_special_tokens=False)[0]
            bounds = np.searchsorted(np.array(one.word_ids, np.int64), np.arange(len(other) + 1))
            self._keep(other, np.array(one.ids, np.uint32), bounds.tolist())

    def _keep(self, pieces: list[bytes], ids: np.ndarray, bounds: list[int]) -> None:
        raw = ids.tobytes()
        for piece, low, high in zip(pieces, bounds, bounds[1:], strict=False):
            self.known[piece] = raw[4 * low : 4 * high]
        self.known_bytes += sum(map(len, pieces)) + len(raw)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder of a tokenizer in each worker."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def write_files(df: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Encode (doc_id, text) rows and write them as files of frames in ascending order of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, partition = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        names: list[int | None] = []
        held: list[np.ndarray] = []
        size, sequence, first = 0, 0, 0
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), codec.encode(batch.column(1)), strict=True):
                names.append(name)
                held.append(np.concatenate([ids, end]))
                size += len(ids) + 1
                if size >= FRAME_IDS:
                    yield _one(pfor.frame(names, held, partition, sequence, first))
                    first += size
                    names, held, size, sequence = [], [], 0, sequence + 1
        if held:
            yield _one(pfor.frame(names, held, partition, sequence, first))

    rows = df.selectExpr(f"cast(`{doc_id}` as long) as doc_id", f"coalesce(`{text}`, '') as text")
    dealt = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    lines = dealt.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
    lines.write.option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", FRAMES_PER_FILE).text(path)


def _one(frame: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([frame], pa.binary())], ["frame"])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def partition_starts(facts: DataFrame) -> DataFrame:
    """(partition, before): ids in all partitions before each, from the (partition, at, n_tokens) of every document."""
    totals = facts.groupBy("partition").agg(F.max(F.col("at") + F.col("n_tokens")).alias("ids"))
    # One row for each partition of the writing job: their number is a setting, not a size of the data.
    before = F.sum("ids").over(Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("partition", F.coalesce(before, F.lit(0)).alias("before"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, partition, at, n_tokens, ids) of every document; ids are little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                for one in pfor.frames(content):
                    docs = [*pfor.documents(content, one)]
                    columns = ([d[0] for d in docs], [one.partition] * len(docs), [d[1] for d in docs], [len(d[2]) for d in docs])
                    arrays = [pa.array(c, pa.int64()) for c in columns] + [pa.array([d[2].astype("<u4").tobytes() for d in docs], pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "partition", "at", "n_tokens", "ids"])

    return _files(spark, path).mapInArrow(run, "doc_id long, partition long, at long, n_tokens long, ids binary")


def round_trip(df: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from files that were written and read back."""
    spark = df.sparkSession
    path = fresh(spark, "token-ids")
    write_files(df, path, tokenizer)
    facts = read_files(spark, path).select("doc_id", "partition", "at", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    found, _ = written(facts, "token-facts")
    starts, _ = written(partition_starts(found), "partition-starts")
    delete(spark, path)
    return found.join(starts, "partition").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
