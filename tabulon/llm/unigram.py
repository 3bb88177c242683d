"""SentencePiece encoding by streaming Viterbi, and decoding.

The pieces and scores of a model file are used as a unigram model: of all ways to cut the text into
pieces, the ids are those with the largest sum of scores; of equal sums the one whose last piece is
longer wins, at every boundary.  A character that is no piece costs ten less than the least score
and is written as the pieces of its bytes.

The text is read once, from end to end.  Scores are kept of the boundaries that a piece still reaches,
and of at most ``SLACK`` older ones; of these only the backpointers stay, until their ids are
committed.  That happens where all surviving backpointer paths run through one boundary: at once where
no piece reaches across, else as soon as tracing back the open boundaries' paths finds a common one.
Where no piece goes on after a blank, the path starts anew at each word.  So the reader, when it comes
to the start of a word that it remembers, commits the word's ids and goes on behind it.  Remembered
words take ``REMEMBERED_BYTES`` in each of two generations at most.

Blanks are written as ``▁`` and one is put in front, as the model's normaliser says.  Decoding
takes pieces and bytes together, blanks back, and the one in front away.

Defined cases: a null or empty text has no ids, and no ids decode to the empty text.  Bytes that
aren't UTF-8 decode to the replacement character.  A text's own ``▁`` comes back as a blank.
Repeated rows are encoded alike; texts are encoded whole whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
REMEMBERED_BYTES = 128 << 20
#: What a remembered word takes beside its letters and ids.
_ENTRY_BYTES = 240
_NEVER = float("-inf")
SLACK = 1024


class Codec:
    """Encoder and decoder of one model's pieces."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]) -> None:
        """``kinds`` has, for each piece, ``normal``, ``byte``, ``unknown`` or anything else for pieces that no text makes."""
        self.bytes = [b""] * len(pieces)
        self.of_byte = [-1] * 256
        self.unknown = next((i for i, kind in enumerate(kinds) if kind == "unknown"), 0)
        #: letter: (the letters after it, id of the piece that ends here or -1, its score)
        self.trie: dict = {}
        normal = [i for i, kind in enumerate(kinds) if kind == "normal"]
        self.longest = max((len(pieces[i]) for i in normal), default=1)
        self.lengths = [*map(len, pieces), 1]  # the last, also of piece -1, is of a character that is no piece
        self.penalty = min((scores[i] for i in normal), default=0.0) - 10
        for i in normal:
            node = self.trie
            for letter in pieces[i][:-1]:
                node = node.setdefault(letter, ({}, -1, 0.0))[0]
            after, known, _ = node.get(pieces[i][-1], ({}, -1, 0.0))
            if known < 0:
                node[pieces[i][-1]] = (after, i, scores[i])
            self.bytes[i] = pieces[i].replace(BLANK, " ").encode()
        for i, kind in enumerate(kinds):
            if kind == "byte":
                self.of_byte[int(pieces[i][3:5], 16)] = i
                self.bytes[i] = bytes([int(pieces[i][3:5], 16)])
        # Where no piece has a blank after something else, every path runs through the start of a word.
        self.by_words = all(BLANK not in pieces[i].lstrip(BLANK) for i in normal)
        self.word_end = re.compile(f"(?<!{BLANK}){BLANK}").search
        self.known: dict[str, list[int]] = {}
        self.before: dict[str, list[int]] = {}
        self.size = 0

    @classmethod
    def load(cls, path: str) -> Codec:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        kinds = ["byte" if model.is_byte(i) else "unknown" if model.is_unknown(i) else "other" if model.is_control(i) or model.is_unused(i) else "normal" for i in ids]
        return cls([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids], kinds)

    def stream(self, text: str, remember: bool = False) -> Iterator[list[int]]:
        """Ids of normalised text, in the portions that are committed together."""
        n, trie, penalty, longest = len(text), self.trie, self.penalty, self.longest
        # Of the boundaries from ``low`` on their scores, and of those from ``base`` on their last pieces.
        base = low = start = reach = word_end = 0
        fresh = [0.0] + [_NEVER] * longest, [None] * (longest + 1)
        best, back = fresh[0][:], fresh[1][:]
        wait = 4 * longest
        word: str | None = None
        made: list[int] = []
        remember = remember and self.by_words
        while start < n:
            if start == reach:  # no piece reaches across this boundary
                if start > base:
                    portion = self._ids(back, base, start, text)
                    yield portion
                    made += portion
                    base = low = start
                    best, back = fresh[0][:], fresh[1][:]
                if remember and start >= word_end:
                    if word is not None:
                        self._keep(word, made)
                    found = self.word_end(text, start + 1)
                    word_end = found.start() if found else n
                    word, made = text[start:word_end], []
                    if (ids := self._remembered(word)) is not None:
                        yield ids
                        base = low = start = reach = word_end
                        word = None
                        continue
            elif start - base >= wait:
                common = self._common(back, base, start, reach)
                if common > base:
                    portion = self._ids(back, base, common, text)
                    yield portion
                    made += portion
                    del back[: common - base]
                    base, wait = common, 4 * longest
                else:
                    wait *= 2
                if start - low > SLACK:
                    del best[: start - low]
                    low = start
            score = best[start - low]
            best.append(_NEVER)
            back.append(None)
            if score != _NEVER:
                node, at, shift, single = trie, start - low, low - base, False
                first = at + 1
                for letter in text[start : start + longest]:
                    found = node.get(letter)
                    if found is None:
                        break
                    node, piece, value = found
                    at += 1
                    if piece >= 0:
                        if at == first:
                            single = True
                        if low + at > reach:
                            reach = low + at
                        if score + value > best[at]:
                            best[at] = score + value
                            back[at + shift] = piece
                if not single:
                    if low + first > reach:
                        reach = low + first
                    if score + penalty > best[first]:
                        best[first] = score + penalty
                        back[first + shift] = -1
            start += 1
        if n > base:
            portion = self._ids(back, base, n, text)
            yield portion
            made += portion
        if word is not None:
            self._keep(word, made)

    def _remembered(self, word: str) -> list[int] | None:
        ids = self.known.get(word)
        if ids is None and (ids := self.before.get(word)) is not None:
            self._keep(word, ids)
        return ids

    def _keep(self, word: str, ids: list[int]) -> None:
        own = _ENTRY_BYTES + len(word) + 8 * len(ids)
        if own > REMEMBERED_BYTES // 16:
            return
        if self.size + own > REMEMBERED_BYTES:
            self.before, self.known, self.size = self.known, {}, 0
        self.known[word] = ids
        self.size += own

    def _common(self, back: list, base: int, start: int, reach: int) -> int:
        """The last boundary that the paths of all open boundaries share."""
        alive = {at for at in range(start, reach + 1) if at == base or back[at - base] is not None}
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(last - self.lengths[back[last - base]] if last > base else base)
        return alive.pop() if alive else base

    def _ids(self, back: list, base: int, end: int, text: str) -> list[int]:
        ids: list[int] = []
        while end > base:
            piece = back[end - base]
            start = end - self.lengths[piece]
            if piece >= 0:
                ids.append(piece)
            else:
                raw = text[start:end].encode("utf-8", "replace")
                ids += [self.of_byte[b] if self.of_byte[b] >= 0 else self.unknown for b in reversed(raw)]
            end = start
        ids.reverse()
        return ids

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text."""
        if not text:
            return np.empty(0, np.uint32)
        return np.fromiter(chain.from_iterable(self.stream(BLANK + text.replace(" ", BLANK), remember=True)), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids."""
        text = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec of a model in each worker."""
    if path not in _codecs:
        _codecs.clear()
        _codecs[path] = Codec.load(path)
    return _codecs[path]


def encode(df: DataFrame, model: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` (little-endian unsigned 32-bit integers) appended."""
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                ids = [own.encode(t).astype("<u4").tobytes() for t in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary())], [*part.schema.names, "ids"])

    return df.mapInArrow(run, df.withColumn("ids", F.lit(b"")).schema)


def decode(df: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded`` appended; null ids count as none."""
    place = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                texts = [own.decode(np.frombuffer(i or b"", "<u4")) for i in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, "decoded"])

    return df.mapInArrow(run, df.withColumn("decoded", F.lit("")).schema)


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and whether the ids decode to the text, of every document.

    One worker of a task encodes and decodes, so that no more of them remember words than there are tasks.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                n, crcs, same = [], [], []
                for text in part.column(1).to_pylist():
                    ids = own.encode(text).astype("<u4").tobytes()
                    n.append(len(ids) // 4)
                    crcs.append(crc32(ids))
                    same.append(own.decode(np.frombuffer(ids, "<u4")) == text)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.int64()), pa.array(same)], ["doc_id", "n_tokens", "ids_crc32", "round_trip"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_crc32 long, round_trip boolean")
