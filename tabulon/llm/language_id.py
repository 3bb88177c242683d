"""Language identification with hyperdimensional profiles.

Every letter owns a random bipolar vector.  A trigram is the element-wise product (binding) of its
letters' vectors, each rotated by its distance from the trigram's end; a text is the sum (bundle)
of its trigrams, and a language's prototype the sum over its training texts.  A text gets the
language whose prototype has the largest cosine with it.

Text is folded to lower case and every run of non-letters becomes one blank, itself a symbol.

Defined cases: a null text, an empty one or one without a letter gives ``und`` and score 0, and so
does everything when nothing was learned.  Rows without a language or without a letter teach
nothing.  Equal cosines go to the smaller language name.  Repeated rows count as often as they
occur.  Texts are used whole; trigrams are counted in pieces of ``SLICE`` characters, each with the two
symbols before it.  What comes to the driver and goes to every task is 8 * ``DIMENSIONS`` bytes (16 KB) for
each language, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 2048
SLICE = 2_000_000
UNKNOWN = "und"
_BLANK = 0
_SHIFT = 21
_CACHE_ROWS = 40_000


class TrigramVectors:
    """Row numbers of trigrams and their vectors, made when first seen and kept up to a bound."""

    def __init__(self, dimensions: int = DIMENSIONS) -> None:
        self.dimensions = dimensions
        self.letters = np.array([chr(c).isalpha() for c in range(0x110000)])
        self.letter_vectors: dict[int, np.ndarray] = {}
        self._clear()

    def _clear(self) -> None:
        self.known = np.empty(0, np.int64)
        self.rows = np.empty(0, np.int64)
        self.vectors = np.empty((4096, self.dimensions), np.int8)

    def _letter(self, code: int) -> np.ndarray:
        vector = self.letter_vectors.get(code)
        if vector is None:
            bits = np.random.Generator(np.random.Philox(key=code)).integers(0, 2, self.dimensions, dtype=np.int8)
            vector = self.letter_vectors[code] = bits * 2 - 1
        return vector

    def _vector(self, trigram: int) -> np.ndarray:
        mask = (1 << _SHIFT) - 1
        first, second, third = trigram >> 2 * _SHIFT, trigram >> _SHIFT & mask, trigram & mask
        return np.roll(self._letter(first), 2) * np.roll(self._letter(second), 1) * self._letter(third)

    def bundle(self, trigrams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the trigrams' vectors, each as often as counted; the trigrams are distinct and sorted."""
        total = np.zeros(self.dimensions, np.float64)
        for start in range(0, len(trigrams), 1024):
            rows = self._rows(trigrams[start : start + 1024])
            total += counts[start : start + 1024].astype(np.float32) @ self.vectors[rows].astype(np.float32)
        return total

    def _rows(self, trigrams: np.ndarray) -> np.ndarray:
        places = np.searchsorted(self.known, trigrams)
        new = np.append(self.known, -1)[places] != trigrams
        if new.any():
            if len(self.known) + np.count_nonzero(new) > _CACHE_ROWS:
                self._clear()
                return self._rows(trigrams)
            fresh = trigrams[new]
            first = len(self.known)
            while first + len(fresh) > len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
            for row, trigram in enumerate(fresh.tolist(), first):
                self.vectors[row] = self._vector(trigram)
            self.rows = np.insert(self.rows, places[new], first + np.arange(len(fresh)))
            self.known = np.insert(self.known, places[new], fresh)
            places = np.searchsorted(self.known, trigrams)
        return self.rows[places]

    def trigrams(self, texts: list[str]) -> list[np.ndarray]:
        """The trigram codes of each text; empty for a text without a letter."""
        joined = "\x00".join(f" {text.lower()} " for text in texts)
        points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        ends = np.flatnonzero(points == 0)
        if len(ends) != len(texts) - 1:  # a text holds the separator itself
            return [codes for text in texts for codes in self.trigrams([text.replace("\x00", " ")])]
        letter = self.letters[points]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] = True
        keep[ends[ends + 1 < len(points)] + 1] = True  # the blank before each text
        keep[ends] = False
        after = np.concatenate([[0], np.cumsum(keep)])
        symbols = np.where(letter, points, _BLANK)[keep]
        bounds = after[np.concatenate([[0], ends, [len(points)]])]
        codes = symbols[:-2] << 2 * _SHIFT | symbols[1:-1] << _SHIFT | symbols[2:]
        return [self._whole(codes[low : max(low, high - 2)]) for low, high in zip(bounds[:-1], bounds[1:], strict=True)]

    @staticmethod
    def _whole(codes: np.ndarray) -> np.ndarray:
        return codes if len(codes) and codes.any() else codes[:0]


_vectors: TrigramVectors | None = None


def _shared(dimensions: int) -> TrigramVectors:
    """One table of vectors in each Python worker."""
    global _vectors
    if _vectors is None or _vectors.dimensions != dimensions:
        _vectors = TrigramVectors(dimensions)
    return _vectors


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about SLICE characters, with the place of the first; a longer text is a run of its own."""
    start, size, held = 0, 0, []
    for k, text in enumerate(texts):
        if held and size + len(text or "") > SLICE:
            yield start, held
            start, size, held = k, 0, []
        held.append(text or "")
        size += len(held[-1])
    if held:
        yield start, held


def _pieces(text: str) -> Iterator[tuple[str, bool]]:
    """A text in pieces of about SLICE characters, and whether something comes before.

    A piece ends after a letter that a blank follows; the next one begins with that letter, so its
    first trigram, which has a blank before the letter, isn't one of the text's.
    """
    start, more = 0, False
    while len(text) - start > SLICE:
        end = start + max(SLICE, 2)
        while end < len(text) and not (text[end] == " " and text[end - 1].isalpha()):
            end += 1
        if end == len(text):
            break
        yield text[start:end], more
        start, more = end - 1, True
    yield text[start:], more


def _bundles(vectors: TrigramVectors, texts: list[str]) -> Iterator[np.ndarray | None]:
    """Each text's bundle; None for a text without a letter."""
    if len(texts) == 1 and len(texts[0]) > SLICE:
        total = None
        for piece, more in _pieces(texts[0].lower()):  # what a letter becomes may depend on its neighbours
            (codes,) = vectors.trigrams([piece])
            if len(codes := codes[int(more) :]):
                found = vectors.bundle(*np.unique(codes, return_counts=True))
                total = found if total is None else total + found
        yield total
        return
    for codes in vectors.trigrams(texts):
        yield vectors.bundle(*np.unique(codes, return_counts=True)) if len(codes) else None


def learn(df: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Language prototypes, bundled per partition and language and then added up by Spark."""

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _shared(dimensions)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for start, texts in _slices(batch.column(0).to_pylist()):
                if len(texts) == 1 and len(texts[0]) > SLICE:
                    (found,) = _bundles(vectors, texts)
                    if found is not None:
                        sums[langs[start]] = sums[langs[start]] + found if langs[start] in sums else found
                    continue
                by_lang: dict[str, list[np.ndarray]] = {}
                for name, codes in zip(langs[start : start + len(texts)], vectors.trigrams(texts), strict=True):
                    if len(codes):
                        by_lang.setdefault(name, []).append(codes)
                for name, parts in by_lang.items():
                    found = vectors.bundle(*np.unique(np.concatenate(parts), return_counts=True))
                    sums[name] = sums[name] + found if name in sums else found
        for name, total in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [name], "bundle": [np.rint(total).astype(np.int64)]})

    named = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text), F.col(lang).cast("string"))
    parts = named.mapInArrow(bundles, "lang string, bundle array<long>")
    sums = parts.select("lang", F.posexplode("bundle")).groupBy("lang", "pos").agg(F.sum("col").alias("total"))
    whole = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "total"))), lambda x: x["total"]).alias("bundle")).toArrow()
    names, bundles_ = whole.column(0).to_pylist(), whole.column(1)
    return {name: np.array(bundles_[k].as_py(), np.float64) for name, k in sorted(zip(names, range(len(names)), strict=True))}


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", dimensions: int = DIMENSIONS, made: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``df`` with the language and the score (the cosine, 0 where it is negative) appended under the names ``made``."""
    names = [*prototypes]
    profile = np.array([p / (np.linalg.norm(p) or 1) for p in prototypes.values()]).reshape(len(names), dimensions)
    place = df.columns.index(text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = _shared(dimensions)
        for batch in batches:
            langs, scores = [], []
            for _, texts in _slices(batch.column(place).to_pylist()):
                for bundle in _bundles(vectors, texts):
                    if bundle is None or not names:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    cosines = profile @ bundle / (np.linalg.norm(bundle) or 1)
                    best = int(np.argmax(cosines))
                    langs.append(names[best])
                    scores.append(min(1.0, max(0.0, float(cosines[best]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, *made])

    schema = df.select("*", F.lit("").alias(made[0]), F.lit(0.0).alias(made[1])).schema
    return df.mapInArrow(scored, schema)


def held_out(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    """Whether crc32 of the id as text leaves ``part`` when divided by ``parts``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == part


def identify(df: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from those not held out."""
    prototypes = learn(df.where(~held_out(F.col("doc_id"))))
    found = predict(df.select("doc_id", "text"), prototypes)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
