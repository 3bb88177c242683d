"""Word n-gram scoring with a weighted backoff automaton learned from the corpus itself.

Tokens are words, A-Z lower-cased, and one end per text.  The model is the hierarchical Dirichlet
one of MacKay and Peto: with the base p1(w) = (c(w) + 1) / (N + V + 1),

    p(w | h) = (c(h w) + mu * p(w | h')) / (c(h) + mu),   h' being h without its first token.

The automaton (``Automaton``) has a state for each context seen in training, of up to order - 1
tokens, and one for none.  An arc leaves a state for each token seen after it; it carries the
smoothed log-probability and leads to the state of the longest seen context that then holds.  The
failure arc is taken where no arc has the token: it carries log10(mu / (c(h) + mu)), reads nothing
and leads to the state of h'.  A text starts in the state of a start mark and is read once from left
to right: the traversal carries the state and adds up what it passes.  As no state looks back over
more than order - 1 tokens, a long text is read by several traversals at the same time, each of
which first reads the order - 1 tokens before its own without adding them.

Counts cover all of the training text.  Documents are turned into chunks: token numbers and the
hashes of their distinct words.  A chunk asks for the counts of its distinct n-grams; requests, with
the chunk's own training counts, are dealt by ranges of the n-grams' hashes to shards, where equal
n-grams of all chunks meet and are summed, and the totals go back to the chunks that asked, each of
which builds the part of the automaton that its texts can reach.  So no task holds the model, a
frequent n-gram comes once from each chunk, and only two totals, N and V, reach the driver.  A
request or reply has at least one n-gram, so there are never more of them than n-grams.  Words are
known by 64-bit hashes; longer n-grams by as many bits as give an unseen one a chance of at most one
in 2 ** ``SPARE_BITS`` to be taken for a seen one.

Defined cases: a null text is an empty one: its only token is the end.  A null doc_id counts as an
empty text when it is drawn for training.  Repeated rows count as often as they occur.  Without
training text N and V are 0.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.files import delete
from tabulon.llm.common import SHUFFLES_END, settings, words, written

ORDER = 4
#: mu of the contexts of one, two and three tokens.
MU = (500.0, 20.0, 5.0)
CHUNK_TOKENS = 1 << 20
#: Tokens for each shard.
SHARD_TOKENS = 1 << 21
LEAST_SHARDS = 64
SPARE_BITS = 12
SEGMENT = 512
#: No word holds a blank.
_END, _START = (xxhash.xxh64_intdigest(mark) for mark in (b" ", b"  "))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _packed(values: np.ndarray) -> bytes:
    """Unsigned integers as planes of their bytes, compressed; the first byte is the number of planes."""
    top = int(values.max(initial=0))
    width = max(1, -(-top.bit_length() // 8))
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.compress(planes.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").reshape(-1)


def _steps(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=np.uint64(0))


def _numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in ascending order, and the place of each code among them."""
    distinct, place = np.unique(codes, return_inverse=True)
    return distinct, place.reshape(-1)


class Chunk:
    """Documents as numbers of their distinct words; number 0 is the end, 1 the start mark."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray, tokens: np.ndarray, held_out: np.ndarray, order: int, bits: int) -> None:
        self.hashes, self.lengths, self.tokens, self.order = hashes, lengths, tokens.astype(np.int64), order
        self.starts = np.cumsum(lengths) - lengths
        self.trained = np.repeat(~held_out, lengths)
        size = len(hashes)
        #: For each order: the n-gram at each token (-1: the text is too short before it), and of the distinct ones, ascending
        #: by context and token: context * size + token, the n-gram without its first token, and the hash.
        #: Order 1 has all words of the chunk and both marks; for order 2 the start mark is a context.
        self.places: list[np.ndarray] = [self.tokens]
        self.codes: list[np.ndarray] = [np.arange(size)]
        self.shorter: list[np.ndarray] = [np.zeros(size, np.int64)]
        self.keys: list[np.ndarray] = [hashes]
        full = hashes
        for k in range(2, order + 1):
            before = np.full(len(tokens), -1, np.int64)
            before[1:] = self.places[-1][:-1]
            before[self.starts] = 1 if k == 2 else -1
            code, place = _numbered(np.where(before >= 0, before * size + self.tokens, -1))
            absent = int(len(code) and code[0] < 0)
            code, place = code[absent:], place - absent
            shorter = np.zeros(len(code), np.int64)
            shorter[place[place >= 0]] = self.places[-1][place >= 0]
            full = (full[code // size] * _MIX ^ (full[code // size] >> np.uint64(29))) + hashes[code % size] * np.uint64(2 * k + 1)
            full ^= full >> np.uint64(32)
            self.places.append(place)
            self.codes.append(code)
            self.shorter.append(shorter)
            self.keys.append(full * _MIX >> np.uint64(64 - bits))

    def counts(self, k: int) -> np.ndarray:
        """How often each distinct n-gram of order k occurs in this chunk's training text."""
        place = self.places[k - 1][self.trained]
        return np.bincount(place[place >= 0], minlength=len(self.keys[k - 1]))

    def dealt(self, k: int, shards: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the n-grams of order k by key, the shards that have any, and their bounds among these places."""
        order = np.argsort(self.keys[k - 1], kind="stable")
        width = (64 if k == 1 else bits) - (shards - 1).bit_length()
        shard = self.keys[k - 1][order] >> np.uint64(max(0, width))
        first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else np.zeros(0, np.int64)
        return order, shard[first].astype(np.int64), np.append(first, len(shard))


class Automaton:
    """The states and arcs that the texts of a chunk can reach.  State 0 has no context.

    ``totals`` are the training counts of the chunk's distinct n-grams, by order; ``n`` and ``v`` count
    the training tokens and the distinct ones, ``documents`` the training texts.  Arcs are numbered
    like the n-grams they complete, one order after the other, so a token's arc from a state with k
    tokens is that of the n-gram of order k + 1 at the token; ``seen`` tells which arcs there are.
    """

    def __init__(self, chunk: Chunk, totals: list[np.ndarray], n: int, v: int, documents: int, mu: tuple[float, ...]) -> None:
        size = len(chunk.hashes)
        contexts = totals[0].copy()
        contexts[1] = documents
        p = (totals[0] + 1.0) / (n + v + 1)
        #: Of each n-gram: its state as a context (0: not seen), and the state of the longest seen context that it ends with.
        reach = np.zeros(1, np.int64)
        self.start = 0
        fail, weight, order_of = [reach], [np.zeros(1)], [np.zeros(1, np.int8)]
        seen, arcs, targets = [], [], []
        made = 1
        for k in range(1, chunk.order + 1):
            code, shorter = chunk.codes[k - 1], chunk.shorter[k - 1]
            if k == 1:
                seen.append(np.ones(size, bool))  # without a context every token has an arc
            else:
                before = contexts[code // size]
                seen.append((totals[k - 1] > 0) & (before > 0))
                p = (totals[k - 1] + mu[k - 2] * p[shorter]) / (before + mu[k - 2])
                contexts = np.where(seen[-1], totals[k - 1], 0)
            arcs.append(np.log10(p))
            reach = reach[shorter]
            if k < chunk.order:
                kept = np.flatnonzero(contexts)
                fail.append(reach[kept])
                weight.append(np.log10(mu[k - 1] / (contexts[kept] + mu[k - 1])))
                order_of.append(np.full(len(kept), k, np.int8))
                reach[kept] = made + np.arange(len(kept))
                made += len(kept)
                if k == 1:
                    self.start = int(reach[1])
            targets.append(reach)
        self.fail, self.weight, self.order = np.concatenate(fail), np.concatenate(weight), np.concatenate(order_of)
        self.seen, self.arcs, self.targets = np.concatenate(seen), np.concatenate(arcs), np.concatenate(targets)
        first = np.cumsum([0, *(len(c) for c in chunk.codes[:-1])])
        self.at = np.stack([place + low for place, low in zip(chunk.places, first, strict=True)]).astype(np.int32)

    def read(self, states: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One token read in each of several traversals, by its place in the chunk: what it adds, and the states after it."""
        states = states.copy()
        arc = self.at[self.order[states], tokens]
        sums = np.zeros(len(states))
        todo = np.flatnonzero(~self.seen[arc])
        while len(todo):
            sums[todo] += self.weight[states[todo]]
            states[todo] = self.fail[states[todo]]
            arc[todo] = self.at[self.order[states[todo]], tokens[todo]]
            todo = todo[~self.seen[arc[todo]]]
        return sums + self.arcs[arc], self.targets[arc]

    def scores(self, chunk: Chunk, segment: int = SEGMENT) -> np.ndarray:
        """The log10 probability of each text of the chunk."""
        pieces = -(-chunk.lengths // segment)
        text = np.repeat(np.arange(len(pieces)), pieces)
        low = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * segment
        high = np.minimum(low + segment, chunk.lengths[text])
        first = np.maximum(low - (chunk.order - 1), 0)
        by_length = np.argsort(first - high, kind="stable")
        text, low, high, first = (x[by_length] for x in (text, low, high, first))
        place, skip, left = chunk.starts[text] + first, low - first, high - first
        states = np.where(first == 0, self.start, 0)
        sums = np.zeros(len(text))
        running = len(text)
        for step in range(int(left.max(initial=0))):
            running = int(np.searchsorted(-left[:running], -step, side="left"))
            added, states[:running] = self.read(states[:running], place[:running] + step)
            sums[:running] += np.where(skip[:running] <= step, added, 0)
        return np.bincount(text, sums, len(pieces))


def chunks(docs: DataFrame, held_out: Column, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """(chunk, n_tokens, doc_ids, held_out, lengths, hashes, tokens) of (doc_id, text) rows; words are numbered by falling frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        made = 0

        def out() -> pa.RecordBatch:
            nonlocal made
            made += 1
            all_tokens, known = np.concatenate(tokens), np.array(hashes, "<u8")
            order = np.concatenate([[0, 1], 2 + np.argsort(-np.bincount(all_tokens, minlength=len(known))[2:], kind="stable")])
            number = np.empty(len(order), np.uint32)
            number[order] = np.arange(len(order), dtype=np.uint32)
            columns = [[first + made], [size], [names], [bytes(held)], [_packed(np.array(lengths))], [known[order].tobytes()], [_packed(number[all_tokens])]]
            schema = pa.schema([("chunk", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("held_out", "lengths", "hashes", "tokens"))])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        numbers, hashes, names, held, lengths, tokens, size = {}, [_END, _START], [], [], [], [], 0
        for batch in batches:
            for doc_id, text, out_of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = words(text)
                for word in set(found).difference(numbers):
                    numbers[word] = len(hashes)
                    hashes.append(xxhash.xxh64_intdigest(word))
                tokens.append(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found)))
                tokens.append(np.zeros(1, np.uint32))
                names.append(doc_id)
                held.append(out_of)
                lengths.append(len(found) + 1)
                size += len(found) + 1
                if size >= chunk_tokens:
                    yield out()
                    numbers, hashes, names, held, lengths, tokens, size = {}, [_END, _START], [], [], [], [], 0
        if names:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"), held_out.alias("held_out"))
    return rows.mapInArrow(run, "chunk long, n_tokens long, doc_ids array<long>, held_out binary, lengths binary, hashes binary, tokens binary")


def _chunk(row: dict, order: int, bits: int) -> Chunk:
    lengths = _unpacked(row["lengths"]).astype(np.int64)
    return Chunk(np.frombuffer(row["hashes"], "<u8").astype(np.uint64), lengths, _unpacked(row["tokens"]), np.frombuffer(row["held_out"], np.uint8).astype(bool), order, bits)


def requests(table: DataFrame, order: int, shards: int, bits: int) -> DataFrame:
    """(shard, level, chunk, keys, counts): each chunk's distinct n-grams with its own training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                chunk = _chunk(row, order, bits)
                for k in range(1, order + 1):
                    places, named, bounds = chunk.dealt(k, shards, bits)
                    keys, counts = chunk.keys[k - 1][places], chunk.counts(k)[places]
                    for low in range(0, len(named), 1024):
                        some = range(low, min(low + 1024, len(named)))
                        parts = [slice(bounds[s], bounds[s + 1]) for s in some]
                        columns = [pa.array(named[low : low + 1024]), pa.array([k] * len(parts), pa.int64()), pa.array([row["chunk"]] * len(parts), pa.int64())]
                        columns += [pa.array([_packed(_steps(keys[p])) for p in parts]), pa.array([_packed(counts[p]) for p in parts])]
                        yield pa.RecordBatch.from_arrays(columns, ["shard", "level", "chunk", "keys", "counts"])

    return table.mapInArrow(run, "shard long, level long, chunk long, keys binary, counts binary")


def totals(asked: DataFrame) -> DataFrame:
    """(chunk, level, shard, counts) in the order of each request's keys, and a row with chunk null per shard and level: its counts are (tokens, distinct keys)."""
    schema = pa.schema([("chunk", pa.int64()), ("level", pa.int64()), ("shard", pa.int64()), ("counts", pa.binary())])

    def summed(shard: tuple[int, int], held: list[tuple]) -> pa.RecordBatch:
        keys = [np.cumsum(_unpacked(h[3]), dtype=np.uint64) for h in held]
        own = np.concatenate([_unpacked(h[4]) for h in held]).astype(np.float64)
        distinct, place = _numbered(np.concatenate(keys))
        count = np.bincount(place, own, len(distinct)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        found = count[place]
        replies = [(h[2], shard[1], shard[0], _packed(found[e - len(k) : e])) for h, k, e in zip(held, keys, ends.tolist(), strict=True)]
        replies.append((None, shard[1], shard[0], _packed(np.array([count.sum(), np.count_nonzero(count)]))))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*replies, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:2] != held[0][:2]:
                    yield summed(held[0][:2], held)
                    held = []
                held.append(row)
        if held:
            yield summed(held[0][:2], held)

    ordered = asked.repartition("shard", "level").sortWithinPartitions("shard", "level", "chunk")
    return ordered.mapInArrow(run, "chunk long, level long, shard long, counts binary")


def score(docs: DataFrame, held_out: Column, order: int = ORDER, mu: tuple[float, ...] = MU, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of (doc_id, text) rows, learned from those not held out."""
    spark = docs.sparkSession
    table, table_path = written(chunks(docs, held_out, chunk_tokens), "chunks")
    facts = table.agg(F.sum("n_tokens").alias("n")).first()
    shards = 1 << (max(LEAST_SHARDS, -(-(facts.n or 0) // SHARD_TOKENS)) - 1).bit_length()
    bits = min(64, max(1, facts.n or 0).bit_length() + SPARE_BITS)
    # The requests, over half of what is shuffled, needn't be there while replies and texts are.
    with settings(spark, **SHUFFLES_END):
        replies, replies_path = written(totals(requests(table, order, shards, bits)), "totals")
    sums = replies.where("chunk is null and level = 1").mapInArrow(_sums, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = sums.n or 0, sums.v or 0
    documents = docs.where(~held_out).count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, names, held, found = None, [], [], []
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["level"] == 0:
                    if chunk is not None:
                        yield walked(chunk, names, held, found)
                    chunk, names, held = _chunk(row, order, bits), row["doc_ids"], np.frombuffer(row["held_out"], np.uint8).astype(bool)
                    found = [np.zeros(len(keys), np.int64) for keys in chunk.keys]
                    level, filled = 0, 0
                elif chunk is not None:
                    if row["level"] != level:
                        level, filled = row["level"], 0
                        places = chunk.dealt(level, shards, bits)[0]
                    counts = _unpacked(row["counts"])  # a chunk's shards come in ascending order, none is left out
                    found[level - 1][places[filled : filled + len(counts)]] = counts
                    filled += len(counts)
        if chunk is not None:
            yield walked(chunk, names, held, found)

    def walked(chunk: Chunk, names: list, held: np.ndarray, found: list[np.ndarray]) -> pa.RecordBatch:
        scores = Automaton(chunk, found, n, v, documents, mu).scores(chunk)
        at = found[0][chunk.tokens]
        known, base = (np.add.reduceat(x, chunk.starts) for x in ((at > 0).astype(np.int64), np.log10((at + 1.0) / (n + v + 1))))
        columns = [pa.array(names, pa.int64()), pa.array(held), pa.array(chunk.lengths), pa.array(known), pa.array(np.full(len(names), n)), pa.array(base), pa.array(scores)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    none = F.lit(None)
    wide = table.select("chunk", F.lit(0).cast("long").alias("level"), none.cast("long").alias("shard"), none.cast("binary").alias("counts"), "doc_ids", "held_out", "lengths", "hashes", "tokens")
    back = replies.where("chunk is not null").select("chunk", "level", "shard", "counts", none.cast("array<long>").alias("doc_ids"), *(none.cast("binary").alias(c) for c in ("held_out", "lengths", "hashes", "tokens")))
    together = wide.unionByName(back).repartition("chunk").sortWithinPartitions("chunk", "level", "shard")
    scored = together.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    found, _ = written(scored, "scores")
    delete(spark, table_path, replies_path)
    return found


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [_unpacked(c).tolist() for c in batch.column(batch.schema.get_field_index("counts")).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["n", "v"])
