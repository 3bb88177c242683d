"""WARC, token files, packing, exact and approximate search."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import ball_tree, ivf_pq, packing, page_archives, pfor, queries, token_ids, warc
from tabulon.llm.common import written


def test_chunked_framing():
    for payload in (b"", b"x", b"a" * 10_000, b"\r\n0\r\n\r\n"):
        assert warc.dechunked(warc.chunked(payload, 7)) == payload
    assert warc.dechunked(b"3;name=v\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for bad in (b"", b"3\r\nab\r\n0\r\n\r\n", b"-1\r\n\r\n", b"3\r\nabc\r\n", b"0\r\n\r\nmore", b"0\r\n"):
        with pytest.raises(warc.FramingError):
            warc.dechunked(bad)


def part(number, block, total=None, kind="response", error=None, origin="o"):
    return (origin, number, total, kind if number == 1 else "continuation", None, None, None, block, error)


def test_reassembly():
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc.chunked(b"hello", 2)
    pieces = [block[:10], block[10:30], block[30:]]
    parts = [part(k + 1, p, len(block) if k == 2 else None) for k, p in enumerate(pieces)]
    assert [r[6] for r in warc.assemble(parts)] == [b"hello"]
    assert [r[6] for r in warc.assemble(sorted(parts * 2, key=lambda p: p[1]))] == [b"hello"] * 2
    for bad in (parts[:2], parts[1:], [parts[0], parts[2]], [*parts[:2], part(3, pieces[2], 5)], [*parts, part(3, b"other")], [part(1, block[:40])], [part(1, block, error="truncated record")]):
        (row,) = warc.assemble(bad)
        assert row[6] is None
        assert row[7]


def test_parsing_cuts_by_length():
    inside = b"\r\n\r\nWARC/1.1\r\nWARC-Type: fake\r\n\r\n"
    one = warc._record([(b"WARC-Record-ID", b"<a>")], inside)
    found = [*warc.parse(one + b"\r\n\r\n" + one + b"\r\n\r\n")]
    assert [b for _, b, _ in found] == [inside] * 2
    assert not [*warc.parse(one[:-3])][0][2]
    assert [*warc.parse(b"")] == []


def test_files_have_a_member_for_each_record_and_say_what_made_them(spark, tmp_path):
    import gzip

    rows = [(f"urn:r:{k}", "http://u", b"x" * (k * 9000), hashlib.sha1(b"x" * (k * 9000)).hexdigest(), None) for k in range(4)]
    captures = spark.createDataFrame(rows, "record_id string, uri string, payload binary, digest string, refers_to string").coalesce(1)
    warc.write_archives(captures, str(tmp_path / "w"), per_file=4)
    files = sorted((tmp_path / "w").glob("part-*"))
    assert len(files) == 2
    found = 0
    for file in files:
        assert file.name.endswith(".warc.gz")
        data, members = file.read_bytes(), []
        while data:
            stream = zlib.decompressobj(31)
            members.append(stream.decompress(data))
            assert stream.eof
            data = stream.unused_data
        assert b"".join(members) == gzip.decompress(file.read_bytes())
        assert all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") for m in members)
        assert b"WARC-Type: warcinfo" in members[0]
        assert not any(b"WARC-Type: warcinfo" in m for m in members[1:])
        assert all(re.search(rb"WARC-Date: 20\d\d-", m) for m in members)
        found += len(members) - 1
    assert found == 6
    read = {r.record_id: r for r in warc.read_archives(spark, str(tmp_path / "w")).where("type = 'response'").collect()}
    assert {k: r.payload for k, r in read.items()} == {r[0]: r[2] for r in rows}
    wrong = spark.createDataFrame([("a", "u", b"payload", "0" * 40, None)], captures.schema)
    warc.write_archives(wrong, str(tmp_path / "v"))
    (bad,) = warc.read_archives(spark, str(tmp_path / "v")).where("type = 'response'").collect()
    assert (bad.payload, bad.error) == (None, "another digest")


def test_many_copies_without_ids(spark):
    pages = spark.createDataFrame([(None, "u", "")] * 500 + [(k, "u", "z" * 2000) for k in range(300)], "page_id long, url string, html string")
    found = page_archives.archived(pages).collect()
    assert len(found) == 800
    assert sum(r.record_type == "revisit" and r.refers_to == 299 and r.payload_bytes == 2000 for r in found) == 299


def test_pages(spark):
    long, longer = "é" * 700, "x" * 50_000
    rows = [(1, "http://a b\r\nX: y", "short"), (2, None, "short"), (3, "u", long), (4, "u", long), (5, "u", longer), (6, "u", None), (7, "u", ""), (9, "u", longer), (9, "u", longer), (None, "u", long)]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string")
    found = {(r.page_id, r.record_type, r.refers_to): r for r in page_archives.archived(pages).collect()}
    want = {(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "revisit", 9), (6, "response", None), (7, "response", None), (9, "response", None), (None, "response", None)}
    assert set(found) == want
    for (page_id, _, _), r in found.items():
        html = next(h or "" for p, _, h in rows if p == page_id).encode()
        assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha1(html).hexdigest())
    assert page_archives.archived(pages).count() == len(rows)
    assert page_archives.archived(pages.limit(0)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 4000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for top in (1, 2, 50_000, 2**32 - 1):
        ids = rng.integers(0, top, n, dtype=np.uint32)
        ids[rng.random(n) < 0.03] = top - 1
        starts, blocks = pfor.pack(ids)
        assert (pfor.unpack(starts, blocks, n) == ids).all()


def test_frames():
    ids = np.arange(5000, dtype=np.uint32)[::-1].copy()
    one = pfor.frame([5, None, 7], [ids[:10], ids[:0], ids[10:]], 3, 4, 100)
    first, second = pfor.frames(one + b"\n" + one + b"\n")
    assert (second.partition, second.sequence, second.ids) == (3, 4, 5000)
    assert [(d, at, len(x)) for d, at, x in pfor.documents(one + b"\n" + one, second)] == [(5, 100, 10), (None, 110, 0), (7, 110, 4990)]
    assert (pfor.ids_between(one, first, 300, 1000) == ids[300:1000]).all()
    with pytest.raises(ValueError, match="no frame"):
        [*pfor.frames(one[:-1])]


def test_token_files(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    texts = [(9, "The CAT, it's <|endoftext|> 12 cats!!"), (2, None), (3, ""), (-4, "ΣΑΣ İstanbul é 日本 \x1c🎉🎉 x\x0by z"), (7, "word " * 70_000), (5, "dup"), (5, "dup"), (None, "no id")]
    docs = spark.createDataFrame([(*x, "c") for x in texts], "doc_id long, text string, ids string")
    got = token_ids.round_trip(docs, path).orderBy("start").collect()
    library = Tokenizer.from_file(path)
    start = 0
    for r, (doc_id, text) in zip(got, sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_ids.round_trip(docs.limit(0), path).collect() == []


def test_tokenizers_of_another_kind_get_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["The CAT, it's 12 cats!!", "", None, "  two  blanks\n\tand İ"]
    library = Tokenizer.from_file(path)
    for text, ids in zip(texts, token_ids.PieceEncoder(path).encode(texts), strict=True):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids
    assert token_ids.PieceEncoder(str(public_tokenizers.path("word_bpe_49k.json"))).by_pieces


def test_pieces_of_odd_letters_and_marks_encode_as_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["\u0130.", "x\u0130!! y", "\u0958.", "}\u017f!", "it\u0130's", "<|ENDOFTEXT|> The <|endoftext|>.", "a\u3000.", "\u0344.", "\u00c9t\u00c9,", "\U000323b0.", "a\U000323b0", " \x1ca\x85 ", " "]
    texts = [*odd, None, "", " ".join(odd), "\n".join(odd[::-1])]
    library = Tokenizer.from_file(path)
    expected = [library.encode(text or "", add_special_tokens=False).ids for text in texts]
    assert [ids.tolist() for ids in token_ids.PieceEncoder(path).encode(texts)] == expected
    assert [next(iter(token_ids.PieceEncoder(path).encode([text]))).tolist() for text in texts] == expected


def test_pieces_are_learned_once_and_the_memory_is_bounded(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    learned, learn = [], token_ids.PieceEncoder._learn
    monkeypatch.setattr(token_ids.PieceEncoder, "_learn", lambda self, pieces: (learned.extend(pieces), learn(self, pieces))[1])
    codec = token_ids.PieceEncoder(path)
    texts = ["".join(chr(97 + n // 26**k % 26) for k in range(4)) + tail for n in range(1000) for tail in ("", ".", ",", ";")]
    assert len([*codec.encode(texts)]) == len([*codec.encode(texts[::-1])]) == 4000
    assert len(learned) == len(set(learned)) == 1003
    for name, value in (("_REMEMBERED", 100), ("_REMEMBERED_BYTES", 3000), ("_SLICE", 500), ("_LOOKED_UP", 50)):
        monkeypatch.setattr(token_ids, name, value)
    codec, library = token_ids.PieceEncoder(path), Tokenizer.from_file(path)
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert max(len(codec.known), len(codec.before)) <= 150


def test_token_files_of_a_whole_table(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = token_ids.round_trip(docs, path).orderBy("start").collect()
    library = Tokenizer.from_file(path)
    start = 0
    for r, (doc_id, text) in zip(got, sorted(docs.collect(), key=lambda x: x[0]), strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_buckets_pad_least():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, k = int(rng.integers(1, 9)), int(rng.integers(1, 6))
        lengths, counts = np.sort(rng.choice(60, n, replace=False)), rng.integers(1, 9, n)
        cost = lambda bounds: sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))  # noqa: B023, E731
        chosen = packing.choose(lengths, counts, k)
        assert len(chosen) <= k
        assert cost(chosen) == min(cost((*x, lengths[-1])) for r in range(min(k, n)) for x in itertools.combinations(lengths[:-1], r))


def least_padding(lengths, buckets):
    """The least padded size by the plain quadratic programme."""
    distinct = sorted(set(lengths))
    rows = [0, *itertools.accumulate(lengths.count(x) for x in distinct)]
    cost = [0] + [math.inf] * len(distinct)
    for _ in range(buckets):
        cost = [min([cost[j], *(cost[i] + distinct[j - 1] * (rows[j] - rows[i]) for i in range(j))]) for j in range(len(cost))]
    return cost[-1]


def test_buckets_pad_least_at_any_length():
    rng = np.random.default_rng(2)
    lengths = np.concatenate([rng.integers(0, 300, 400), rng.integers(1000, 6000, 300), [90_000]]).tolist()
    distinct, counts = np.unique(lengths, return_counts=True)
    chosen = packing.choose(distinct, counts, 16)
    assert len(chosen) == 16
    assert sum(min(b for b in chosen if b >= x) for x in lengths) == least_padding(lengths, 16)


@pytest.mark.parametrize("merged", [64, 2])
def test_packing(spark, monkeypatch, merged):
    import tiktoken

    monkeypatch.setattr(packing, "MERGED", merged)
    ranks, pattern = queries.byte_pairs()
    rows = [(k, "word " * (k % 50)) for k in range(400)] + [(None, None), (7, "x"), (7, "x"), (900, "y " * 5000), (901, "")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bucket int").repartition(5)
    made = packing.pack_documents(docs, ranks, pattern, 4, 256)
    got = packing.places(made).collect()
    encode = packing.encoder(ranks, pattern)
    known = sorted((str(i), len(encode(t or ""))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == known
    assert sum(r.bucket_length for r in got) == least_padding([n for _, n in known], 4)
    for bucket in {r.bucket for r in got}:
        own = [r for r in got if r.bucket == bucket]
        per = max(1, 256 // max(1, own[0].bucket_length))
        assert sorted(r.batch * per + r.slot for r in own) == [*range(len(own))]
        assert all(r.n_tokens <= r.bucket_length for r in own)
    decoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=encode.__self__._mergeable_ranks, special_tokens={})
    texts = []
    for r in made.collect():
        matrix = np.frombuffer(r.ids, "<u4").reshape(len(r.doc_ids), r.bucket_length)
        texts += [(str(i), decoder.decode(line[:n].tolist())) for i, n, line in zip(r.doc_ids, r.n_tokens, matrix, strict=True)]
        assert all((line[n:] == packing.PAD).all() for n, line in zip(r.n_tokens, matrix, strict=True))
    assert sorted(texts) == sorted((str(i), t or "") for i, t in rows)
    assert packing.pack_documents(docs.limit(0), ranks, pattern).collect() == []


def test_few_batches_are_read_at_once(spark, monkeypatch):
    """Batches lie in small row groups, apart from what is left over, and get their numbers without a join that shuffles them."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(packing, "GROUP_BYTES", 1 << 14, raising=False)
    tables, write = [], packing.written
    monkeypatch.setattr(packing, "written", lambda df, name, *a, **k: tables.append((name, *write(df, name, *a, **k))) or tables[-1][1:])
    docs = spark.range(4000).selectExpr("id as doc_id", "repeat('word ', cast(id % 50 as int)) as text").repartition(3)
    made = packing.pack_documents(docs, *queries.byte_pairs(), 4, 2048)
    filled = [df for name, df, _ in tables if name == "batches"]
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in filled[0].inputFiles()]
    groups = [m.row_group(k) for m in files for k in range(m.num_row_groups)]
    assert len(groups) > 3 and max(g.num_rows for g in groups) * 2048 * 4 < 1 << 19
    assert all(df.where("full").count() == 0 or {*df.where("full").selectExpr("rest is null").distinct().collect()} == {(True,)} for df in filled)
    assert filled[0].where("not full and ids is not null").count() == 0
    assert all("number" not in df.columns for name, df, _ in tables if name != "batches")
    assert sum(len(r.doc_ids) for r in made.collect()) == 4000


VECTORS = "vec_id long, embedding array<float>, label int, score double"


def vectors(spark, n=400, size=6):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=size).astype(np.float32).tolist(), 0, 0.0) for k in range(n)]
    rows += [(n + k, [0.5] * size, 0, 0.0) for k in range(60)]  # ties
    odd = [(1000, None, 0, 0.0), (1050, [1.0, None], 0, 0.0), (1100, [float("nan")] * size, 0, 0.0), (1150, [float("inf")] + [1.0] * (size - 1), 0, 0.0), (None, [1.0] * size, 0, 0.0), (1200, [0.0] * size, 0, 0.0), (0, rows[0][1], 0, 0.0)]
    return rows, spark.createDataFrame(rows + odd, VECTORS)


def test_exact_search(spark):
    rows, table = vectors(spark)
    rows.append((1200, [0.0] * 6, 0, 0.0))
    ints = {r[0]: np.floor(256 * np.array(r[1], np.float64)).astype(np.int64) for r in rows}
    want = []
    for q in (k for k in ints if k % 50 == 0):
        ranked = sorted(((-int(v @ ints[q]), k) for k, v in ints.items() if k != q))[:5]
        want += [(q, i + 1, k, -s) for i, (s, k) in enumerate(ranked)]
    got = ball_tree.search(table, F.col("vec_id") % 50 == 0, shard_rows=70, block_queries=3)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert ball_tree.search(table.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0, 5.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ball_tree.search(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 256 * 512)]
    huge = spark.createDataFrame([(0, [1e12]), (1, [1e12])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in ball_tree.search(huge, F.col("vec_id") == 0).collect()] == [(0, 1, 1, (1 << 63) - 1)]
    vast = spark.createDataFrame([(k, [1e300, -1e300 * k]) for k in range(30)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in ball_tree.search(vast, F.col("vec_id") == 7, shard_rows=4).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def clustered(spark, n=600, size=6, apart=10.0):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(8, size)) * apart
    rows = [(k, (middles[k % 8] + rng.normal(size=size)).tolist()) for k in range(n)]
    return dict(rows), spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_clusters_that_cannot_reach_are_not_asked(spark, monkeypatch):
    real, table = clustered(spark)
    made = {}
    monkeypatch.setattr(ball_tree, "written", lambda df, name: made.setdefault(name, []).append(written(df, name)) or made[name][-1])
    monkeypatch.setattr(ball_tree, "delete", lambda *_: None)
    got = ball_tree.search(table, F.col("vec_id") % 50 == 0, shard_rows=75, block_queries=4).collect()
    asked = sum(len(r.ids) // 8 for r in made["asked"][1][0].collect())
    shards = made["shards"][0][0].count()
    assert asked < 0.6 * 12 * (shards - 1)
    ints = {k: np.floor(256 * np.array(v)).astype(np.int64) for k, v in real.items()}
    for q in range(0, 600, 50):
        want = sorted((-int(v @ ints[q]), k) for k, v in ints.items() if k != q)[:5]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want


def test_repeated_ids_count_once_by_their_first_vector(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(200)] + [(20, [50.0, 0.0, 0.0, 0.0]), (20, [60.0, 0.0, 0.0, 0.0]), (100, [-70.0, 1.0, 1.0, 1.0])]
    first = {}
    for k, v in rows:
        first[k] = min(first.get(k, v), v)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for search, scale in ((ball_tree.search, 256), (ivf_pq.search, 1)):
        got = search(table, F.col("vec_id") % 50 == 0).collect()
        assert len({(r.query_id, r.vec_id) for r in got}) == len(got)
        ints = {k: np.floor(np.array(v) * 256) if scale == 256 else np.array(v) for k, v in first.items()}
        assert all(r.score == pytest.approx(ints[r.query_id] @ ints[r.vec_id]) for r in got)


def test_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(2)
    points = np.floor(rng.normal(size=(500, 4)) * 256)
    tree = ball_tree.Tree(np.arange(500), points, 16)
    for q in points[:20]:
        best = sorted(((int(x @ q), -k) for k, x in enumerate(points) if k != 3), reverse=True)[:5]
        assert sorted(tree.search(q, 3, 5, [], None), reverse=True) == best
        assert sorted(tree.search(q, 3, 5, [], best[-1][0]), reverse=True) == best


def test_approximate_search(spark):
    rows, table = vectors(spark)
    real = {r[0]: np.array(r[1], np.float64) for r in rows}
    got = ivf_pq.search(table, F.col("vec_id") % 20 == 0, cell_rows=40).collect()
    hits = 0
    for q in (k for k in real if k % 20 == 0):
        score = {k: sum(float(a) * float(b) for a, b in zip(v, real[q], strict=True)) for k, v in real.items() if k != q}
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [*range(1, 21)]
        assert all(r.score == pytest.approx(score[r.vec_id], abs=1e-12) for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len({r.vec_id for r in own} & set(sorted(score, key=lambda k: (-score[k], k))[:20]))
    assert hits >= 0.9 * 20 * len({r.query_id for r in got})
    assert not {1000, 1050, 1100, 1150, 1200} & {r.vec_id for r in got}
    assert ivf_pq.search(table.limit(0), F.col("vec_id") % 20 == 0).collect() == []
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 5.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in ivf_pq.search(few, F.col("vec_id") == 0).collect()] == [(1, 12.0)]
