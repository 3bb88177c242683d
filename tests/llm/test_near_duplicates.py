"""SimHash, its trie joins, components, and the pipeline."""

import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from tabulon.llm import queries, simhash
from tabulon.llm.components import components
from tabulon.llm.fingerprints import fingerprint


def plain_fingerprint(text, size):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(prints, budget=2):
    return np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None]) <= budget)


@pytest.mark.parametrize("text", [None, "", " \t ", "one", "one TWO", "a b c d a b c", "É x y z", "w " * 3000, "v" * 100_000])
@pytest.mark.parametrize("size", [3, 5])
def test_fingerprints(text, size):
    assert fingerprint(text, size) == plain_fingerprint(text, size)


def cluster(n, seed=0, flips=5):
    rng = np.random.default_rng(seed)
    middle = int(rng.integers(0, 2**63))
    some = {middle ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, flips), replace=False)) for _ in range(n)}
    return np.array(sorted(some | {int(x) for x in rng.integers(0, 2**63, n)}), np.uint64)


@pytest.mark.parametrize("budget", [0, 1, 2, 5])
def test_trie_join_finds_each_pair_once(budget):
    prints = cluster(120)
    one = np.array([0]), np.array([len(prints)])
    pairs = [p for i, j in simhash.join_tries(prints, (*one, *one, np.array([0])), budget) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(pairs) == len(set(pairs))
    assert {tuple(sorted(p)) for p in pairs} == {(i, j) for i, j in zip(*(x.tolist() for x in near(prints, budget)), strict=True) if i < j}


@pytest.mark.parametrize("cell_rows", [1000, 20])
def test_links_keep_components_however_cells_are_cut(spark, cell_rows):
    prints = cluster(150, 4)
    table = spark.createDataFrame([(int(x), k) for k, x in enumerate(prints.view(np.int64))], "fp long, doc long")
    found, _ = simhash.links(table, 2, cell_rows)
    rows = found.collect()
    want = simhash.unite(np.arange(len(prints)), *near(prints))
    got = simhash.unite(np.arange(len(prints)), np.array([r.a for r in rows], int), np.array([r.b for r in rows], int))
    assert (got == want).all()


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_groups(spark):
    base = " ".join(f"word{k}" for k in range(300))
    texts = [(5, base), (3, base), (9, base + " more"), (11, "other text here now"), (1, None), (2, ""), (None, base), (3, base)]
    docs = spark.createDataFrame([(*x, "c", 0) for x in texts], "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(docs).collect()
    prints = [plain_fingerprint(x[1], 3) for x in texts]
    ids = [x[0] for x in texts]
    lab = simhash.unite(np.arange(len(texts)), *near(np.array(prints, np.uint64)))
    want = {(i, f"{p:016x}", None if i is None else min(j for j, y in zip(ids, lab, strict=True) if y == x and j is not None)) for i, p, x in zip(ids, prints, lab, strict=True)}
    assert {tuple(r) for r in got} == want
    assert len(got) == len(texts)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def groups_by_definition(texts):
    sets = [set(t.split()) for t in texts]
    i, j = np.array([(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]).T
    return dict(enumerate(simhash.unite(np.arange(len(sets)), i, j).tolist()))


@pytest.mark.parametrize(("both", "own"), [(4, 1), (8, 2), (16, 4), (40, 10)])
def test_pairs_just_alike_are_joined(spark, both, own):
    texts = []
    for k in range(200):
        words = [f"{k}w{i}" for i in range(both + own)]
        texts += [" ".join(words[: both + own // 2]), " ".join(words[:both] + words[both + own // 2 :])]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.kept_id for r in simhash.similar_groups(docs, size=1).collect()}
    assert got == {k: k - k % 2 for k in range(len(texts))}


@pytest.mark.parametrize("block", [256, 30])
def test_groups_around_a_common_passage(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block, raising=False)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(passage + [f"{k}h{i}" for i in range(9)]) for k in range(20)]
    for k in range(150):
        words = [f"{k}w{i}" for i in range(12)]
        texts += [" ".join(passage + words[:9]), " ".join(passage + words[:6] + words[9:])]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.kept_id for r in simhash.similar_groups(docs, size=1).collect()}
    assert got == groups_by_definition(texts)


def test_long_tries_find_each_pair_once():
    rng = np.random.default_rng(8)
    middle = rng.integers(0, 1 << 63, (3, 4), dtype=np.uint64)
    prints = middle[rng.integers(0, 3, 90)].copy()
    for row in prints:
        for bit in rng.choice(256, rng.integers(0, 60), replace=False):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    prints = prints[np.lexsort(prints.T[::-1])]
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if np.bitwise_count(prints[i] ^ prints[j]).sum() <= 50}
    got = [p for i, j in simhash.join_tries(prints, tuple(np.array([x]) for x in (0, 90, 0, 90, 0)), 50) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(got) == len(set(got))
    assert {tuple(sorted(p)) for p in got} == want
    cross = [p for i, j in simhash.join_tries(np.concatenate([prints[:40], prints[40:]]), tuple(np.array([x]) for x in (0, 40, 40, 90, 0)), 50) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert sorted(cross) == sorted((i, j) for i, j in want if i < 40 <= j)


def shingles(text):
    words = lower_words(text)
    return {" ".join(words[k : k + 5]) for k in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def lower_words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]


def kept_by_definition(rows):
    """(doc_id, text) of each group's least doc_id, comparing all pairs of texts."""
    texts = sorted({t or "" for _, t in rows})
    sets = [shingles(t) for t in texts]
    least = [min((i is None, i or 0) for i, t in rows if (t or "") == x) for x in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and (sets[i] or not sets[j])]
    labels = simhash.unite(np.arange(len(texts)), *(np.array(x, int) for x in zip(*links, strict=True))) if links else np.arange(len(texts))
    groups = {}
    for text, label, first in zip(texts, labels.tolist(), least, strict=True):
        groups.setdefault(label, []).append((first, text))
    return sorted(((None if no_id else i), text) for (no_id, i), text in (min(g, key=lambda x: x[0]) for g in groups.values()))


def test_stage_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = corpus_pipeline.near_duplicates(spark, docs, "/root/testdata/sf0.001").collect()
    assert len(kept) < len(rows)
    assert sorted((r.doc_id, r.text or "") for r in kept) == kept_by_definition(rows)


def test_clashing_ids_lose_no_text(spark):
    a = " ".join(f"w{k}" for k in range(60))
    rows = [(1, " ".join(f"z{k}" for k in range(40))), (1, a), (2, a + " x"), (2, a + " x"), (None, a + " y"), (None, "alone in the world and without an id")]
    docs = spark.createDataFrame([(*r, None, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert {(r.doc_id, r.text) for r in kept} == {rows[0], rows[1], rows[5]}
    assert len(kept) == 3


def test_a_crowd_does_not_hide_a_pair(spark):
    words = [f"p{k}" for k in range(300)]
    base = [f"q{k}" for k in range(200)]
    pair = [" ".join(words + base), " ".join(words + base[:199] + ["other"])]
    crowd = [" ".join(words + [f"{c}c{k}" for k in range(200)]) for c in range(150)]
    rows = [*enumerate(crowd), (1000, pair[0]), (1001, pair[1])]
    got = {r.doc_id: r.kept_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1001] == 1000
    assert all(got[k] == k for k in range(150))


def test_pipeline(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in kept.collect()}
        kept = stage(spark, kept, data)
        assert kept.columns == docs.columns
        after = [r.doc_id for r in kept.collect()]
        assert len(after) == len(set(after))
        assert set(after) <= before, name
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    good = corpus_pipeline.quality(spark, docs, data).select("doc_id").collect()
    share = lambda q: sum(labels.get(r.doc_id) == q for r in good) / sum(v == q for v in labels.values())
    assert share(1) > 0.95
    assert share(0) < 0.4
    packed = corpus_pipeline.run(spark, data)
    assert sorted(i for r in packed.collect() for i in r.doc_ids) == sorted(r.doc_id for r in kept.collect())
    texts = [" ".join(w for w in (r.text or "").lower().split()) for r in kept.collect()]
    assert len(texts) == len(set(texts))


def test_stages_with_odd_rows_and_clashing_columns(spark, tmp_path):
    clash = "good string, score double, lang_pred string, kept_id long, bits double, fp long, component_id long, bucket int"
    rest = ("x", 0.0, "y", 1, 0.0, 2, 3, 4)
    text = "the quick brown fox ran over the lazy dog and the hill "
    rows = [(k, text * (1 + k), "en", "s", 9, *rest) for k in range(8)] + [(20, None, "en", "s", 0, *rest), (21, "", None, None, 0, *rest), (7, text * 8, "en", "s", 9, *rest), (None, text, None, "s", 1, *rest), (22, text * 4000, "en", "s", 9, *rest)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {clash}")
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, docs.limit(0)):
        kept = table
        for name, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, str(tmp_path))
            assert name == "packing" or kept.columns == docs.columns
            assert kept.count() <= table.count()


def test_every_operator_is_registered():
    names = [*queries.queries()]
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == [*range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)
