"""Language identification, quality, scoring, SentencePiece."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tabulon.llm import backoff_lm, kneser_ney, language_id, unigram
from tabulon.llm.common import crc_of_id

DATA = "/root/testdata/sf0.001"
EN, DE = "the quick brown fox and the lazy dog ran over the hill ", "der schnelle braune fuchs und der faule hund liefen über den hügel "
DOCS = "doc_id long, text string, lang string, score string, bits string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", lower(text)) if w]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(k, (EN if k % 2 else DE) * (1 + k % 5), "en" if k % 2 else "de", None, "") for k in range(40)]
    odd = [(100, None, "en", "", ""), (101, "", "de", "", ""), (102, "12 .. !", "en", "", ""), (None, EN, None, "", ""), (104, EN * 3000, "en", "", ""), (104, EN * 3000, "en", "", ""), (105, "a\x00b", None, "", "")]
    return spark.createDataFrame(rows + odd, DOCS)


def test_languages(spark, documents):
    found = language_id.identify(documents).collect()
    assert len(found) == documents.count()
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[k].lang_pred == ("en" if k % 2 else "de") for k in range(40))
    assert all(0 <= r.score <= 1 for r in found)
    assert [(by_id[k].lang_pred, by_id[k].score) for k in (100, 101, 102)] == [("und", 0.0)] * 3
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found if r.doc_id is not None)
    assert by_id[104].lang_pred == "en"
    assert language_id.identify(documents.limit(0)).collect() == []
    nothing = language_id.identify(documents.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


def test_bundles_are_sums_of_bound_letters():
    v = language_id.TrigramVectors(64)
    (codes,) = v.trigrams(["ab"])
    a, b, blank = (v._letter(x) for x in (ord("a"), ord("b"), 0))
    want = np.roll(blank, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * blank
    assert (v.bundle(*np.unique(codes, return_counts=True)) == want).all()
    assert [len(c) for c in v.trigrams(["", "a", "1", "x\x00y", "Ab, c"])] == [0, 1, 0, 3, 4]


def plain_bundle(text, dimensions):
    """The bundle by definition, trigram by trigram."""
    v = language_id.TrigramVectors(dimensions)
    symbols = [ord(c) if c.isalpha() else 0 for c in f" {(text or '').lower()} "]
    folded = [c for k, c in enumerate(symbols) if c or not k or symbols[k - 1]]
    if not any(folded):
        return None
    letters = {c: v._letter(c).astype(float) for c in set(folded)}
    return sum(np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in zip(folded, folded[1:], folded[2:], strict=False))


def test_predictions_against_their_definition(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").where("length(text) < 3000")
    rows = docs.collect()
    found = {r.doc_id: r for r in language_id.identify(docs).collect()}
    bundles = {r.doc_id: plain_bundle(r.text, language_id.DIMENSIONS) for r in rows}
    prototypes = {}
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.lang is not None and bundles[r.doc_id] is not None:
            prototypes[r.lang] = prototypes.get(r.lang, 0) + bundles[r.doc_id]
    for r in rows:
        got, own = found[r.doc_id], bundles[r.doc_id]
        if own is None:
            assert (got.lang_pred, got.score) == ("und", 0.0)
            continue
        cosines = {name: p @ own / np.linalg.norm(p) / np.linalg.norm(own) for name, p in prototypes.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert got.score == pytest.approx(max(0.0, cosines[best]), abs=1e-5)
        assert got.lang_pred == best or cosines[got.lang_pred] == pytest.approx(cosines[best], abs=1e-5)


def test_long_texts_are_bundled_in_pieces_alike(monkeypatch):
    v = language_id.TrigramVectors(64)
    text = "  Ab, cd  efg! hi ΑΣ jklmnopqrstuvwxyz12 a b c 3 " * 7
    (whole,) = language_id._bundles(v, [text])
    for size in (1, 5, 17):
        monkeypatch.setattr(language_id, "SLICE", size)
        assert len([*language_id._pieces(text)]) > 1
        (pieced,) = language_id._bundles(v, [text])
        assert (pieced == whole).all()


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def plain_kneser_ney(texts, order):
    """Counts and interpolated probabilities by definition, one n-gram at a time."""
    edge = ["^"] * (order - 1)
    grams = {order: Counter()}
    for text in texts:
        marks = edge + list(text)
        grams[order].update(tuple(marks[k : k + order]) for k in range(len(text)))
    for k in range(order - 1, 0, -1):
        grams[k] = Counter()
        for g, n in grams[k + 1].items():
            grams[k][g[1:]] += n if g[1] == "^" else 1  # a text's start continues nothing
    size = len({g[-1] for g in grams[1]}) + 1
    discounts = {}
    for k, table in grams.items():
        n = Counter(table.values())
        if all(n[i] for i in (1, 2, 3, 4)):
            y = n[1] / (n[1] + 2 * n[2])
            found = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
            discounts[k] = [min(max(x, 0.01), i - 0.01) for i, x in zip((1, 2, 3), found, strict=True)]
        else:
            discounts[k] = [0.5, 0.75, 0.9]

    def p(gram):
        if not gram:
            return 1 / size
        k, context = len(gram), gram[:-1]
        same = [c for g, c in grams[k].items() if g[:-1] == context]
        if not same:
            return p(gram[1:])
        d = discounts[k]
        off = sum(d[min(c, 3) - 1] for c in same) / sum(same)
        own = max(grams[k][gram] - d[min(grams[k][gram], 3) - 1], 0) / sum(same) if grams[k][gram] else 0
        return own + off * p(gram[1:])

    return lambda text: -sum(math.log2(p(tuple((edge + list(text))[k : k + order]))) for k in range(len(text))) / len(text)


def test_kneser_ney_against_its_definition(spark):
    texts = ["abracadabra", "abc abd", "a", "cab bac abba"]
    model = kneser_ney.train(spark.createDataFrame([(x,) for x in texts], "text string"), 3)
    plain = plain_kneser_ney(texts, 3)
    asked = ["abra", "cad", "zzz", "b", None, "", "x" * 5]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(asked)], "doc_id long, text string")
    got = {r.doc_id: r.bits for r in kneser_ney.score(docs, model, 3).collect()}
    for k, text in enumerate(asked):
        assert got[k] == pytest.approx(plain(text), abs=1e-5) if text else got[k] is None


def test_long_texts_are_scored_in_pieces_alike(spark, monkeypatch):
    texts = ["abracadabra", "abc abd", "cab bac abba"]
    model = kneser_ney.train(spark.createDataFrame([(x,) for x in texts], "text string"), 4)
    docs = spark.createDataFrame([(0, "abra cad abra ž" * 9)], "doc_id long, text string")
    (whole,) = kneser_ney.score(docs, model, 4).collect()
    keys = kneser_ney.keys_of("abra cad abra ž" * 9, 4)
    for size in (1, 3, 50):
        monkeypatch.setattr(kneser_ney, "SLICE", size)
        pieces = [*kneser_ney._slices("abra cad abra ž" * 9, 4)]
        total = sum(model.scores(kneser_ney.keys_of(piece, 4))[lead:].sum() for piece, lead in pieces)
        assert -total / len(keys[0]) == pytest.approx(whole.bits)


def test_verdicts_against_their_definition(spark):
    """Every column of the query's table, from plain versions of the halves, the model and the quantiles."""
    rng = np.random.default_rng(9)
    letters = {"en": list("abcdefg  "), "de": list("uvwxyz  ")}
    rows = [(k, "".join(rng.choice(letters[("en", "de")[k % 2]], 60)), ("en", "de")[k % 2]) for k in range(30)] + [(40, "###!!", "en"), (41, None, "en"), (42, "abc fed", None), (43, "uv ÄÖ", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = [(k, 1) for k in range(24)] + [(40, 0), (3, 0)]
    found = {r.doc_id: r for r in kneser_ney.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    hashes = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(text) as h").collect()}
    good = {i for i, q in labels if q == 1}
    middle = sorted(hashes[i] for i in good)[len(good) // 2]
    plain = [plain_kneser_ney([t for i, t, _ in rows if i in good and (hashes[i] >= middle) != k], 5) for k in (False, True)]
    bits = {i: plain[hashes[i] >= middle](t) if t else None for i, t, _ in rows}

    def quantile(values, share):
        bins = sorted(math.floor(x * 2048) for x in values)
        return bins[max(math.ceil(len(bins) * share), 1) - 1] / 2048

    median = quantile([bits[i] for i in good], 0.5)  # no language has 50 trusted documents
    level = {i: median + (bits[i] - median) * math.sqrt(len(t) / (len(t) + 500)) for i, t, _ in rows if t}
    low, high = (quantile([level[i] for i in good], q) for q in kneser_ney.QUANTILES)
    low, high = low * 0.99, (high + 1 / 2048) * 1.01
    for i, t, lang in rows:
        r = found[i]
        assert r.lang == (lang or "und")
        assert (r.bits is None) == (not t)
        if t:
            assert (r.bits, r.perplexity, r.level) == pytest.approx((bits[i], 2 ** bits[i], level[i]), abs=2e-3)
            assert (r.low, r.high) == pytest.approx((low, high), abs=2e-3)
            assert r.good == (low <= level[i] <= high) or min(abs(level[i] - low), abs(level[i] - high)) < 2e-3
        else:
            assert not r.good


def test_quality(spark, documents):
    junk = [(200, "qx#~ " * 30, "en", "", ""), (201, "THE!! FOX!! " * 20, "de", "", "")]
    docs = documents.unionByName(spark.createDataFrame(junk, DOCS))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(30)] + [(200, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in kneser_ney.classify(docs, labels).collect()}
    assert all(found[k].good for k in range(40))
    assert not any(found[k].good for k in (100, 101, 200, 201))
    assert found[0].perplexity == pytest.approx(2 ** found[0].bits)
    assert kneser_ney.classify(docs.limit(0), labels).count() == 0
    free = kneser_ney.classify(documents, labels.where("false")).collect()
    assert all(r.good == (r.bits is not None) for r in free)


def test_good_documents_without_a_label_are_good(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    hidden = {r.doc_id for r in labels.where("quality = 1 and doc_id % 2 = 1").collect()}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    good = {r.doc_id for r in kneser_ney.classify(docs, labels.where("quality = 0 or doc_id % 2 = 0")).where("good").collect()}
    assert len(hidden) > 100
    assert len(hidden & good) > 0.9 * len(hidden)
    assert len(bad & good) < 0.4 * len(bad)


def test_all_trusted_text_is_trained_on(spark, monkeypatch):
    """Neither the number of documents, nor their length, nor what a task holds changes a verdict's numbers."""
    texts = ["abracadabra ab", "abc abd ab ž", "cab bac abba" * 9, "a", "dab\U0001f600 cab", "b ab ba"]
    docs = spark.createDataFrame([(k, x, "en") for k, x in enumerate([*texts, "bab cab", None])], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in (*range(len(texts)), 7)], "doc_id long, quality int")
    for name, bound in (("TRUSTED_DOCS", 2), ("TRUSTED_CHARS", 20), ("PIECE", 5), ("FOLD_CHARS", 9), ("HELD_GRAMS", 4), ("SLICE", 3)):
        monkeypatch.setattr(kneser_ney, name, bound, raising=False)
    found = {r.doc_id: r.bits for r in kneser_ney.classify(docs, labels).collect()}
    hashes = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(text) as h").collect()}
    middle = sorted(hashes[k] for k in range(len(texts)))[len(texts) // 2]
    plain = [plain_kneser_ney([t for k, t in enumerate(texts) if (hashes[k] >= middle) != half], 5) for half in (False, True)]
    for k, text in enumerate([*texts, "bab cab"]):
        assert found[k] == pytest.approx(plain[hashes[k] >= middle](text), abs=1e-5)
    assert kneser_ney.all_trusted(docs, labels).count() == len(texts)


def test_a_long_text_leaves_the_others_in_the_training_set(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "TRUSTED_CHARS", 1000)
    monkeypatch.setattr(kneser_ney, "PIECE", 300, raising=False)
    docs = spark.createDataFrame([(k, ("long " * 4000 if k % 5 == 0 else "short text ") * 2) for k in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, quality int")
    texts = [r.text for r in kneser_ney.trusted(docs, labels).collect()]
    assert sum(t.startswith("short") for t in texts) == 16
    assert max(map(len, texts)) <= 300
    alone = kneser_ney.trusted(docs.where("doc_id = 0"), labels).collect()
    assert [len(r.text) for r in alone] == [300]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_against_their_definition(spark, order):
    texts = ["a b a", "A b c", None, "", "a b a b d", "b", "x " * 500, "\ta\x0bb\n"]
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id long, text string")
    mu = 3.0
    got = {r.doc_id: r for r in backoff_lm.score(docs, crc_of_id("doc_id") % 7 == 2, order, (mu,) * (order - 1)).collect()}
    trained = [zlib.crc32(str(k).encode()) % 7 != 2 for k in range(len(texts))]
    marked = [["<s>", *words(x), "</s>"] for x in texts]
    one = Counter(w for m, use in zip(marked, trained, strict=True) if use for w in m[1:])
    grams = {k: Counter(tuple(m[i : i + k]) for m, use in zip(marked, trained, strict=True) if use for i in range(len(m) - k + 1)) for k in range(2, order + 1)}
    n, v = sum(one.values()), len(one)

    def p(token, before, k):
        if k == 1:
            return (one[token] + 1) / (n + v + 1)
        lower_p = p(token, before, k - 1)
        h = tuple(before[-(k - 1) :])
        if len(h) < k - 1:
            return lower_p
        c = (sum(trained) if h == ("<s>",) else one[h[0]]) if k == 2 else grams[k - 1][h]
        return (grams[k][(*h, token)] + mu * lower_p) / (c + mu) if c else lower_p

    for k, m in enumerate(marked):
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not trained[k], len(m) - 1, sum(one[w] > 0 for w in m[1:]), n)
        assert r.base_score == pytest.approx(sum(math.log10(p(w, [], 1)) for w in m[1:]))
        assert r.score == pytest.approx(sum(math.log10(p(m[i], m[:i], order)) for i in range(1, len(m))))


def test_long_texts_are_read_in_segments_alike():
    rng = np.random.default_rng(5)
    lengths = np.array([400, 1, 7, 300, 2])
    tokens = rng.integers(2, 9, lengths.sum())
    tokens[np.cumsum(lengths) - 1] = 0
    held_out = np.array([False, False, True, True, False])
    chunk = backoff_lm.Chunk(rng.integers(1, 1 << 60, 9).astype(np.uint64), lengths, tokens, held_out, 4, 40)
    totals = [chunk.counts(k) for k in range(1, 5)]
    machine = backoff_lm.Automaton(chunk, totals, int(totals[0].sum()), int((totals[0] > 0).sum()), 3, (5.0, 2.0, 1.0))
    whole = machine.scores(chunk, 1000)
    assert (machine.fail[1:] < np.arange(1, len(machine.fail))).all()  # failures lead to shorter contexts
    for segment in (1, 2, 5, 64):
        assert machine.scores(chunk, segment) == pytest.approx(whole)


def test_requests_leave_the_disk_before_the_replies_are_shuffled(spark, monkeypatch):
    write, left = backoff_lm.written, {}

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {str(files.apply(k).getName()) for k in range(files.size()) if str(files.apply(k).getName()).startswith("shuffle_")}

    def traced(df, name, *args, **options):
        before = shuffled()
        out = write(df, name, *args, **options)
        left[name] = shuffled() - before
        return out

    monkeypatch.setattr(backoff_lm, "written", traced)
    docs = spark.createDataFrame([(k, "some words of text " * (k % 9)) for k in range(200)], "doc_id long, text string")
    assert backoff_lm.score(docs, crc_of_id("doc_id") % 7 == 2).count() == 200
    assert left["totals"] == set()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_scores_of_nothing_and_of_rows_without_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert backoff_lm.score(docs.limit(0), crc_of_id("doc_id") % 7 == 2).collect() == []
    assert backoff_lm.score(docs, crc_of_id("doc_id") % 7 == 2).count() == 3


def best_cut(codec, pieces, scores, text):
    """Viterbi by definition over all pieces; a later start wins only if it is better."""
    best = [(0.0, [])] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            if best[start] is None:
                continue
            piece = text[start:end]
            known = [(scores[i], [i]) for i, x in enumerate(pieces) if x == piece]
            if not known and end == start + 1:
                known = [(codec.penalty, [codec.unknown] * len(piece.encode()))]
            for score, ids in known:
                if best[end] is None or best[start][0] + score > best[end][0]:
                    best[end] = (best[start][0] + score, best[start][1] + ids)
    return best[-1][1]


def test_streaming_viterbi_against_its_definition():
    rng = np.random.default_rng(3)
    pieces = ["<unk>", "▁", "a", "b", "aa", "ab", "ba", "▁a", "▁b", "aab", "bab", "abba", "▁ab", "▁▁"]
    scores = [0.0, *(-rng.integers(1, 9, len(pieces) - 1)).astype(float).tolist()]
    codec = unigram.Codec(pieces, scores, ["unknown", *["normal"] * (len(pieces) - 1)])
    for _ in range(300):
        text = "".join(rng.choice(list("ab c"), rng.integers(1, 40)))
        want = best_cut(codec, pieces, scores, "▁" + text.replace(" ", "▁"))
        assert codec.encode(text).tolist() == want
        marked = "▁" + text.replace(" ", "▁")
        assert [i for part in codec.stream(marked) for i in part] == want
        assert [i for part in codec.stream(marked, remember=True) for i in part] == want


def test_words_remembered_in_any_order_give_the_same_ids():
    rng = np.random.default_rng(12)
    pieces = ["<unk>", "▁", "a", "b", "aa", "ab", "▁a", "▁b", "aab", "abba", "▁ab", "▁▁"]
    scores = [0.0, *(-rng.integers(1, 9, len(pieces) - 1)).astype(float).tolist()]
    codec = unigram.Codec(pieces, scores, ["unknown", *["normal"] * (len(pieces) - 1)])
    assert codec.by_words
    for _ in range(200):
        text = "▁" + "".join(rng.choice(list("ab▁c"), rng.integers(1, 60)))
        plain = [i for part in unigram.Codec(pieces, scores, ["unknown", *["normal"] * (len(pieces) - 1)]).stream(text) for i in part]
        assert [i for part in codec.stream(text, remember=True) for i in part] == plain == best_cut(codec, pieces, scores, text)
    assert len(codec.known) > 50


def test_scores_are_kept_for_the_longest_piece_only():
    codec = unigram.Codec(["<unk>", "aa"], [0, -1], ["unknown", "normal"])
    text = "a" * 20_001  # the paths of even and of odd boundaries never meet
    (portion,) = codec.stream(text)
    assert len(portion) == 10_001
    assert codec.longest + 1 == 3


def test_window_stays_short_where_paths_meet():
    codec = unigram.Codec(["<unk>", "▁", "a", "b", "aa", "ab"], [0, -1, -1, -1, -3, -1.5], ["unknown", *["normal"] * 5])
    portions = [*codec.stream("ab" * 20_000)]
    assert max(map(len, portions)) <= 16
    assert sum(map(len, portions)) == 20_000


def test_sentencepiece_with_the_public_model(spark):
    import public_tokenizers
    import sentencepiece

    model = str(public_tokenizers.path("piece_bpe_32k.model"))
    texts = [None, "", "the cat sat", "  two  blanks ", "日本語\n\t🎉", "x" * 3000, "a\x00b"]
    docs = spark.createDataFrame([(k, x, "c") for k, x in enumerate(texts)], "doc_id long, text string, ids string")
    found = {r.doc_id: r for r in unigram.round_trip(docs, model).collect()}
    assert all(r.round_trip for r in found.values())
    assert [found[k].n_tokens for k in (0, 1)] == [0, 0]
    library, codec = sentencepiece.SentencePieceProcessor(model_file=model), unigram.Codec.load(model)
    for text in filter(None, texts):
        ids = codec.encode(text)
        assert found[texts.index(text)].ids_crc32 == zlib.crc32(ids.astype("<u4").tobytes())
        assert library.decode(ids.tolist()) == text == codec.decode(ids)
    assert unigram.round_trip(docs.limit(0), model).collect() == []


def test_a_task_round_trips_in_one_worker(spark):
    """Each worker remembers words, so a task that passed ids from one worker to another would hold them twice."""
    import public_tokenizers

    docs = spark.createDataFrame([(1, "some words, and some words more"), (2, None), (None, "ž")], "doc_id long, text string")
    found = unigram.round_trip(docs, str(public_tokenizers.path("piece_bpe_32k.model")))
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert found.where("not round_trip or ids_crc32 is null").count() == 0
